import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 997}x" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, copies, near copies, repeated rows, a very long text, and columns whose names clash."""
    base = sentence(1, 120)
    line = "A line that is repeated in many documents, and long enough to count"
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "one", "en", "b", 3), (4, base, "en", "b", 0), (5, base, "en", None, 0),
        (6, base.replace("w38x", "changed", 1), "en", "a", 0), (7, sentence(2, 120), "fr", "a", 0), (7, sentence(2, 120), "fr", "a", 0), (8, "word " * 60_000, "en", "c", 0),
        (9, sentence(3, 40) + "\n" + line, "en", "b", 0), (10, line.upper() + "\n" + sentence(4, 40), "en", "b", 0), (11, " " + line + "\t\n" + line, "de", "b", 0),
        (12, sentence(5, 30) + "\n" + line, "de", "b", 0), (13, line, "de", "a", 0), (14, "12345 !!! 678", "en", "a", 0), (None, sentence(6, 50), "en", "a", 0), (15, sentence(7, 200_000 // 6), "en", "c", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = ("score", "row", "size", "n_lines", "n_words", "c", "hits", "key", "range", "target", "label", "id", "drops")
    return docs.select("*", *(F.lit(i).alias(name) for i, name in enumerate(extra)))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
