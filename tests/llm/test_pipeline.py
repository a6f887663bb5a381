"""The stages over a small fixture with planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_empty_tables(spark, no_docs):
    docs = no_docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() == 0


@pytest.mark.parametrize("stage_name", ["line_dedup", "near_duplicates", "decontamination", "source_mix"])
def test_stage_on_odd_rows(spark, odd_docs, stage_name):
    function = dict(corpus_pipeline.STAGES)[stage_name]
    out = function(spark, odd_docs, SF)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    gone = set(range(16)) - set(ids)
    assert gone == ({5, 6} if stage_name == "near_duplicates" else set()) and None in ids
    if stage_name == "source_mix":
        assert {"taken", "target"} <= set(out.columns)


def test_planted_cases(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 700 and 1500").orderBy("doc_id").limit(3).collect()
    rows = [(9000, plain[0]["text"] + " " + bench), (9001, plain[1]["text"]), (9002, plain[1]["text"]), (9003, plain[2]["text"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [9001, 9002, 9003]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [9000, 9001, 9003]


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("doc_id", "id")
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").join(labels, F.col("doc_id") == F.col("id"))
    n = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    was = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert n[0] >= 0.97 * was[0] and n.get(1, 0) <= 0.5 * was[1]


def test_mix_counts_each_row_once(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(n)), "s") for i, n in ((None, 300), (None, 200), (None, 900), (1, 500), (1, 400), (2, 700))]
    out = corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert sorted(r["size"] for r in out) == [200, 300, 400, 500, 700, 900]
    assert all(r["size"] == len(r["text"].split()) and r["taken"] <= 2 * r["size"] for r in out)
    assert abs(sum(r["taken"] for r in out) - out[0]["target"]) <= 128
