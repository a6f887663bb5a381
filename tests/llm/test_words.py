import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXT = st.text(st.sampled_from("aB é\t\n.ßZ0日 "), max_size=30)


def found(texts, table):
    data, offsets = words.flat(pa.array(texts, pa.string()))
    hashes, start, size, first = words.spans(data, offsets, table)
    got = [[data[s : s + n].tobytes().decode() for s, n in zip(start[a:b], size[a:b])] for a, b in zip(first, first[1:])]
    return got, hashes, first


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((words.NOT_SPACE, SPACE), (words.ALNUM, ALNUM)):
        got, hashes, _ = found(texts, table)
        want = [re.findall(pattern, (t or "").translate(LOWER) if pattern == ALNUM else t or "") for t in texts]
        assert [[w.translate(LOWER) for w in t] for t in got] == [[w.translate(LOWER) for w in t] for t in want]
        names = [w.translate(LOWER) for t in got for w in t]
        assert len(set(names)) == len(set(hashes.tolist())) and len({*zip(names, hashes.tolist())}) == len(set(names))


def test_slices_and_batches_do_not_change_hashes(monkeypatch):
    texts = ["one two  three " * 50, None, "", "x" * 500, "one", "two"]
    whole = found(texts, words.NOT_SPACE)[1]
    monkeypatch.setattr(words, "SLICE", 16)
    assert (found(texts, words.NOT_SPACE)[1] == whole).all()
    column = pa.array(texts, pa.string())
    parts = [words.word_hashes(column.slice(i, 1))[0] for i in range(len(texts))]
    assert (np.concatenate(parts) == whole).all()


@pytest.mark.parametrize("k", [1, 2, 4])
def test_runs_stay_inside_texts(k):
    texts = ["a b c", "b c d e", "", "c", "a b c d"]
    hashes, first = words.word_hashes(pa.array(texts))
    runs = words.runs(hashes, k)[words.inside_texts(first, k)]
    want = [tuple(t.split()[i : i + k]) for t in texts for i in range(len(t.split()) - k + 1)]
    assert len(runs) == len(want) and len(set(zip(runs.tolist(), want))) == len(set(want)) == len(set(runs.tolist()))


def test_short_text_is_one_shingle():
    hashes, _ = words.word_hashes(pa.array(["a b"]))
    assert len(words.shingle_set(hashes, 4)) == 1
    assert not len(words.shingle_set(hashes[:0], 4))
