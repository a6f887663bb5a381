"""Near duplicates, components, repeated lines, fingerprints."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp
from tidemark.llm import line_dedup as ld
from tidemark.llm import near_duplicates as nd
from tidemark.llm.components import components


def brute_components(texts: dict, k: int, share: int = 80) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("outside", "edits"), [(1024, [0, 1, 2, 3, 5]), (4, [0, 0, 1, 1, 2])])
def test_near_duplicates_match_brute_force_with_large_groups(spark, monkeypatch, outside, edits):
    monkeypatch.setattr(nd, "LEAF", 4)  # so that groups of a few dozen are large nodes
    monkeypatch.setattr(nd, "SLICE", 8)
    monkeypatch.setattr(nd, "OUTSIDE", outside)
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    texts = {}
    for g in range(3):
        base = [rnd.choice(words) for _ in range(90)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rnd.choice(edits)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts[len(texts)] = " ".join(copy)
    for _ in range(40):
        texts[len(texts)] = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_components(texts, 4)


def test_cells_give_fewer_links_than_members_and_miss_none(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF", 4)
    monkeypatch.setattr(nd, "SLICE", 16)
    told = []
    plain = nd.stage
    monkeypatch.setattr(nd, "stage", lambda df, label: told.append((label, plain(df, label))) or told[-1][1])
    rnd = random.Random(8)
    words = [f"u{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = {}
    for i in range(150):  # a group in which few pairs are similar enough and many nearly are
        copy = list(base)
        for _ in range(rnd.choice([2, 3, 4, 5])):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_components(texts, 4) and len(set(got.values())) > 10
    cells = [df for label, df in told if label.startswith("pairs-") and "partners" in df.columns]
    assert cells
    for df in cells:
        assert df.groupBy("node", "block", "piece").count().where(f"count > {2 * nd.SLICE + 32}").isEmpty()
        told_once = df.selectExpr("c", "explode(partners) as d").selectExpr("least(c, d) as a", "greatest(c, d) as b").groupBy("a", "b").count()
        assert told_once.where("count > 1").isEmpty()


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = nd.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[0]["kept"]
    assert by[3]["n_shingles"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == by[6]["component_id"] == 4
    assert not by[5]["kept"] and by[8]["n_shingles"] == 1 and by[7]["component_id"] == 7
    assert nd.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (3, 4), (4, 3)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[1000 + i] == 1000 for i in range(50)) and len(out) == 111


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64))
    index = ld.build_index(keys)
    assert sorted(ld.look_up(index, keys).tolist()) == list(range(len(keys)))
    place = ld.look_up(index, keys + np.uint64(1))
    assert place.max() < len(keys)
    with pytest.raises(ValueError, match="distinct"):
        ld.build_index(np.array([1, 1], np.uint64))
    assert ld.look_up(ld.build_index(keys[:0]), keys[:3]).tolist() == [-1, -1, -1]


def brute_lines(rows, min_docs=5, min_chars=40):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    seen, last = {}, {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                seen[k] = seen.get(k, 0) + 1
                last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or seen.get(key(x), 0) < min_docs or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_repeated_lines_of_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(ld, "TASK_PROBES", 3)
    out = [(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in ld.drop_repeated_lines(odd_docs).collect()]
    want = brute_lines([(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()])
    assert sorted(out, key=str) == sorted(want, key=str)
    assert {r[0]: r[3] for r in out}[13] == 0 and sum(r[3] for r in out) == 5
    empty = ld.drop_repeated_lines(no_docs)
    assert empty.count() == 0 and {"score", "n_lines", "n_dropped"} <= set(empty.columns)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_match_the_plain_table():
    rnd = random.Random(2)
    left = ["".join(rnd.choices(fp.ALPHABET[: rnd.choice([3, 64])], k=rnd.choice([0, 1, 9, 63, 64]))) for _ in range(200)]
    right = [x[:20] + x[23:] for x in left[:60]] + ["".join(rnd.choices(fp.ALPHABET, k=rnd.choice([0, 1, 30, 64]))) for _ in range(140)]
    assert fp.edit_distances(left, right).tolist() == [plain_distance(a, b) for a, b in zip(left, right)]


def test_fingerprint_follows_local_edits_and_pieces(monkeypatch):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(2000)).encode()
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "_PIECE", 1000)
    assert fp.fingerprint(text) == whole
    edited = fp.fingerprint(text[:5000] + b"!!!" + text[5000:])
    other = fp.fingerprint(" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(2000)).encode())
    near, far = fp.likeness([whole, whole, whole], [edited, other, whole])[[0, 1]]
    assert near > 0.9 and far < 0.4 and fp.likeness([whole], [whole])[0] == 1
    assert fp.likeness(["3::"], [whole])[0] == 0 and fp.likeness(["3::"], ["3::"])[0] == 1


def test_edits_come_from_the_next_document(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").collect()
    for rows_per_range in (4, 1000):
        out = fp.compare_with_edits(odd_docs, rows_per_range).collect()
        assert len(out) == len(docs)
        order = sorted(((r["doc_id"], r["text"] or "") for r in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
            n = len(text) // 3
            want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest(), fp.fingerprint(text.encode())))
        assert sorted(want, key=str) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in out), key=str)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert fp.compare_with_edits(no_docs).count() == 0
    alone = fp.compare_with_edits(odd_docs.where(F.col("doc_id") == 4)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


def test_neighbours_are_answered_in_small_pieces():
    texts = [f"{i % 7} some words of text {i % 11}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 1000), pa.array([False] * 999 + [True]), pa.array(range(1000)), pa.array(texts)], ["range", "guest", "doc_id", "text"])
    out = list(fp._neighbours(iter([batch])))
    assert max(b.num_rows for b in out) <= fp._ROWS
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(999))
    assert [r["fingerprint"] for r in rows] == [fp.fingerprint(t.encode()) for t in texts[:-1]]
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
    assert [r["edited_fingerprint"] for r in rows] == [fp.fingerprint(t.encode()) for t in edited]


def test_recall_holds_at_the_deepest_level(spark, monkeypatch):
    stated = 0.001
    assert nd.miss(nd.SURE, 0.8) ** nd.TREES < stated and nd.miss(nd.LEVELS, 0.8) ** nd.TREES > stated
    assert nd.miss(nd.LEVELS, 0.8) ** (nd.TREES + nd.further(nd.TREES, 0.8)) < stated
    # pairs of similarity 0.8 stay together in trees as often as that says: the second way is there at deep levels too
    rows = spark.range(400).selectExpr("1L as node", "0 as tree", "id as c", "id as label", f"cast(repeat('x', {4 * nd.TOKENS + nd.BITS_OF // 2}) as binary) as sig")
    assert nd.branched(rows.withColumn("node", rows.c * 7919), nd.LEVELS, 1, 0.8).count() > 440
    # classes that pass through large nodes are branched in further trees
    monkeypatch.setattr(nd, "LEVELS", 4)
    monkeypatch.setattr(nd, "OUTSIDE", -1)
    seen, plain = [], nd._descend
    monkeypatch.setattr(nd, "_descend", lambda *a: seen.append((a[1], a[5:])) or plain(*a))
    copies = [(i, " ".join(f"w{(j * j * 31 + (i if j % 29 == 0 else 0)) % 997}" for j in range(60))) for i in range(12)]
    nd.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert [s for s in seen if s[1] == (nd.TREES,)] == [(nd.further(nd.TREES, 0.8), (nd.TREES,))]
