"""Conversation trie, exact dedup against snapshots, centroid clustering: each against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.llm import centroids, exact_dedup, fuse_filter, prefix_trie, queries
from tidemark.llm.centroids import Pivots, nearest

TURNS = "conv_id long, turn long, role string, text string"


# filters -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter_holds_its_keys_and_few_others(n):
    rnd = np.random.default_rng(n)
    keys = rnd.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    made = fuse_filter.build(np.concatenate([keys, keys[: n // 2]]))
    assert made.may_hold(keys).all()
    others = rnd.integers(-(2**63), 2**63 - 1, 50_000, dtype=np.int64)
    assert made.may_hold(others).mean() < (0.01 if n else 1e-9)
    assert len(made.slots) <= max(64, 1.3 * n * (1.5 if n < 10_000 else 1))


# exact dedup -------------------------------------------------------------------------------


def brute_copies(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and how many rows of each text stay."""
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = [(i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=repr), dict.fromkeys(groups, 1)


def copies(df):
    rows = df.withColumn("sha", F.lower(F.hex("digest"))).collect()
    kept = {}
    for r in rows:
        kept[r["sha"]] = kept.get(r["sha"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["sha"]) for r in rows), key=repr), kept


def some_texts():
    rnd = random.Random(3)
    pool = ["", None, "a", "A", "a ", " a", "é", "é", "x" * 300_000, *(f"text {i}" for i in range(60))]
    return [(rnd.choice([None, *range(150)]), rnd.choice(pool)) for _ in range(300)] + [(900 + i, "hot") for i in range(150)] + [(7, "twice"), (7, "twice"), (None, "no id"), (None, "no id")]


def test_exact_dedup_matches_brute_force(spark):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "key": F.lit("k"), "row": F.lit(2), "batch": F.lit(3), "n": F.lit(0)})
    got, kept = copies(exact_dedup.dedup(docs))
    want, texts = brute_copies(rows)
    assert got == want
    assert set(kept.values()) == {1} and len(kept) == len(texts)


def test_equal_digests_of_different_texts_are_told_apart(spark):
    """With a digest of three values all texts collide, within batches and with snapshots."""
    rows = some_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda text: F.encode(F.pmod(F.xxhash64(text), F.lit(3)).cast("string"), "utf-8")
    got = exact_dedup.dedup(docs, batches=4, digest=weak).collect()
    want = sorted(((i, k, n) for i, k, n, _ in brute_copies(rows)[0]), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == len({t or "" for _, t in rows})


def test_a_batch_meets_earlier_snapshots(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "b"), (5, "c"), (6, "c")], "doc_id long, text string")
    _, one = exact_dedup.ingest(first, keep=staging.new_path(spark, "snapshot"))
    members, two = exact_dedup.ingest(second, [one], keep=staging.new_path(spark, "snapshot"))
    assert members.count() == 3
    texts = lambda s: sorted(r["text"] for r in spark.read.parquet(f"{s.path}/texts").collect())
    assert texts(one) == ["a", "b"] and texts(two) == ["c"]  # a snapshot holds what no earlier one does
    fresh = spark.createDataFrame([(9, "b"), (9, "c"), (9, "new")], "doc_id long, text string")
    hits = exact_dedup.screen(exact_dedup._named(fresh, "doc_id", "text", exact_dedup.sha256).select("digest", "key"), 3, two)
    assert {bytes(r["digest"]).hex() for r in hits.collect()} >= {hashlib.sha256(b"c").hexdigest()}


def test_exact_dedup_of_no_rows_and_the_registered_query(spark, no_docs, odd_docs, tmp_path):
    assert exact_dedup.dedup(no_docs).count() == 0
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = queries.QUERIES["op12_exact_dedup"](spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_copies(rows)[0]
    assert sum(r["kept"] for r in got) == len({t or "" for _, t in rows})


# conversation trie --------------------------------------------------------------------------


def order_of_ties(role, text):
    h = xxhash.xxh64(text.encode(), seed=xxhash.xxh64(role.encode(), seed=42).intdigest()).intdigest()
    return h - 2**64 if h >= 2**63 else h


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, order_of_ties(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    below = {k: [0, 0] for k in nodes}
    kids = {k: sum(1 for n in nodes if len(n) == len(k) + 1 and n[: len(k)] == k) for k in nodes}
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += (len(members) - 1) * words(k[-1][1]) if k else 0
            below[k[:d]][1] += kids[k] == 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], below[k][1], below[k][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def some_conversations(convs=90, longest=23, seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-30, convs), 10**12]:
        own = rnd.choice([rows[-4:], []]) if rows else []
        n = rnd.randrange(0, longest)
        texts = [rnd.choice(["yes", "no thanks", "", None]) for _ in range(n)] if c % 3 else [t[3] for t in own] + ["tail"] * rnd.randrange(4)
        rows += [(c, rnd.choice([i, i, i, None]) if c % 7 == 0 else i, rnd.choice(["user", "bot", None]) if c % 5 == 0 else "user", t) for i, t in enumerate(texts)]
    same = [(c, i, "user", f"hot {i}") for c in range(200, 260) for i in range(9)]
    return rows + same + [(None, 0, "user", "nobody"), (300, 0, "u", "once"), (300, 0, "u", "once"), (301, 1, "u", "word " * 30_000)]


@pytest.mark.parametrize("block", [3, 4096])
def test_prefix_trie_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = some_conversations(convs=60 if block == 4096 else 30)
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({"d": F.lit(1), "len": F.lit(2), "words": F.lit(3), "rn": F.lit("x")})
    assert trie(prefix_trie.prefix_trie(df)) == brute_trie(rows)


def test_two_fattest_depths(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)] + [(0, 2**40), (2**40 - 1, 2**40 + 5)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.two_fattest("a", "b").alias("f")).collect()
    for r in got:
        i = (r["a"] ^ r["b"]).bit_length() - 1
        assert r["f"] == (r["b"] >> i) << i and r["a"] < r["f"] <= r["b"]


def test_fat_binary_search_finds_where_a_sequence_leaves_the_trie(spark):
    inside = {1: "abcdefgh", 2: "abcx", 3: "abcdefghijklmnop"}
    asked = {4: "abcdefghijk", 5: "abq", 6: "zz", 7: "abcdefghijklmnopqrs", 8: "abcx", 9: "abcy"}
    rows = [(c, d, ord(t), ord(t), 1) for c, s in {**inside, **asked}.items() for d, t in enumerate(s, 1)]
    held = prefix_trie.stage(prefix_trie.blocks(spark.createDataFrame(rows, "conv_id long, d long, t1 long, t2 long, words long")), "blocks")
    last = held.select("conv_id", F.element_at("hs", -1).alias("e")).select("conv_id", "e.h1", "e.h2", F.col("e.d").alias("len"), F.lit(1).alias("members"))
    old = last.where(F.col("conv_id").isin(*inside))
    nodes = prefix_trie.new_nodes(old, held, None).distinct()
    known = prefix_trie.handles(prefix_trie.edges(prefix_trie.paths(old, held, nodes)), held)
    got = {r["conv_id"]: r["l"] for r in prefix_trie.locate(last.where(F.col("conv_id").isin(*asked)), held, known).collect()}
    assert got == {4: 11, 5: 2, 6: 0, 7: 16, 8: 4, 9: 3}


def test_prefix_trie_of_no_turns_and_the_registered_query(spark, tmp_path):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).count() == 0
    # With crc32("21") % 4 turns taken from a leader that is absent, this conversation has none of its own.
    lone = [(c, 0, "u", "t") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:2]
    assert trie(prefix_trie.prefix_trie(spark.createDataFrame(lone, TURNS))) == brute_trie(lone)
    rows = some_conversations(20, 8, seed=9)
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert trie(queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute_trie(rows)


# centroids ----------------------------------------------------------------------------------


def brute_clusters(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes())
    centres = [v for _, v in sorted(kept, key=rank)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    inertia = {j: sum(d for d, c in at if c == j) for j in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), names[c]) for (i, _), (d, c) in zip(kept, at)), key=repr)


def some_vectors(n=160):
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.integers(0, 4) * 0.7 + rnd.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(n)]
    grid = [(1000 + i, [float(i % 3)] * 64) for i in range(30)]  # many ties
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] * 64), (2005, [None] + [0.0] * 63), (None, [0.5] * 64), (3, [0.25] * 64), (3, [0.25] * 64)]
    return rows + grid + odd


def clusters(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_clusters_match_brute_force(spark, tmp_path):
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6).withColumns({"vector": F.lit(1), "near": F.lit(2), "rank": F.lit(3), "x": F.lit(4)})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert clusters(queries.QUERIES["op13_centroids"](spark, str(tmp_path))) == brute_clusters(rows)


def test_clusters_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, [0.5] * 64)], [(i, [1.5] * 64) for i in range(20)], [(i, [float(i)] * 64) for i in range(3)]):
        assert clusters(centroids.cluster(spark.createDataFrame(rows, schema))) == brute_clusters(rows)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema)).collect()


@pytest.mark.parametrize("spread", [1, 50, 10_000, (1 << 26)])
def test_ptolemaic_bounds_never_rule_out_the_nearest(spread):
    rnd = np.random.default_rng(spread)
    centre = rnd.integers(-spread, spread + 1, (8, 64))
    vectors = centre[rnd.integers(0, 8, 3000)] + rnd.integers(-max(spread // 8, 1), max(spread // 8, 1) + 1, (3000, 64))
    pivots = Pivots.of(centre[::-1].copy())
    near = pivots.distances(vectors)
    exact = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centre], axis=1)
    bounds = pivots.bounds(near, centre)
    assert (bounds <= np.sqrt(exact.astype(float)) * (1 + 1e-12)).all()
    chosen, far, measured = nearest(vectors, near, centre, pivots)
    assert (chosen == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert measured < exact.size / 2 or spread == 1  # bounds spare most exact distances
