"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles.  Documents with the same set are one class; the join runs over classes.  ``TREES``
independent trees branch the classes: at a node a pseudorandom choice selects one minwise token function, or two (with
probability 1 / threshold - 1), and a class goes to the child of each selected minwise token it
holds.  Small nodes are compared exhaustively; large ones branch again.  Comparison in a node is by the ``TOKENS``
minwise tokens, then by four bits each of ``BITS_OF`` minwise tokens, and by the set sizes, with margins of four deviations;
what passes is confirmed on the full sets.

What is asked for are components, so the join runs twice.  A first, cheap pass over few trees keeps of a small node only
the likeliest spanning links, and of a large node those to about ``PIVOTS`` pivots; confirmed, they merge most of every group
of copies.  The second pass over all trees looks at links between different components only.  A node counts as small
there if at most ``OUTSIDE`` of its members lie outside its largest component, however large that is: these are
compared with all members, in slices.  A node still large at the last level is compared whole, in blocks, so nothing is
capped.  No task ever holds a group, and no group is expanded into all its pairs: a pair that meets in several nodes of a level is
looked at in the least of them only, and what passes the sketches stays in its cell (a slice of askers and a slice of members,
at most ``SLICE`` each), to which the full sets of these members come.  There they are compared, likeliest first and only
while their components differ, so a cell gives fewer links than it has members, however many pairs are refuted in it.

A tree misses a pair at the threshold with a chance of 0.16 where nodes are small after one branching, 0.36 after three and 0.59
after eight.  Classes that pass through a node still large after ``SURE`` levels therefore get ``further`` trees, so many that the
chance to miss a pair in all trees is at every depth at most that of ``TREES`` trees of ``SURE`` levels (below 0.001); pairs
of equal sets are never missed.

Defined results: null and empty texts (and blank ones) have empty sets and are linked with nothing; a text of fewer
words than a shingle is one shingle; a doc_id that repeats with several texts ties its components together only if
their sets are linked; null ids are joined and get the component of the others, or null; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import membership, passes, stage
from tidemark.llm.words import mix, pieces, seeds, shingle_set, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
TREES = 8
FIRST_TREES = 3
TOKENS = 64
BITS_OF = 512
LEVELS = 8
FIRST_LEVELS = 2
PIVOTS = 16
SURE = 3
LEAF = 48
OUTSIDE = 1024
SLICE = 256
_TOKEN_MUL, _TOKEN_ADD = seeds(BITS_OF, 41), seeds(BITS_OF, 42)


def _class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def minwise(shingles: np.ndarray) -> bytes:
    """The first ``TOKENS`` minwise tokens of a set (32 bits each), then four bits of each of the ``BITS_OF`` tokens."""
    out = np.full(BITS_OF, ~np.uint64(0))
    for low in range(0, len(shingles), 256):
        part = shingles[low : low + 256, None] * _TOKEN_MUL
        part += _TOKEN_ADD
        part ^= part >> np.uint64(32)
        np.minimum(out, part.min(0), out=out)
    out = mix(out)
    bits = (out & np.uint64(15)).astype(np.uint8)
    return (out[:TOKENS] >> np.uint64(32)).astype(np.uint32).tobytes() + (bits[::2] | bits[1::2] << 4).tobytes()


def _sets(batch_column: pa.Array, k: int):
    hashes, first = word_hashes(batch_column)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        yield shingle_set(hashes[low:high], k)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, c`` (class of the set), ``n`` (its size) and ``sig`` (its minwise tokens)."""

    def sign(batches):
        for batch in pieces(batches, 1024):
            c, n, sig = [], [], []
            for s in _sets(batch.column(1), k):
                n.append(len(s))
                c.append(_class_id(s))
                sig.append(minwise(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "c", "n", "sig"])

    return docs.mapInArrow(sign, "doc_id long, c long, n long, sig binary")


def _signs(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens and packed bits of each row."""
    raw = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), 4 * TOKENS + BITS_OF // 2)
    return np.ascontiguousarray(raw[:, : 4 * TOKENS]).view(np.uint32), raw[:, 4 * TOKENS :]


# ---- branching ----------------------------------------------------------------------------------------------------


def miss(levels: int, similarity: float) -> float:
    """The chance that a pair of this similarity does not meet after ``levels`` branchings of one tree."""
    second, out = min(1 / similarity - 1, 1.0), 0.0
    for _ in range(levels):
        one_way = 1 - similarity + similarity * out
        out = (1 - second) * one_way + second * one_way**2
    return out


def further(trees: int, similarity: float) -> int:
    """How many more trees give classes of ``LEVELS`` levels the recall of ``trees`` trees of ``SURE`` levels."""
    if similarity >= 1:
        return 0
    return max(0, int(np.ceil(trees * np.log(miss(SURE, similarity)) / np.log(miss(LEVELS, similarity)))) - trees)


def branched(rows: DataFrame, level: int, trees: int, similarity: float, base: int = 0) -> DataFrame:
    """The children (``node, tree, c, label``) of rows ``node, tree, c, label, sig``; at level 1 rows have no node and belong to all roots."""
    second = np.uint64(min(1 / similarity - 1, 1.0) * 2**32)

    def branch(batches):
        for batch in pieces(batches, 4096):
            names = batch.schema.names
            rows = batch.num_rows
            if not rows:
                continue
            sig, _ = _signs(batch.column(names.index("sig")).to_pylist())
            c, label = (batch.column(names.index(x)).to_numpy() for x in ("c", "label"))
            if level == 1:
                tree = np.repeat(np.arange(base, base + trees, dtype=np.int64), rows)
                at, node = np.tile(np.arange(rows), trees), mix(tree.astype(np.uint64) + np.uint64(99))
            else:
                tree = batch.column(names.index("tree")).to_numpy().astype(np.int64)
                at, node = np.arange(rows), batch.column(names.index("node")).to_numpy().view(np.uint64)
            choice = mix(node + np.uint64(level))
            out = []
            for way, go in ((0, np.ones(len(node), bool)), (1, (choice >> np.uint64(32)) < second)):
                function = (choice + np.uint64(way * 29 + 1)) % np.uint64(TOKENS)
                child = mix(node ^ mix((function << np.uint64(32)) + sig[at, function.astype(np.int64)] + np.uint64(7)))
                out.append((child[go], tree[go], at[go]))
            child, tree, at = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(tree.astype(np.int32)), pa.array(c[at]), pa.array(label[at])], ["node", "tree", "c", "label"])

    return rows.mapInArrow(branch, "node long, tree int, c long, label long")


# ---- comparison inside nodes --------------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Which links make up a spanning forest, likeliest first."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i in np.argsort(-likely, kind="stable").tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _first_common(nodes: list[np.ndarray], i: np.ndarray, others: list[np.ndarray], j: np.ndarray, node: int) -> np.ndarray:
    """Whether ``node`` is the least node that ``nodes[i]`` and ``others[j]`` share, for each pair."""
    width = max(1, *(len(x) for x in nodes), *(len(x) for x in others))
    none = np.iinfo(np.int64).max
    a, b = (np.array([np.pad(x, (0, width - len(x)), constant_values=none) for x in side]) for side in (nodes, others))
    out, step_ = np.empty(len(i), bool), max(1, (1 << 22) // width**2)
    for k in range(0, len(i), step_):
        x, y = a[i[k : k + step_]], b[j[k : k + step_]]
        out[k : k + step_] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, none).min(1) == node
    return out


def _unpack(cells) -> tuple[np.ndarray, ...]:
    return (*(np.array([x[k] for x in cells], np.int64) for k in ("c", "label", "n")), *_signs([x["sig"] for x in cells]))


def _equal_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many four-bit fields the rows of ``x`` and ``y`` agree."""
    z = x ^ y
    return (z & 15 == 0).sum(1) + (z & 240 == 0).sum(1)


def _alike(similarity: float):
    """A function of the askers and members of a cell: which pairs pass the sketches (``i, j``), and their equal bits."""

    def least(n: int, share: float) -> int:
        return int(np.ceil(n * share - 4 * np.sqrt(n * share * (1 - share))))

    least_tokens, least_bits = least(TOKENS, similarity), least(BITS_OF, similarity + (1 - similarity) / 16)

    def alike(askers: tuple[np.ndarray, ...], members: tuple[np.ndarray, ...]):
        (c, label, n, sig, bits), (d, label_d, m, sig_d, bits_d) = askers, members
        same = np.empty((len(c), len(d)), np.int64)
        for i in range(len(c)):
            same[i] = (sig_d == sig[i]).sum(1)
        fits = (same >= least_tokens) & (label[:, None] != label_d) & (c[:, None] != d)
        fits &= np.minimum(n[:, None], m) >= similarity * np.maximum(n[:, None], m) - 1e-9
        i, j = np.nonzero(fits)
        equal = np.concatenate([np.empty(0, np.int64), *(_equal_bits(bits[i[k : k + 8192]], bits_d[j[k : k + 8192]]) for k in range(0, len(i), 8192))])
        some = equal >= least_bits
        return i[some], j[some], equal[some]

    return alike


def _met(rows: DataFrame, *more: str) -> DataFrame:
    """``node, block, piece, askers, pool`` of rows ``node, c, label, n, sig, ask, asking, members``: those that ask beside all of their node.

    ``asking`` and ``members`` are the numbers of such rows; both sides are cut into blocks of bounded size.
    """
    cell = F.struct("c", "label", "n", "sig", *more)
    block = F.pmod(F.xxhash64("c"), F.ceil(F.col("asking") / SLICE))
    piece = F.pmod(F.xxhash64("c"), F.ceil(F.col("members") / SLICE))
    askers = rows.where("ask").groupBy("node", block.alias("block")).agg(F.collect_list(cell).alias("askers"))
    pool = rows.groupBy("node", piece.alias("piece")).agg(F.collect_list(cell).alias("pool"))
    return askers.join(pool, "node").select("node", "block", "piece", "askers", "pool")


def spanning(rows: DataFrame, similarity: float) -> DataFrame:
    """The likeliest spanning links ``a < b`` of each cell, not yet confirmed."""
    alike = _alike(similarity)

    def compare(batches):
        for batch in batches:
            left, right = [], []
            for askers, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                askers, members = _unpack(askers), _unpack(members)
                i, j, equal = alike(askers, members)
                c, d = askers[0][i], members[0][j]
                keep = _forest(c, d, equal)
                left.append(np.minimum(c, d)[keep])
                right.append(np.maximum(c, d)[keep])
            a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _met(rows).select("askers", "pool").mapInArrow(compare, "a long, b long").distinct()


_LISTS = pa.list_(pa.int64())


def suspects(rows: DataFrame, similarity: float) -> DataFrame:
    """``node, block, piece, c, label, partners, likely``: per cell its members that full sets must decide about.

    An asker lists its ``partners`` in the cell; members that only answer have an empty list.  ``rows`` have, too, the ``nodes``
    of their class in which pairs are compared.
    """
    alike = _alike(similarity)

    def compare(batches):
        for batch in batches:
            for node, block, piece, askers, members in zip(*(x.to_pylist() for x in batch.columns)):
                nodes, others = ([np.array(x["nodes"], np.int64) for x in side] for side in (askers, members))
                answers = np.array([x["ask"] for x in members])
                askers, members = _unpack(askers), _unpack(members)
                i, j, equal = alike(askers, members)
                c, d = askers[0], members[0]
                once = ~answers[j] | (c[i] < d[j])  # two that ask each other are told once
                i, j, equal = i[once], j[once], equal[once]
                first = _first_common(nodes, i, others, j, node)
                i, j, equal = i[first], j[first], equal[first]
                if not len(i):
                    continue
                cuts = np.searchsorted(i, np.arange(len(c) + 1))  # i is in order
                asks = np.flatnonzero(np.diff(cuts))
                quiet = np.setdiff1d(d[j], c[asks])
                label = dict(zip(np.concatenate([c, d]).tolist(), np.concatenate([askers[1], members[1]]).tolist()))
                ids = np.concatenate([c[asks], quiet])
                none: list = [[]] * len(quiet)
                partners = [d[j[cuts[k] : cuts[k + 1]]] for k in asks] + none
                likely = [equal[cuts[k] : cuts[k + 1]] for k in asks] + none
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(len(ids), x, np.int64)) for x in (node, block, piece)), pa.array(ids), pa.array([label[x] for x in ids.tolist()], pa.int64()), pa.array(partners, _LISTS), pa.array(likely, _LISTS)],
                    ["node", "block", "piece", "c", "label", "partners", "likely"],
                )

    schema = "node long, block long, piece long, c long, label long, partners array<long>, likely array<long>"
    return _met(rows, "nodes", "ask").mapInArrow(compare, schema)


def _descend(classes: DataFrame, trees: int, levels: int, similarity: float, first: bool, base: int = 0) -> tuple[list[DataFrame], list[DataFrame]]:
    """Candidates of one pass (pairs of the first, suspects of the second), a written table per level, and the classes (``c``) in
    nodes still large after ``SURE`` levels.

    ``classes`` has ``c, n, sig, label``; trees are numbered from ``base``.
    """
    found, deep, rows = [], [], branched(classes.select("c", "label", "sig"), 1, trees, similarity, base)
    key = F.xxhash64("c", "node")
    for level in range(1, levels + 1):
        rows = rows.distinct() if level > 1 else rows
        if first:
            sized = rows.groupBy("node").agg(F.count("*").alias("members"), F.min(key).alias("main")).where("members > 1")
            small = F.col("members") <= LEAF
            chance = F.pmod(F.xxhash64(F.lit(1), "c", "node"), F.lit(1 << 20)) * F.col("members") < PIVOTS * (1 << 20)
            ask, asking = small | chance | (key == F.col("main")), F.when(small, F.col("members")).otherwise(PIVOTS)
        else:
            by_label = rows.groupBy("node", "label").count()
            sized = (
                by_label.groupBy("node")
                .agg(F.sum("count").alias("members"), F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels"))
                .where("labels > 1")
                .select("node", "members", F.col("top.label").alias("main"), (F.col("members") - F.col("top.count")).alias("outside"))
            )
            small = F.col("outside") <= OUTSIDE if level < levels else F.lit(True)
            ask, asking = F.col("label") != F.col("main"), F.col("outside")
        nodes = rows.join(sized, "node").select("node", "tree", "c", "label", "members", small.alias("small"), ask.alias("ask"), asking.cast("long").alias("asking"))
        if not first:
            nodes = nodes.withColumn("nodes", F.collect_list(F.when(F.col("small"), F.col("node"))).over(Window.partitionBy("c")))
        seen = Observation()
        full = stage(nodes.join(classes.select("c", "n", "sig"), "c").observe(seen, F.count(F.when(~F.col("small"), 1)).alias("large")), f"nodes-{level}")
        found.append(stage(spanning(full, similarity) if first else suspects(full.where("small"), similarity), f"pairs-{level}"))
        if level == levels or not seen.get["large"]:
            break
        large = full.where("not small")
        if level >= SURE:
            deep.append(large.select("c"))
        rows = branched(large.select("node", "tree", "c", "label", "sig"), level + 1, trees, similarity)
    return found, deep


# ---- confirmation -------------------------------------------------------------------------------------------------


def _sets_of(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``c, items``: the full sets of the wanted classes."""
    holders = classes.join(wanted, "c", "left_semi").select(F.xxhash64("least").alias("h"))
    bitmap = docs.sparkSession.sparkContext.broadcast(membership(holders, "h"))

    def read(batches):
        for batch in pieces(batches, 1024):
            h = batch.column(2).to_numpy().view(np.uint64)
            some = batch.take(pa.array(passes(bitmap.value, h)))
            if not some.num_rows:
                continue
            made = list(_sets(some.column(1), k))
            yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], ["c", "items"])

    sets = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(read, "c long, items binary").dropDuplicates(["c"])
    return stage(sets, "sets")


def _linked(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= share * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (``a, b``) whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    sets = _sets_of(wanted, docs, classes, k)
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("items").alias("y")), "b")
    share = round(100 * similarity)

    def check(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def confirmed_in_cells(cells: DataFrame, docs: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (``a, b``) that join the components of each cell of ``suspects`` as all of its similar enough pairs would."""
    sets = _sets_of(cells.select("c").distinct(), docs, classes, k)
    share = round(100 * similarity)

    def check(cell: pa.Table) -> pa.Table:
        c, label, likely, partners = (cell[x].to_pylist() for x in ("c", "label", "likely", "partners"))
        items = {x: np.frombuffer(s.as_py(), np.uint64) for x, s in zip(c, cell["items"])}
        root = {x: x for x in label}
        of = dict(zip(c, label))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for _, a, b in sorted(((-e, a, b) for a, bs, es in zip(c, partners, likely) for b, e in zip(bs, es))):
            x, y = find(of[a]), find(of[b])
            if x != y and _linked(items[a], items[b], share):
                root[x] = y
                links.append((min(a, b), max(a, b)))
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.join(sets, "c").groupBy("node", "block", "piece").applyInArrow(check, "a long, b long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, trees: int = TREES) -> DataFrame:
    """Per document row ``doc_id, n_shingles, component_id`` (least doc_id reachable through links) and ``kept``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(signed(docs, shingle), "signed")
    classes = stage(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    plain = classes.withColumn("label", F.col("c"))
    for first in (True, False):
        if not first:
            roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
            plain = stage(classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select(*classes.columns, F.coalesce("root", "c").alias("label")), "labelled")
        found, deep = _descend(plain, min(FIRST_TREES, trees) if first else trees, FIRST_LEVELS if first else LEVELS, similarity, first)
        if deep and further(trees, similarity):
            found += _descend(plain.join(_union(deep).distinct(), "c", "left_semi"), further(trees, similarity), LEVELS, similarity, False, trees)[0]
        if first:
            edges = stage(confirmed(stage(_union(found).distinct(), "pairs"), docs, classes, shingle, similarity), "links")
        elif not (cells := _union(found)).isEmpty():
            edges = edges.unionByName(stage(confirmed_in_cells(cells, docs, classes, shingle, similarity), "links"))
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "c")
    tied = classes.select("c", "least").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of = tied.join(least, "root").select("c", "component_id")
    id_ = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(of, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), id_.alias("component_id"), F.coalesce(id_ == F.col("doc_id"), F.lit(False)).alias("kept")
    )
