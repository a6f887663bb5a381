"""The prefix trie of conversations, as a z-fast trie whose nodes are rows.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first turns, known by a 128-bit hash
and its depth.  Only *compacted* nodes are stored: ends of conversations and prefixes where conversations part.  Each
stands for an edge, the depths after its parent up to its own.  Its *handle* is the prefix whose depth is the
two-fattest number on that edge (the one divisible by the largest power of two).

Conversations enter in batches.  One of length L finds where it leaves the trie by fat binary search: in the interval
of depths still open it asks for the handle at the two-fattest depth, goes below that node if there is one and above
it otherwise, so it asks about log2(L) times, all conversations of a batch at once in one join.  Its prefix hashes are then compared with the
edge it leaves on; the rest of it is new.  Prefixes of these rests where the batch parts, the points where edges are
left, and the ends become new nodes.  At the end edges are expanded, one row per depth.

Prefix hashes lie in blocks of at most ``BLOCK`` depths, so no row, group or task grows with the longest conversation.
Equal conversations enter once, with a count.  Counts, leaves and savings of nodes are sums over the conversations
that pass them, by the smallest conversation that owns each edge.

Defined results: rows without ``conv_id`` belong to no conversation; a null turn comes first, rows of equal turn come
in the order of a hash of role and text, repeated rows are turns of their own; null roles and texts count as empty;
other columns are ignored.  A conversation without turns is a member of the root.  An empty table gives no rows.
Digests of member ids need them in one sequence: a group's ids stream through one task, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stage
from tidemark.plans.series import index_rows

BLOCK = 4096
#: The share of sequences that enters in the first batch; the rest enters in one more batch.
BATCHES = (1, 4)
STEPS_PER_STAGE = 4
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = ["h1", "h2", "d"]


# sequences --------------------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Turns with their position ``rn``: identity ``t1, t2`` (hashes of role and text) and ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return index_rows(rows, ["conv_id"], ["turn", "t1", "t2"], "turns").drop("turn")


def rebuild(turns: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Sequences ``conv_id, d, t1, t2, words`` (``d`` from 1), and all conversations with their new length ``len``.

    A conversation takes its group leader's first ``crc32(id) % shared`` turns in place of as many of its own.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % shared
    convs = turns.where("rn = 0").select("conv_id", "n", h.alias("h"), (c - c % group).alias("leader"))
    leaders = convs.where("conv_id = leader").select("leader", F.col("n").alias("leader_n"))
    convs = convs.join(leaders, "leader", "left").withColumn("taken", F.least("h", F.coalesce("leader_n", F.lit(0))))
    convs = stage(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where((F.col("rn") < shared) & (c % group == 0)).drop("n").withColumnRenamed("conv_id", "leader")
    theirs = convs.join(heads, "leader").where("rn < taken").select("conv_id", (F.col("rn") + 1).alias("d"), "t1", "t2", "words")
    # A long conversation meets its facts block by block, not as one key.
    at = F.expr(f"rn div {BLOCK}").alias("at")
    facts = convs.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("at"))
    own = turns.select("conv_id", "rn", "t1", "t2", "words", at).join(facts, ["conv_id", "at"]).where("rn >= h")
    return theirs.unionByName(own.select("conv_id", F.expr("rn - h + taken + 1").alias("d"), "t1", "t2", "words")), convs.select("conv_id", "len")


def blocks(sequences: DataFrame) -> DataFrame:
    """Sequences as rows of at most ``BLOCK`` depths: ``conv_id, k, hs`` with, per depth ``d``, the hash ``h1, h2`` of the
    first ``d`` turns, that of its parent ``p1, p2``, its words and the words up to it ``w``.

    The hash of a prefix is the exclusive or of its turns' hashes, each mixed with its depth.
    """
    rows = sequences.select(
        "conv_id", F.expr(f"(d - 1) div {BLOCK}").alias("k"), "d", "words",
        F.xxhash64("t1", "t2", "d", F.lit(1)).alias("g1"), F.xxhash64("t1", "t2", "d", F.lit(2)).alias("g2"),
    )
    place = ["conv_id", "k"]
    rows = stage(rows.repartition(*place), "turn-hashes")
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"c1": F.bit_xor("g1"), "c2": F.bit_xor("g2"), "cw": F.sum("words")}
    carry = rows.groupBy(*place).agg(*(v.alias(n) for n, v in sums.items()))
    carry = carry.select(*place, F.bit_xor("c1").over(before).alias("c1"), F.bit_xor("c2").over(before).alias("c2"), F.sum("cw").over(before).alias("cw"))
    upto = Window.partitionBy(*place).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    rows = rows.join(carry, place).select(
        *place, "d", "words", "g1", "g2",
        F.bit_xor("g1").over(upto).bitwiseXOR(F.coalesce("c1", zero)).alias("h1"),
        F.bit_xor("g2").over(upto).bitwiseXOR(F.coalesce("c2", zero)).alias("h2"),
        (F.sum("words").over(upto) + F.coalesce("cw", zero)).alias("w"),
    )
    one = F.struct("d", "h1", "h2", F.col("h1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("g2")).alias("p2"), "words", "w")
    return rows.groupBy(*place).agg(F.sort_array(F.collect_list(one)).alias("hs"))


# the trie ---------------------------------------------------------------------------------


def two_fattest(low: str, high: str) -> Column:
    """The number in ``(low, high]`` divisible by the largest power of two."""
    bits = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {bits}), {bits})")


def _block_of(depth: str) -> Column:
    return F.expr(f"({depth} - 1) div {BLOCK}")


def _at(rows: DataFrame, held: DataFrame, conv: str, depth: str, as1: str, as2: str) -> DataFrame:
    """Add the hash of the first ``depth`` turns of conversation ``conv``; NULL where it has fewer."""
    found = held.select(F.col("conv_id").alias("_c"), F.col("k").alias("_k"), "hs")
    out = rows.withColumn("_b", _block_of(depth)).join(found, (F.col(conv) == F.col("_c")) & (F.col("_b") == F.col("_k")), "left")
    it = F.get("hs", (F.col(depth) - 1 - F.col("_b") * BLOCK).cast("int"))
    return out.withColumns({as1: it["h1"], as2: it["h2"]}).drop("_b", "_c", "_k", "hs")


def paths(sequences: DataFrame, held: DataFrame, nodes: DataFrame) -> DataFrame:
    """The compacted nodes that each sequence passes, with the node before (``par_*``, the root's depth is 0)."""
    rows = held.join(sequences.select("conv_id", "len", "members"), "conv_id").select("conv_id", "len", "members", F.inline("hs"))
    rows = rows.join(nodes.select(*NODE), NODE).select("conv_id", "len", "members", *NODE, "w")
    before = F.lag(F.struct("h1", "h2", "d", "w")).over(Window.partitionBy("conv_id").orderBy("d"))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("_p", before)
    return rows.withColumns({f"par_{c}": F.coalesce(F.col("_p")[c], zero) for c in ("h1", "h2", "d", "w")}).drop("_p")


def edges(path: DataFrame) -> DataFrame:
    """One row per compacted node: members ``n``, the smallest of them ``owner``, the longest, and its parent."""
    parent = [F.min(c).alias(c) for c in ("w", "par_h1", "par_h2", "par_d", "par_w")]
    return path.groupBy(*NODE).agg(F.sum("members").alias("n"), F.min("conv_id").alias("owner"), F.max("len").alias("deepest"), *parent)


def handles(edge: DataFrame, held: DataFrame) -> DataFrame:
    """Edges with the hash at their handle's depth (``f, f1, f2``) and that of their first turn (``c, c1, c2``)."""
    rows = edge.withColumn("f", two_fattest("par_d", "d")).withColumn("c", F.col("par_d") + 1)
    return _at(_at(rows, held, "owner", "f", "f1", "f2"), held, "owner", "c", "c1", "c2")


def locate(sequences: DataFrame, held: DataFrame, trie: DataFrame) -> DataFrame:
    """``conv_id, l``: how many first turns of each sequence the trie (edges with handles) already holds."""
    longest = sequences.agg(F.max("len")).first()[0] or 0
    state = sequences.select(
        "conv_id", "len", F.lit(0).cast("long").alias("a"), F.col("len").alias("b"),
        F.lit(None).cast("long").alias("owner"), F.lit(None).cast("long").alias("lo"),
    )
    asked = trie.select(F.col("f").alias("_f"), F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.col("d").alias("_d"), F.col("owner").alias("_o"), F.col("par_d").alias("_p"))
    for step in range(int(longest).bit_length()):
        state = state.withColumn("f", F.when(F.col("a") < F.col("b"), two_fattest("a", "b")))
        state = _at(state, held, "conv_id", "f", "x1", "x2")
        state = state.join(asked, (F.col("f") == F.col("_f")) & (F.col("x1") == F.col("_1")) & (F.col("x2") == F.col("_2")), "left")
        found, open_ = F.col("_d").isNotNull(), F.col("f").isNotNull()
        state = state.select(
            "conv_id", "len",
            F.when(found, F.col("_d")).otherwise(F.col("a")).alias("a"),
            F.when(open_ & ~found, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            F.coalesce("_o", "owner").alias("owner"), F.coalesce("_p", "lo").alias("lo"),
        )
        if step % STEPS_PER_STAGE == STEPS_PER_STAGE - 1:
            state = stage(state, "search")
    # ``a`` is the depth of the deepest node whose handle matched.  If all of it matches, the edge
    # left is that of its child by the next turn; otherwise it is the node's own.
    state = _at(state.withColumn("c", F.col("a") + 1), held, "conv_id", "c", "x1", "x2")
    child = trie.select(F.col("c").alias("_c"), F.col("c1").alias("_1"), F.col("c2").alias("_2"), F.col("d").alias("_d"), F.col("owner").alias("_o"))
    state = state.join(child, (F.col("c") == F.col("_c")) & (F.col("x1") == F.col("_1")) & (F.col("x2") == F.col("_2")), "left")
    below = F.col("_d").isNotNull()
    exits = state.select(
        "conv_id", F.coalesce("_o", "owner").alias("owner"),
        F.when(below, F.col("a")).otherwise(F.coalesce("lo", F.lit(0).cast("long"))).alias("lo"),
        F.least("len", F.when(below, F.col("_d")).otherwise(F.col("a"))).alias("hi"),
    )
    return _common(stage(exits, "exits"), held)


def _common(exits: DataFrame, held: DataFrame) -> DataFrame:
    """Depths of ``(lo, hi]`` at which a sequence and the owner of the edge have equal prefixes, added to ``lo``."""
    asked = exits.where("owner is not null and hi > lo").withColumn("k", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), _block_of("hi"))))
    theirs = held.select(F.col("conv_id").alias("owner"), "k", F.col("hs").alias("os"))
    both = asked.join(held, ["conv_id", "k"]).join(theirs, ["owner", "k"])
    same = F.zip_with("hs", "os", lambda a, b: (a["d"] > F.col("lo")) & (a["d"] <= F.col("hi")) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"]))
    count = both.groupBy("conv_id").agg(F.sum(F.size(F.filter(same, lambda x: x))).alias("same"))
    return exits.join(count, "conv_id", "left").select("conv_id", (F.col("lo") + F.coalesce("same", F.lit(0))).cast("long").alias("l"))


def new_nodes(sequences: DataFrame, held: DataFrame, known: DataFrame | None) -> DataFrame:
    """Nodes a batch adds: its ends, where it leaves edges, and where its new parts separate.  ``known``: see ``locate``."""
    if known is None:
        tails = held.join(sequences.select("conv_id"), "conv_id").withColumn("l", F.lit(0).cast("long"))
    else:
        tails = held.join(known, "conv_id")
    tails = tails.where(F.col("l") < F.element_at("hs", -1)["d"]).select("l", F.inline("hs")).where("d > l and d > 1")
    child = F.struct("h1", "h2")
    parts = (F.max(F.col("d") - 1 == F.col("l"))) | (F.min(child) != F.max(child))
    forks = tails.groupBy(F.col("p1").alias("_1"), F.col("p2").alias("_2"), (F.col("d") - 1).alias("_d")).agg(parts.alias("node"))
    forks = forks.where("node").select(F.col("_1").alias("h1"), F.col("_2").alias("h2"), F.col("_d").alias("d"))
    return forks.unionByName(sequences.select("h1", "h2", F.col("len").alias("d")))


def build(sequences: DataFrame, held: DataFrame) -> DataFrame:
    """The compacted nodes of distinct sequences (``conv_id, len, h1, h2, members``), entered in batches."""
    batch = F.when(F.pmod(F.xxhash64("h1", "h2"), F.lit(BATCHES[1])) < BATCHES[0], 0).otherwise(1)
    numbered = stage(sequences.withColumn("batch", batch), "sequences")
    nodes, inside = None, None
    for b in range(2):
        entering = numbered.where(F.col("batch") == b)
        known = None
        if nodes is not None:
            trie = stage(handles(edges(paths(inside, held, nodes)), held), "trie")
            known = locate(entering, held, trie)
        added = new_nodes(entering, held, known)
        nodes = stage((added if nodes is None else nodes.unionByName(added)).distinct(), "nodes")
        inside = entering if inside is None else inside.unionByName(entering)
    return nodes


# what is asked of the nodes -----------------------------------------------------------------


def digests(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """SHA-256 of each group's values in ascending order, comma-joined, streamed in constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            *held, values = (c.to_pylist() for c in batch.columns)
            for key, v in zip(zip(*held), values):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(str(v).encode())
                else:
                    state.update(b",%d" % v)
            yield _digest_rows(done, keys)
            done = []
        yield _digest_rows(done + ([(*now, state.hexdigest())] if now is not None else []), keys)

    sorted_rows = members.select(*keys, value).repartition(*keys).sortWithinPartitions(*keys, value)
    return sorted_rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", sha256 string")


def _digest_rows(rows: list[tuple], keys: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (len(keys) + 1)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*keys, "sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    rebuilt, convs = rebuild(turn_rows(conversations))
    held = stage(blocks(rebuilt), "blocks")
    last = held.select("conv_id", F.element_at("hs", -1).alias("e")).join(convs, "conv_id").where(F.col("e.d") == F.col("len"))
    ends = stage(last.select("conv_id", F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2"), F.col("len").alias("d")), "ends")
    sequences = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members")).withColumnRenamed("d", "len")
    sequences = stage(sequences, "sequences")
    nodes = build(sequences, held)

    path = stage(paths(sequences, held, nodes), "paths")
    edge = stage(edges(path).withColumn("cost", (F.col("n") - 1) * (F.col("w") - F.col("par_w"))), "edges")
    total = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    everything = edge.agg(F.count(F.when(F.col("par_d") == 0, 1)).alias("children"), F.count(F.when(F.col("deepest") == F.col("d"), 1)).alias("leaves"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost")).first()

    # What lies below a node: for each sequence that passes it, the costs of the edges that sequence owns further down.
    down = Window.partitionBy("conv_id").orderBy(F.desc("d"))
    owned = F.when(F.col("owner") == F.col("conv_id"), F.col("cost")).otherwise(0)
    passing = path.select("conv_id", "len", *NODE).join(edge.select(*NODE, "owner", "cost", "deepest"), NODE)
    passing = passing.withColumns(
        {
            "below": F.coalesce(F.sum(owned).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "leaf": F.first(F.col("deepest") == F.col("len")).over(down).cast("long"),
        }
    )
    sums = passing.groupBy(*NODE).agg(F.sum("below").alias("below"), F.sum("leaf").alias("leaves"))
    children = edge.where("par_d > 0").groupBy(F.col("par_h1").alias("h1"), F.col("par_h2").alias("h2"), F.col("par_d").alias("d")).agg(F.count(F.lit(1)).alias("children"))
    hashed = digests(ends, NODE, "conv_id")
    facts = edge.join(sums, NODE).join(children, NODE, "left").join(hashed, NODE, "left")
    parents = edge.select(F.col("h1").alias("par_h1"), F.col("h2").alias("par_h2"), F.col("d").alias("par_d"), F.col("owner").alias("above"))
    facts = facts.where("par_d > 0").join(parents, ["par_h1", "par_h2", "par_d"]).unionByName(facts.where("par_d = 0").withColumn("above", F.lit(total["least"]).cast("long")))

    # Edges are expanded block by block along their owner.
    spread = F.explode(F.sequence(F.expr(f"par_d div {BLOCK}"), _block_of("d")))
    rows = facts.withColumn("k", spread).withColumnsRenamed({"d": "until", "w": "end_w"}).drop("h1", "h2")
    rows = rows.join(held.select(F.col("conv_id").alias("owner"), "k", "hs"), ["owner", "k"])
    inside = F.filter("hs", lambda x: (x["d"] > F.col("par_d")) & (x["d"] <= F.col("until")))
    rows = rows.select(*(c for c in rows.columns if c != "hs"), F.inline(inside))
    top, end = F.col("d") == F.col("par_d") + 1, F.col("d") == F.col("until")
    out = rows.select(
        F.col("owner").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(top, F.col("above")).otherwise(F.col("owner")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("end_w") - F.col("w") + F.col("words")) + F.col("below")).alias("saved_tokens"),
        F.when(end, F.coalesce("sha256", F.lit(EMPTY_SHA256))).otherwise(EMPTY_SHA256).alias("ends_sha256"),
    )
    if not total["n"]:
        return out
    zero = F.lit(0).cast("long")
    turnless = digests(convs.where("len = 0").select(*(zero.alias(c) for c in NODE), "conv_id"), NODE, "conv_id").first()
    root = (total["least"], 0, None, total["n"], everything["children"], everything["leaves"] or 1, everything["cost"], turnless["sha256"] if turnless else EMPTY_SHA256)
    return out.unionByName(conversations.sparkSession.createDataFrame([root], out.schema))
