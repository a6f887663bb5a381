"""Exact dedup against immutable snapshots, by static binary-fuse filters.

A batch of documents becomes digests first; only these are moved.  Its distinct digests meet the filters of each
earlier snapshot, one filter per bucket of a bounded number of digests.  What a filter rejects is new for certain.
What it lets through is joined with the snapshot's exact digests and compared byte by byte with the stored text;
digests that repeat inside the batch are grouped separately, by their whole bytes.  Texts that are new then become
one more snapshot, which never changes.

Only texts whose digest repeats, or that a filter let through, are shuffled (and as many strangers as a fixed filter
of 2 MB lets through: with far more such digests than its 16.8 million bits, all texts are).  Copies are combined
before they move, so a third of all rows being one text costs one text per task.  Different texts of one digest are
told apart by their bytes and numbered (``variant``), so results do not hang on the digest.

Defined results: a null text counts as empty; a null id is smaller than any other; of equal ids with equal texts
exactly one row stays; empty tables give no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.llm import fuse_filter
from tidemark.llm.fuse_filter import FuseFilter
from tidemark.llm.tables import membership, passes, stage

#: Digests of a bucket: what one filter holds, and what one task screens at once.
BUCKET_KEYS = 200_000
#: Groups of more than one row in this many are joined by broadcast; there are at most so many.
HOT_SHARE = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass(frozen=True)
class Snapshot:
    """Texts of earlier batches, each once: ``path/texts`` (digest, key, variant, text) and ``path/filters``."""

    path: str
    buckets: int


def _named(batch: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = batch.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("digest", digest(F.col("text"))).withColumn("key", F.xxhash64("digest"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(buckets)).cast("int")


def write_snapshot(path: str, texts: DataFrame) -> Snapshot:
    """Make the folder of a snapshot from its distinct texts."""
    spark = texts.sparkSession
    texts.write.mode("error").parquet(f"{path}/texts")
    keys = spark.read.schema(texts.schema).parquet(f"{path}/texts").select("key")
    snapshot = Snapshot(path, max(1, math.ceil(keys.count() / BUCKET_KEYS)))

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        made = fuse_filter.build(rows["key"].to_numpy())
        return pd.DataFrame([(int(rows["bucket"].iloc[0]), made.seed, made.length, made.segments, made.slots)], columns=["bucket", "seed", "length", "segments", "slots"])

    filters = keys.withColumn("bucket", _bucket(snapshot.buckets)).groupBy("bucket")
    filters.applyInPandas(make, FILTERS).write.mode("error").parquet(f"{path}/filters")
    return snapshot


FILTERS = "bucket int, seed long, length long, segments long, slots binary"


def screen(fresh: DataFrame, rows: int, snapshot: Snapshot) -> DataFrame:
    """The rows (``digest``, ``key``, of which there are ``rows``) that the snapshot may hold.

    A bucket's rows are dealt to as many tasks as keep each at about ``BUCKET_KEYS``; each gets a copy of the filter.
    """
    parts = max(1, math.ceil(rows / snapshot.buckets / BUCKET_KEYS))
    asked = fresh.select("digest", "key", _bucket(snapshot.buckets).alias("bucket"), F.pmod(F.xxhash64(F.lit(23), "key"), F.lit(parts)).alias("part"))
    filters = fresh.sparkSession.read.schema(FILTERS).parquet(f"{snapshot.path}/filters")
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return asked[["digest", "key"]].iloc[:0]
        f = held.iloc[0]
        found = FuseFilter(int(f["seed"]), int(f["length"]), int(f["segments"]), bytes(f["slots"])).may_hold(asked["key"].to_numpy())
        return asked.loc[found, ["digest", "key"]]

    keys = ["bucket", "part"]
    return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(look, "digest binary, key long")


def _let_through(keys: DataFrame) -> Column:
    """A fixed-size filter of the keys in ``keys``, as a condition on column ``key``."""
    bitmap = membership(keys, "key")

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        hold = pd.Series(False, index=key.index)
        hold.iloc[passes(bitmap, key.to_numpy().astype("int64").view("uint64"))] = True
        return hold

    return test("key")


def ingest(
    batch: DataFrame,
    snapshots: Sequence[Snapshot] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> tuple[DataFrame, Snapshot | None]:
    """Classes of the batch's rows, and the snapshot of its new texts (in folder ``keep``, if given).

    Rows are ``doc_id, digest, variant, row``: rows of any batch have equal (digest, variant) if and only if their
    texts are equal byte by byte; ``row`` tells rows of a batch apart.
    """
    docs = _named(batch, id_column, text_column, digest)
    rows = stage(docs.select("doc_id", "digest", "key").withColumn("row", F.monotonically_increasing_id()), "digests")
    fresh = stage(rows.groupBy("digest").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n")), "fresh")
    n = fresh.count()

    hits = fresh.select("digest", "key").limit(0)
    for snapshot in snapshots:
        hits = hits.unionByName(screen(fresh, n, snapshot))
    hits = stage(hits.distinct(), "hits")
    suspects = fresh.where("n > 1").select("digest", "key").unionByName(hits).distinct()
    suspect, hit = _let_through(suspects), _let_through(hits)

    found = docs.where(suspect).groupBy("digest", "key", "text").agg(F.first(F.lit(None).cast("int")).alias("known"))
    for snapshot in snapshots:
        stored = batch.sparkSession.read.schema(TEXTS).parquet(f"{snapshot.path}/texts").where(hit)
        stored = stored.join(hits.select("digest"), "digest", "left_semi")
        found = found.unionByName(stored.select("digest", "key", "text", F.col("variant").alias("known")))
    texts = stage(_number(found), "texts")
    several = stage(texts.where("variant > 0").select("digest", "key").distinct(), "collided")

    out = rows.join(several.select("digest"), "digest", "left_anti").select("doc_id", "digest", F.lit(0).alias("variant"), "row")
    if several.take(1):
        again = docs.where(_let_through(several)).join(several.select("digest"), "digest", "left_semi")
        again = again.join(texts.select("digest", "text", "variant"), ["digest", "text"])
        out = out.unionByName(again.select("doc_id", "digest", "variant", (-1 - F.monotonically_increasing_id()).alias("row")))
    out = stage(out, "members")
    if keep is None:
        return out, None
    single = docs.where(~suspect).select("digest", "key", F.lit(0).alias("variant"), "text")
    new = texts.where("new").select("digest", "key", "variant", "text")
    return out, write_snapshot(keep, single.unionByName(new))


TEXTS = "digest binary, key long, variant int, text string"


def _number(found: DataFrame) -> DataFrame:
    """Distinct texts with their ``variant``: 0, 1, ... among the texts of a digest, those ``known`` from snapshots first."""
    once = found.groupBy("digest", "key", "text").agg(F.max("known").alias("known"))
    same = Window.partitionBy("digest")
    order = F.row_number().over(same.orderBy(F.col("known").isNotNull(), "text")) + F.coalesce(F.max("known").over(same), F.lit(-1))
    return once.select("digest", "key", "text", F.coalesce("known", order).cast("int").alias("variant"), F.col("known").isNull().alias("new"))


def keep_largest(members: DataFrame) -> DataFrame:
    """One row per member: its class's largest ``doc_id``, the class's size, and whether this row is the one that stays.

    ``members`` are staged rows ``doc_id, digest, variant, batch, row``.
    """
    keys = ["digest", "variant"]
    best = F.max(F.struct("doc_id", "batch", "row"))
    classes = stage(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "classes")
    total = members.count()
    hot = F.col("group_size") * HOT_SHARE > total
    # Fewer than HOT_SHARE classes can be that large; all others are small keys of the shuffled join.
    large = members.join(F.broadcast(classes.where(hot)), keys, "left")
    rest = large.where("best is null").drop("best", "group_size").join(classes.where(~hot), keys)
    both = large.where("best is not null").unionByName(rest)
    return both.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("batch") == F.col("best.batch")) & (F.col("row") == F.col("best.row"))).alias("kept"),
        "digest",
    )


def dedup(docs: DataFrame, batches: int = 3, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Take a whole table in as ``batches`` batches, each against the snapshots of those before."""
    spark, snapshots, members = docs.sparkSession, [], None
    number = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(batches))
    for b in range(batches):
        keep = staging.new_path(spark, "snapshot") if b < batches - 1 else None
        rows, snapshot = ingest(docs.where(number == b), snapshots, id_column, text_column, keep, digest)
        snapshots += [snapshot] if snapshot else []
        rows = rows.withColumn("batch", F.lit(b))
        members = rows if members is None else members.unionByName(rows)
    return keep_largest(members)
