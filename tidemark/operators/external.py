"""External observations: parsing landed payloads and aligning them onto a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import SECONDS, ceil_to, floor_to, since
from tidemark.plans.series import Run, chunked, index_rows

DAY = 86_400_000_000
# Forms of dates beyond ISO that daily files use: fixed values.
DATE_FORMATS = ("MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy/MM/dd", "dd-MMM-yyyy", "dd MMM yyyy", "MMM d, yyyy", "yyyyMMdd HH:mm:ss")


# parsing ---------------------------------------------------------------------------------


def parse_time(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A date or time written as text: eight digits as a day, ISO, or one of ``formats``; NULL if none fits."""
    day = F.when(text.rlike("^[12][0-9]{7}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(day, text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def coerce_ts(text: Column) -> Column:
    """Numbers as milliseconds, seconds or nanoseconds by magnitude; other text as a date or time."""
    number = text.try_cast("double")
    micros = F.when(number > 1e12, number * 1e3).when(number > 1e8, number * 1e6).otherwise(number / 1e3)
    at = F.when(number.isNotNull(), F.timestamp_micros(F.round(micros).try_cast("long")))
    return at.otherwise(parse_time(text))


def variant_path(path: str) -> str:
    """``a[0].b.1`` as a path into a variant: numbers are places in a list."""
    steps = [x for x in path.replace("[", ".").replace("]", "").split(".") if x]
    return "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in steps)


def _transform(item: Column, field: str, kind: str) -> Column:
    text = F.try_variant_get(item, field, "string")
    truth = F.try_variant_get(item, field, "boolean")
    shape = F.schema_of_variant(F.try_variant_get(item, field, "variant"))
    number = F.when(shape == "BOOLEAN", truth.cast("double")).otherwise(text.try_cast("double"))
    if kind == "float":
        return number
    if kind == "int":
        whole = F.when(shape == "STRING", F.trim(text).try_cast("long"))
        return F.coalesce(whole, F.when(shape != "STRING", number.try_cast("long")))
    return F.coalesce(text, F.lit("None"))


def _first_per_ts(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    first = Window.partitionBy(*keys, "ts").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def parse_json(
    payloads: DataFrame, ts_path: str, value_path: str, transform: str = "float", order: Sequence[str] = ("payload_id",)
) -> DataFrame:
    """Observations ``(source, ts, value)`` of JSON payloads ``(source, payload, *order)``.

    ``data[0].timestamp`` means: items are the list under ``data``, the field is
    ``timestamp``; in ``prices[0].0`` items are lists themselves and the field their first place.  A single object counts as one item.  Rows whose time or value does
    not convert are dropped; the first of equal timestamps is kept.
    """
    doc = F.try_parse_json("payload")
    where = variant_path(ts_path.rsplit("[", 1)[0]) if "[" in ts_path else "$"
    found = F.try_variant_get(doc, where, "variant")
    many = F.try_variant_get(found, "$", "array<variant>")
    one = F.when(F.schema_of_variant(found).startswith("OBJECT"), found).otherwise(doc)
    items = F.coalesce(many, F.array(one))
    ts_field, value_field = (variant_path(p.split(".")[-1]) for p in (ts_path, value_path))
    rows = payloads.select("source", *order, F.posexplode(items).alias("_pos", "_item")).select(
        "source",
        *order,
        "_pos",
        coerce_ts(F.try_variant_get("_item", ts_field, "string")).alias("ts"),
        _transform(F.col("_item"), value_field, transform).alias("value"),
    )
    return _first_per_ts(rows.dropna(subset=["ts", "value"]), ["source"], [*order, "_pos"]).select(
        "source", "ts", "value"
    )


def parse_csv(
    rows: DataFrame, ts_field: str, value_field: str, order: Sequence[str], transform: str = "float"
) -> DataFrame:
    """Observations of header-named CSV rows (all columns read as text), the first of equal times by ``order``.

    ``order`` is the position in the file: a column that numbers the rows, or ``FILE_ORDER`` of ``with_file_order``.
    """
    value = F.col(value_field).try_cast("double") if transform == "float" else F.col(value_field)
    parsed = rows.select("source", *order, parse_time(F.col(ts_field)).alias("ts"), value.alias("value"))
    return _first_per_ts(parsed.dropna(subset=["ts", "value"]), ["source"], order).select(
        "source", "ts", "value"
    )


FILE_ORDER = ("_file", "_block", "_row")


def with_file_order(rows: DataFrame) -> DataFrame:
    """Rows just read from files, with columns that give their place: file, block of the file, row of the block."""
    return rows.withColumns(
        {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    )


def retain(observations: DataFrame, as_of, days: int | None = None) -> DataFrame:
    """Observations of the last ``days`` before ``as_of``; all of them unless an age is asked for."""
    return observations if days is None else observations.filter(since(F.col("ts"), as_of, days))


# alignment -------------------------------------------------------------------------------


def grid(observations: DataFrame, interval: str, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Regular times from the floor of the first to the ceiling of the last observation.

    Position ``rn`` and length ``n`` follow from the time itself.
    """
    step = SECONDS[interval] * 1_000_000
    span = observations.groupBy(*keys).agg(
        F.unix_micros(floor_to(F.min("ts"), interval)).alias("_from"),
        F.unix_micros(ceil_to(F.max("ts"), interval)).alias("_to"),
    )
    # Blocks of a day's steps first, so that no row holds a long array.
    block = max(step, DAY)
    starts = span.withColumn("_block", F.explode(F.expr(f"sequence(_from, _to, {block}L)")))
    # Few sources make many grid rows: spread the blocks before they grow.
    spread = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = starts.repartition(spread, *keys, "_block")
    at = F.explode(F.expr(f"sequence(_block, least(_block + {block - step}L, _to), {step}L)"))
    return starts.withColumn("_at", at).select(
        *keys,
        F.timestamp_micros("_at").alias("ts"),
        F.floor((F.col("_at") - F.col("_from")) / step).alias("rn"),
        (F.floor((F.col("_to") - F.col("_from")) / step) + 1).alias("n"),
    )


def average_duplicates(observations: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    return observations.groupBy(*keys, "ts").agg(F.avg("value").alias("value"))


def align_ffill(
    observations: DataFrame, interval: str, decay_periods: int = 0, keys: Sequence[str] = ("source",)
) -> DataFrame:
    """Latest observation at or before each grid time.

    With ``decay_periods`` the value fades linearly to 0 over that many periods.
    """
    step = SECONDS[interval] * 1_000_000
    seen = (
        average_duplicates(observations, keys)
        .groupBy(*keys, ceil_to(F.col("ts"), interval).alias("_grid_ts"))
        .agg(F.max_by("value", "ts").alias("_value"), F.max(F.unix_micros("ts")).alias("_seen"))
        .withColumnRenamed("_grid_ts", "ts")
    )
    ch = chunked(grid(observations, interval, keys).join(seen, [*keys, "ts"], "left"), keys)
    ch = ch.scan(Run("value", "_value", "last"), Run("_last", "_seen", "last"))
    value = F.col("value")
    if decay_periods > 0:
        age = F.floor((F.unix_micros("ts") - F.col("_last")) / step)
        value = value * F.greatest(F.lit(0.0), 1 - age / F.lit(decay_periods))
    return ch.own().select(*keys, "ts", value.alias("value"))


def align_interpolate(observations: DataFrame, interval: str, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Observations that fall on the grid, linear in time between them; the last one carries on."""
    on_grid = average_duplicates(observations, keys).filter(floor_to(F.col("ts"), interval) == F.col("ts"))
    known = chunked(index_rows(on_grid, keys, ["ts"], "observations"), keys, after=1)
    known = known.add(_nv=F.lead("value").over(known.window), _nt=F.lead("ts").over(known.window)).own()
    at = F.unix_micros("ts")
    points = known.select(
        *keys,
        "ts",
        F.col("value").alias("_v"),
        at.alias("_t"),
        F.coalesce("_nv", "value").alias("_w"),
        F.coalesce(F.unix_micros("_nt"), at + 1).alias("_u"),
    )
    ch = chunked(grid(observations, interval, keys).join(points, [*keys, "ts"], "left"), keys)
    ch = ch.scan(*(Run(f"_last{c}", c, "last") for c in ("_v", "_t", "_w", "_u")))
    v, t, w, u = (F.col(f"_last{c}") for c in ("_v", "_t", "_w", "_u"))
    share = (at - t) / (u - t)
    return ch.own().select(*keys, "ts", F.when(v == w, v).otherwise(v + (w - v) * share).alias("value"))


def align_pairs(
    observations: DataFrame, interval: str, method: str, keys: Sequence[str] = ("source",)
) -> DataFrame:
    """Two-period ``sum`` (missing as 0, first row NULL) or ``avg`` (NULL unless both exist)."""
    exact = average_duplicates(observations, keys)
    ch = chunked(grid(observations, interval, keys).join(exact, [*keys, "ts"], "left"), keys, before=1)
    ch = ch.add(_prev=F.lag("value").over(ch.window))
    now, prev = F.col("value"), F.col("_prev")
    if method == "sum":
        out = F.when(F.col("rn") > 0, F.coalesce(now, F.lit(0.0)) + F.coalesce(prev, F.lit(0.0)))
    else:
        out = (now + prev) / 2
    return ch.own().select(*keys, "ts", out.alias("value"))


def align(observations: DataFrame, interval: str, method: str = "ffill", decay_periods: int = 0) -> DataFrame:
    if method == "ffill":
        return align_ffill(observations, interval, decay_periods)
    if method == "interpolate":
        return align_interpolate(observations, interval)
    if method in ("sum", "avg"):
        return align_pairs(observations, interval, method)
    raise ValueError(f"unknown alignment {method!r}")


def write_aligned(aligned: DataFrame, path: str, interval: str) -> None:
    aligned.withColumn("timeframe", F.lit(interval)).write.mode("overwrite").partitionBy("timeframe", "source").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def join_external(features: DataFrame, aligned: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Left join of aligned sources on ts, one column per source."""
    wide = aligned.groupBy("ts").pivot("source", list(sources)).agg(F.first("value"))
    return features.join(wide, "ts", "left")


def bind_column(
    series: DataFrame, name: str, aligned: DataFrame | None = None, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Column ``name`` of a series: its own, else the aligned source filled forward, else 0."""
    if name in series.columns:
        return series
    if aligned is None:
        return series.withColumn(name, F.lit(0.0))
    found = aligned.filter(F.col("source") == name).select("ts", F.col("value").alias("_found"))
    ch = chunked(series.join(found, "ts", "left"), keys).scan(Run(name, "_found", "last"))
    return ch.own().drop("_found")
