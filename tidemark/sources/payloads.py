"""Landed exchange payloads and stream envelopes as typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def klines_to_bars(payloads: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``[[open_ms, "open", "high", "low", "close", "volume", ...], ...]`` as bar rows."""
    rows = payloads.select(*keys, F.explode(F.from_json("payload", "array<array<string>>")).alias("_k"))
    names = ("open", "high", "low", "close", "volume")
    return rows.select(
        *keys,
        F.timestamp_millis(F.get("_k", F.lit(0)).try_cast("long")).alias("ts"),
        *(F.get("_k", F.lit(i + 1)).try_cast("double").alias(name) for i, name in enumerate(names)),
    ).dropna()


def asset_of(symbol: Column) -> Column:
    return F.replace(F.lower(symbol), F.lit("usdt"), F.lit(""))


def parse_envelopes(raw: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """Trades, candles and tickers of a raw stream in one typed table told apart by ``kind``.

    Envelopes that lack what their kind needs are dropped.  A ticker is timed by its trade
    time, else its event time, else ``now``.
    """
    # Variant paths tell "e" from "E" and "t" from "T", which struct fields do not.
    doc = F.try_parse_json(column)
    wrapped = F.try_variant_get(doc, "$.data", "variant")
    m = raw.withColumn("_wrapped", wrapped.isNotNull()).withColumn("_d", F.coalesce(wrapped, doc))

    def d(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("_d", f"$.{name}", kind)

    def num(name: str) -> Column:
        return d(name).try_cast("double")

    trade = F.col("_wrapped") & (d("e") == "aggTrade")
    candle = F.col("_wrapped") & (d("e") == "kline")
    ticker = ~F.coalesce(trade | candle, F.lit(False)) & d("c").isNotNull()
    kind = F.when(trade, "trade").when(candle, "candle").when(ticker, "ticker")
    # Zero counts as absent, as in the feed itself.
    clock = F.unix_millis(now if now is not None else F.current_timestamp())
    ticker_ms = F.coalesce(F.nullif(d("T", "long"), F.lit(0)), F.nullif(d("E", "long"), F.lit(0)), clock)
    typed = m.withColumn("kind", kind).select(
        *[c for c in raw.columns if c != column],
        "kind",
        d("s").alias("symbol"),
        asset_of(d("s")).alias("asset"),
        F.when(trade, d("T", "long")).when(candle, d("k.t", "long")).when(ticker, ticker_ms).alias("ts_ms"),
        F.when(trade, num("p")).when(ticker, num("c")).alias("price"),
        F.when(trade, num("q")).alias("qty"),
        F.when(trade, d("m", "boolean")).alias("is_buyer_maker"),
        *(F.when(candle, num(f"k.{c[0]}")).alias(c) for c in ("open", "high", "low", "close", "volume")),
        F.when(candle, d("k.x", "boolean")).alias("is_closed"),
    )
    whole = (
        ((F.col("kind") == "trade") & F.col("price").isNotNull() & F.col("qty").isNotNull() & F.col("is_buyer_maker").isNotNull())
        | ((F.col("kind") == "candle") & F.col("close").isNotNull() & F.col("volume").isNotNull() & F.col("is_closed").isNotNull())
        | ((F.col("kind") == "ticker") & F.col("price").isNotNull())
    )
    return typed.filter(F.col("symbol").isNotNull() & F.col("ts_ms").isNotNull() & whole)
