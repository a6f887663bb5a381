"""Streams whose history is Spark's own keyed state: trailing windows, candles, silent feeds.

Trailing windows are kept per (symbol, bucket of time) and not per symbol, so that a busy symbol spreads over tasks and
each state holds two buckets of rows at most.  A row goes to its own bucket and to the next one, whose windows may reach
back to it.  Rows may come in any order while their bucket is open; a bucket closes, and its rows are emitted, once the
newest row is ``late_ms`` past its end.  A row that comes later than that takes no part; it is emitted, marked ``late``,
so that it can be counted and kept.  Rows later still, by more than ``grace_ms``, are dropped by Spark's watermark and
counted in the query's progress (``dropped_rows``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


DAY_MS = 86_400_000
HEAD = "symbol string, ts_ms long, seq long, late boolean"
RETURNS = HEAD + ", price double, ticks long, return_pct double"
FLOW = HEAD + ", cvd_short double, cvd_long double, vwap double, trade_count long"
CANDLES = "symbol string, kind string, at_ms long, from_ms long, to_ms long, missing long, volume double, candles_ready long, gaps long"
FEEDS = "symbol string, last_ts timestamp, age_s double, alive boolean"


# windows over rows already in (time, seq) order ----------------------------------------------


def _window_start(ts: np.ndarray, window_ms: int) -> np.ndarray:
    """First row still inside each row's window; a row exactly as old as the window is inside."""
    return np.searchsorted(ts, ts - window_ms, side="left")


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[1:] - total[start]


def returns_of(window_ms: int) -> Callable[[pd.DataFrame], dict[str, np.ndarray]]:
    """Price, rows inside the window, and percent change from its first row (missing for a lone one)."""

    def compute(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        start, price = _window_start(rows["ts_ms"].to_numpy(), window_ms), rows["price"].to_numpy(dtype=float)
        count, first = np.arange(len(rows)) - start + 1, price[start]
        change = np.divide(price - first, first, out=np.full(len(rows), np.nan), where=first != 0) * 100
        return {"price": price, "ticks": count, "return_pct": np.where(count >= 2, change, np.nan)}

    return compute


def flow_of(short_ms: int, long_ms: int) -> Callable[[pd.DataFrame], dict[str, np.ndarray]]:
    """Signed volume over both windows (a buyer-maker trade counts as sold), mean price and count over the long one."""

    def compute(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        ts, qty = rows["ts_ms"].to_numpy(), np.nan_to_num(rows["qty"].to_numpy(dtype=float))
        short, far = _window_start(ts, short_ms), _window_start(ts, long_ms)
        notional = np.nan_to_num(rows["price"].to_numpy(dtype=float)) * qty
        signed = np.where(rows["is_buyer_maker"].to_numpy(dtype=bool), -notional, notional)
        volume = _sums(qty, far)
        vwap = np.divide(_sums(notional, far), volume, out=np.full(len(rows), np.nan), where=np.round(volume, 9) != 0)
        return {"cvd_short": _sums(signed, short), "cvd_long": _sums(signed, far), "vwap": vwap, "trade_count": np.arange(len(rows)) - far + 1}

    return compute


class _Buckets(StatefulProcessor):
    """Rows of one symbol and bucket (and of the bucket before) until the bucket closes."""

    def __init__(self, compute, columns: Sequence[str], out: Sequence[str], bucket_ms: int, grace_ms: int):
        self.compute, self.columns, self.out, self.bucket_ms, self.grace_ms = compute, list(columns), list(out), bucket_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "block binary")

    def _closes(self, bucket):
        return (bucket + 1) * self.bucket_ms - self.grace_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, bucket = timerValues.getCurrentWatermarkInMs(), key[1]
        for part in rows:
            own = part["ts_ms"] // self.bucket_ms
            # Before the first watermark (0) nothing is closed.
            closed = ((own + 1) * self.bucket_ms - self.grace_ms <= now) & (now > 0)
            mine = closed & (own == bucket)
            if mine.any():
                yield part.loc[mine, ["symbol", "ts_ms", "seq"]].assign(late=True).reindex(columns=self.out)
            kept = part.loc[~closed, self.columns]
            if len(kept):
                block = np.empty(len(kept), _dtype(self.columns))
                for c in self.columns:
                    block[c] = kept[c].to_numpy(dtype=block.dtype[c], na_value=0) if block.dtype[c] == bool else kept[c].to_numpy(dtype=block.dtype[c])
                self.rows.appendValue((block.tobytes(),))
        if self.rows.exists():
            self.handle.registerTimer(max(self._closes(bucket), now + 1, 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocks = [np.frombuffer(bytes(b[0]), _dtype(self.columns)) for b in self.rows.get()]
        self.rows.clear()
        if blocks:
            held = pd.DataFrame(np.concatenate(blocks)).sort_values(["ts_ms", "seq"], ignore_index=True)
            made = pd.DataFrame({"symbol": key[0], "ts_ms": held["ts_ms"], "seq": held["seq"], "late": False, **self.compute(held)})
            yield made.loc[held["ts_ms"] // self.bucket_ms == key[1], self.out]

    def close(self) -> None:
        pass


def _dtype(columns: Sequence[str]) -> np.dtype:
    kinds = {"ts_ms": "<i8", "seq": "<i8", "is_buyer_maker": "?"}
    return np.dtype([(c, kinds.get(c, "<f8")) for c in columns])


def _trailing(rows: DataFrame, compute, columns: Sequence[str], schema: str, longest_ms: int, late_ms: int, grace_ms: int) -> DataFrame:
    own = F.expr(f"ts_ms div {longest_ms}")
    timed = rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{late_ms + grace_ms} milliseconds")
    placed = timed.select("symbol", F.explode(F.array(own, own + 1)).alias("bucket"), "ts", *columns)
    out = [field.split()[0] for field in schema.split(", ")]
    return placed.groupBy("symbol", "bucket").transformWithStateInPandas(_Buckets(compute, columns, out, longest_ms, grace_ms), schema, "Append", "EventTime")


def trailing_return(ticks: DataFrame, window_ms: int = 30_000, late_ms: int = 30_000, grace_ms: int = DAY_MS) -> DataFrame:
    """A stream of ticks with what ``operators.trailing.trailing_return`` gives for each, however late within bounds."""
    return _trailing(ticks, returns_of(window_ms), ["ts_ms", "seq", "price"], RETURNS, window_ms, late_ms, grace_ms)


def trailing_flow(trades: DataFrame, short_ms: int = 60_000, long_ms: int = 300_000, late_ms: int = 300_000, grace_ms: int = DAY_MS) -> DataFrame:
    """A stream of trades with what ``operators.trailing.trailing_flow`` gives for each."""
    columns = ["ts_ms", "seq", "price", "qty", "is_buyer_maker"]
    return _trailing(trades, flow_of(short_ms, long_ms), columns, FLOW, max(short_ms, long_ms), late_ms, grace_ms)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows so late that the watermark dropped them, over the query's kept progress reports."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


# candles --------------------------------------------------------------------------------------


class _Candles(StatefulProcessor):
    """Candles not yet settled, by open time, and what is known of the settled ones of a symbol."""

    def __init__(self, bar_ms: int, grace_ms: int):
        self.bar_ms, self.grace_ms = bar_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at long", "seq long, volume double, closed boolean")
        self.known = handle.getValueState("known", "cursor long, closed long, gaps long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor = self.known.get()[0] if self.known.exists() else None
        first, last = None, None
        for part in rows:
            late = part["open_time_ms"] <= cursor if cursor is not None else np.zeros(len(part), bool)
            if late.any():
                at = part.loc[late, "open_time_ms"]
                yield _candle_rows(key[0], "late", at_ms=at.to_numpy())
            part = part[~late]
            newest = part.sort_values("seq").groupby("open_time_ms", sort=False).agg({"seq": "last", "volume": "last", "is_closed": "any"})
            for at, seq, volume, closed in newest.itertuples(name=None):
                old = self.open.getValue((at,)) if self.open.containsKey((at,)) else (-(2**63), volume, False)
                self.open.updateValue((at,), (max(seq, old[0]), float(volume if seq >= old[0] else old[1]), bool(closed or old[2])))
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
        # One timer for what came first and one for what came last; the latter settles all between.
        now = timerValues.getCurrentWatermarkInMs()
        for at in {first, last} - {None}:
            self.handle.registerTimer(max(at - self.grace_ms + 1, now + 1, 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() + self.grace_ms
        settled = sorted((k[0], *v) for k, v in self.open.iterator() if k[0] < until)
        if not settled:
            return
        cursor, closed, gaps = self.known.get() if self.known.exists() else (None, 0, 0)
        at = np.array([s[0] for s in settled], np.int64)
        expected = np.concatenate([[at[0] if cursor is None else cursor + self.bar_ms], at[:-1] + self.bar_ms])
        gap = at > expected
        if gap.any():
            yield _candle_rows(key[0], "gap", from_ms=expected[gap], to_ms=at[gap], missing=(at[gap] - expected[gap]) // self.bar_ms)
        for t in at.tolist():
            self.open.removeKey((t,))
        self.known.update((int(at[-1]), closed + sum(s[3] for s in settled), gaps + int(gap.sum())))
        _, closed, gaps = self.known.get()
        yield _candle_rows(key[0], "state", at_ms=at[-1:], volume=[settled[-1][2]], candles_ready=[closed], gaps=[gaps])

    def close(self) -> None:
        pass


def _candle_rows(symbol: str, kind: str, **columns) -> pd.DataFrame:
    names = [f.split()[0] for f in CANDLES.split(", ")]
    return pd.DataFrame({"symbol": symbol, "kind": kind, **columns}).reindex(columns=names).astype({c: "Int64" for c in names[2:] if c != "volume"})


def candle_states(candles: DataFrame, bar_ms: int = 60_000, late_ms: int = 300_000, grace_ms: int = DAY_MS) -> DataFrame:
    """What a candle stream (``symbol, open_time_ms, seq, volume, is_closed``) tells per symbol, without its history.

    A candle settles once the newest is ``late_ms`` ahead: rows of kind ``gap`` (first missing and next open time),
    ``state`` (volume of the last settled candle, closed candles, gaps so far) and ``late`` (candles older than what is settled).
    """
    timed = candles.withColumn("ts", F.timestamp_millis("open_time_ms")).withWatermark("ts", f"{late_ms + grace_ms} milliseconds")
    rows = timed.select("symbol", "ts", "open_time_ms", "seq", F.col("volume").cast("double").alias("volume"), "is_closed")
    return rows.groupBy("symbol").transformWithStateInPandas(_Candles(bar_ms, grace_ms), CANDLES, "Append", "EventTime")


# silent feeds ---------------------------------------------------------------------------------


class _Silence(StatefulProcessor):
    """The newest row of a symbol, and a timer for the moment its feed counts as silent."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", "last timestamp, heard long, alive boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, now = max(part["ts"].max() for part in rows), timerValues.getCurrentProcessingTimeInMs()
        last, heard, alive = self.feed.get() if self.feed.exists() else (newest, None, False)
        if heard is not None:
            self.handle.deleteTimer(heard + self.timeout_ms)
        last = max(pd.Timestamp(last), pd.Timestamp(newest))
        self.feed.update((last.to_pydatetime(), now, True))
        self.handle.registerTimer(now + self.timeout_ms)
        if not alive:
            yield pd.DataFrame({"symbol": [key[0]], "last_ts": [last], "age_s": [0.0], "alive": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, heard, _ = self.feed.get()
        self.feed.update((last, heard, False))
        age = (timerValues.getCurrentProcessingTimeInMs() - heard) / 1000
        yield pd.DataFrame({"symbol": [key[0]], "last_ts": [pd.Timestamp(last)], "age_s": [age], "alive": [False]})

    def close(self) -> None:
        pass


def feed_changes(rows: DataFrame, timeout_s: int = 60) -> DataFrame:
    """A row when a symbol's feed is first heard, when nothing of it came for ``timeout_s`` seconds, and when it is heard again.

    Time is the cluster's clock; a silence shows in the first micro-batch (with or without rows) after it.
    """
    return rows.select("symbol", "ts").groupBy("symbol").transformWithStateInPandas(_Silence(timeout_s * 1000), FEEDS, "Append", "ProcessingTime")
