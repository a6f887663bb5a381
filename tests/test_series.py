import numpy as np
import pandas as pd
import pytest
from helpers import collect, expected_indicators, frame, make_bars
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.indicators import Request
from tidemark.operators.signals import SIGNALS, Signal, add_signal
from tidemark.plans.series import Ewm, Run, chunked, index_rows


def test_positions_follow_order_however_keys_are_spread(spark):
    pdf = pd.concat([make_bars(3000, "hot", 1), make_bars(5, "rare", 2), make_bars(1, "one", 3)])
    got = collect(index_rows(frame(spark, pdf.sample(frac=1, random_state=1))), "symbol", "ts")
    assert (got["rn"] == got.groupby("symbol").cumcount()).all()
    assert (got["n"] == got.groupby("symbol")["ts"].transform("size")).all()


@pytest.mark.parametrize("size", [16, 64, 100_000])
@pytest.mark.parametrize("before", [0, 7, 16])
def test_scans_do_not_depend_on_chunks(spark, size, before):
    rng = np.random.default_rng(5)
    x = pd.Series(rng.normal(0, 1, 500))
    x[rng.random(500) < 0.3] = np.nan
    x[:3] = np.nan
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024", periods=500, freq="min"), "x": x})
    df = frame(spark, pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    ch = chunked(index_rows(df), before=before, size=size).scan(
        Run("total", "x"), Run("top", "x", "max"), Run("latest", "x", "last"),
        Ewm("fast", "x", 0.5, 3), Ewm("slow", "x", 2 / 51, 50), Ewm("last_only", "x", 1.0), Ewm("faded", "x", 0.5, how="sum"),
    )
    got = collect(ch.own(), "ts")
    faded, run = [], 0.0
    for v in x.fillna(0):
        run = run / 2 + v
        faded.append(run)
    want = {
        "total": x.fillna(0).cumsum(), "top": x.cummax().ffill(), "latest": x.ffill(), "last_only": x.ffill(),
        "fast": x.ewm(alpha=0.5, min_periods=3).mean(), "slow": x.ewm(span=50, min_periods=50).mean(), "faded": pd.Series(faded),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name], series, rtol=1e-9, atol=1e-12, err_msg=name)


def test_all_indicators_equal_plain_pandas_across_chunks(spark, small_chunks):
    # Longer than the widest halo, so that carries and halos both matter.
    parts = [make_bars(9000, "a", 1), make_bars(140, "b", 2), make_bars(3, "c", 3)]
    flat = make_bars(300, "flat", 4)
    flat[["open", "high", "low", "close"]] = 50.0
    flat["volume"] = 0.0
    pdf = pd.concat([*parts, flat])
    got = collect(ind.add_all(index_rows(frame(spark, pdf))), "symbol", "ts")
    for symbol, g in pdf.groupby("symbol"):
        want, mine = expected_indicators(g.reset_index(drop=True)), got[got["symbol"] == symbol].reset_index(drop=True)
        for c in want:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=f"{symbol} {c}")


def test_first_valid_rows(spark):
    got = collect(ind.add_all(index_rows(frame(spark, make_bars(60)))), "ts")
    first = {c: int(got[c].first_valid_index()) for c in ("rsi_14", "ema_9", "atr_14", "adx_14", "macd_signal", "ema_50")}
    assert first == {"rsi_14": 14, "ema_9": 8, "atr_14": 13, "adx_14": 27, "macd_signal": 33, "ema_50": 49}


def test_rsi_is_null_without_losses(spark):
    pdf = make_bars(40)
    pdf["close"] = np.arange(40) + 100.0
    got = ind.add_indicators(index_rows(frame(spark, pdf)), [Request("r", "rsi")]).toPandas()
    assert got["r"].isna().all()


def test_rolling_and_derived(spark, small_chunks):
    pdf = make_bars(400)
    if not ind.known("gap_test"):
        ind.register("gap_test", "(close - {m}) / {m} * {scale}", {"m": ("sma", {"period": "{period}"})}, {"period": 5, "scale": 10})
    with pytest.raises(ValueError):
        ind.register("gap_test", "close")
    with pytest.raises(ValueError, match="unknown indicator"):
        ind.add_indicators(index_rows(frame(spark, pdf)), [Request("x", "nosuch")])
    got = collect(
        ind.add_indicators(index_rows(frame(spark, pdf)), [
            Request("s", "std", {"period": 10}), Request("p", "pct_change", {"period": 2}), Request("g", "gap_test", {"period": 7})]), "ts")
    m = pdf["close"].rolling(7).mean()
    np.testing.assert_allclose(got["s"], pdf["close"].rolling(10).std(), rtol=1e-9)
    np.testing.assert_allclose(got["p"], pdf["close"].pct_change(2), rtol=1e-9)
    np.testing.assert_allclose(got["g"], (pdf["close"] - m) / m * 10, rtol=1e-7, atol=1e-9)


def expected_signal(name, g):
    i, c = expected_indicators(g), g["close"]
    sig = pd.Series(0, index=g.index)
    if name == "rsi_mean_reversion":
        long, short = (i["rsi_14"] < 30) & (i["regime"] == 0), (i["rsi_14"] > 70) & (i["regime"] == 0)
    elif name == "macd_crossover":
        h, p = i["macd_hist"], i["macd_hist"].shift()
        long, short = (h > 0) & (p <= 0), (h < 0) & (p >= 0)
    elif name == "ema_trend":
        long = (c > i["ema_50"]) & (i["ema_9"] > i["ema_21"])
        short = (c < i["ema_50"]) & (i["ema_9"] < i["ema_21"])
    elif name == "vwap_bounce":
        gap = c / i["vwap"] - 1
        long, short = gap < -0.01, gap > 0.01
    else:
        green, greens, reds, long, short = list(i["ha_close"] > i["ha_open"]), 0, 0, [], []
        for k, is_green in enumerate(green):
            greens = greens + 1 if is_green else 0
            repeats = k > 0 and green[k - 1] == is_green
            reds = (0 if repeats else reds) + (not is_green)
            long.append(greens >= 3)
            short.append(reds >= 3)
        long, short = pd.Series(long), pd.Series(short)
    sig[long.to_numpy()] = 1
    sig[short.to_numpy()] = -1
    return sig


@pytest.mark.parametrize("name", list(SIGNALS))
def test_signals(spark, small_chunks, name):
    pdf = make_bars(700, seed=11, step=0.8)
    got = collect(add_signal(index_rows(frame(spark, pdf)), name), "ts")
    want = expected_signal(name, pdf)
    assert (got["signal"].to_numpy() == want.to_numpy()).all()
    assert want.abs().sum() > 0
    assert Signal.from_dict(SIGNALS[name].to_dict()).params == SIGNALS[name].params


def test_strict_streak_means_consecutive_reds(spark):
    pdf = make_bars(300, seed=3)
    strict = SIGNALS["heikin_ashi_streak"].with_params(strict=True)
    got = collect(add_signal(index_rows(frame(spark, pdf)), strict), "ts")["signal"]
    i = expected_indicators(pdf)
    red = ~(i["ha_close"] > i["ha_open"])
    assert (got.eq(-1) == (red.rolling(3).sum() == 3)).all()


def test_scans_read_only_the_columns_asked_for(spark):
    series = index_rows(frame(spark, make_bars(50)))
    wanted = ind.add_indicators(series, [Request("s", "sma")]).select("symbol", "s")
    plan = wanted._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan parquet [symbol" in plan and "volume" not in plan
