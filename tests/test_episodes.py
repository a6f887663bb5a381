import math

import numpy as np
import pandas as pd
import pytest
from helpers import collect, frame, greedy, make_bars, slow_backtest
from pyspark.sql import functions as F

from tidemark.operators import context
from tidemark.operators import metrics as met
from tidemark.operators.signals import add_signal, signal_chunks
from tidemark.plans import barriers, research, slices
from tidemark.plans import cooldown as cool
from tidemark.plans.cooldown import thin
from tidemark.plans.series import index_rows


@pytest.mark.parametrize("cooldown", [1, 2, 3, 7, 80])
def test_cooldown_equals_the_greedy_loop(spark, small_chunks, cooldown):
    rng = np.random.default_rng(cooldown)
    sparse = np.flatnonzero(rng.random(3000) < 0.05)
    dense = np.flatnonzero(rng.random(3000) < 0.8)
    late = np.array([100_000, 100_001, 100_002, 170_000])
    rows = {"sparse": sparse, "dense": dense, "every": np.arange(2500), "late": late}
    pdf = pd.DataFrame([(k, int(r)) for k, v in rows.items() for r in v], columns=["symbol", "rn"])
    got = thin(frame(spark, pdf.sample(frac=1, random_state=0)), ["symbol"], cooldown).toPandas()
    for k, v in rows.items():
        assert sorted(got.loc[got["symbol"] == k, "rn"]) == greedy(v.tolist(), cooldown), k


@pytest.mark.parametrize("seed", range(8))
def test_jump_pointers_equal_the_greedy_loop(seed):
    rng = np.random.default_rng(seed)
    rows = np.flatnonzero(rng.random(int(rng.integers(1, 3000))) < rng.choice([0.01, 0.3, 0.9, 1.0]))
    for cooldown in (3, 4, 17, 500):
        for first in (0, 1, cooldown - 1, 10_000):
            want = greedy(rows[rows >= first].tolist(), cooldown)
            assert rows[cool._kept(rows, first, cooldown)].tolist() == want
        firsts = np.arange(cooldown)
        last = cool._last_kept(rows, firsts, cooldown)
        for f, i in zip(firsts, last):
            want = greedy(rows[rows >= f].tolist(), cooldown)
            assert (rows[i] == want[-1]) if want else i == len(rows)


@pytest.mark.parametrize("name,horizon,tp,sl", [("ema_trend", 12, 0.005, 0.005), ("vwap_bounce", 48, 0.02, 0.004), ("macd_crossover", 3, 0.004, 0.004)])
def test_backtest_equals_the_bar_loop(spark, small_chunks, name, horizon, tp, sl):
    pdf = make_bars(900, seed=21, step=0.4)
    series = index_rows(frame(spark, pd.concat([pdf, make_bars(61, "short", 4)])))
    signal = collect(add_signal(series, name).filter("symbol = 'a'"), "ts")["signal"].to_numpy()
    trades = barriers.backtest(signal_chunks(series, name, after=1), series, horizon=horizon, tp=tp, sl=sl)
    got = collect(trades.filter("symbol = 'a'"), "rn")
    want = slow_backtest(pdf, signal, horizon=horizon, tp=tp, sl=sl)
    assert len(want) > 5
    assert got["rn"].tolist() == want["rn"].tolist()
    assert got["exit_reason"].tolist() == want["exit_reason"].tolist()
    assert got["horizon_bars"].tolist() == want["horizon_bars"].tolist()
    np.testing.assert_allclose(got["net_raw"], want["net_raw"], rtol=1e-9, atol=1e-12)
    assert (got["outcome"].eq("WIN") == (got["net_raw"] > 0)).all()


def test_same_bar_tie_is_a_stop(spark):
    pdf = make_bars(80, seed=1)
    pdf["high"], pdf["low"] = pdf["open"] * 1.1, pdf["open"] * 0.9
    series = index_rows(frame(spark, pdf))
    reasons = barriers.backtest(signal_chunks(series, "ema_trend", after=1), series).select("exit_reason").distinct().collect()
    assert [r[0] for r in reasons] == ["sl"]


def runs(spark, values):
    rows = [(k, i, float(x)) for k, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "run_id string, rn long, net_pnl double")


def test_metrics_of_known_runs(spark):
    got = met.summarise(
        runs(spark, {"mixed": [1, -2, 3, -1, 2], "won": [1, 2, 3], "one": [-4]}), ["run_id"],
        runs=spark.createDataFrame([("mixed",), ("won",), ("one",), ("idle",)], "run_id string"),
    ).toPandas().set_index("run_id")
    x = np.array([1, -2, 3, -1, 2])
    m = got.loc["mixed"]
    assert (m.n_trades, m.wins, m.losses, m.win_rate, m.total_pnl) == (5, 3, 2, 0.6, 3.0)
    assert m.sharpe == round(x.mean() / x.std(ddof=1), 4)
    assert m.sortino == round(x.mean() / np.std([-2, -1], ddof=1), 4)
    assert (m.profit_factor, m.max_dd) == (2.0, -2.0)
    assert got.loc["won", ["sortino", "profit_factor"]].tolist() == [np.inf, np.inf]
    assert got.loc["one", ["sharpe", "sortino", "profit_factor", "max_dd"]].tolist() == [0, 0, 0, -4]
    assert got.loc["idle", ["n_trades", "sharpe", "p_value"]].tolist() == [0, 0, 1.0]
    assert not got["passes_gates"].any()


def test_drawdown_across_chunks(spark, small_chunks):
    rng = np.random.default_rng(2)
    values = {"up": rng.normal(0.2, 1, 700), "down": rng.normal(-0.2, 1, 700), "first": [-1, 5, -1]}
    got = met.max_drawdown(runs(spark, values), ["run_id"]).toPandas().set_index("run_id")["max_dd"]
    for k, xs in values.items():
        cum = np.cumsum(xs)
        assert got[k] == pytest.approx(min(0, (cum - np.maximum(0, np.maximum.accumulate(cum))).min()))


def test_bootstrap_pvalue(spark):
    spark.conf.set("spark.tidemark.chunkRows", "400")
    rng = np.random.default_rng(9)
    values = {"null": rng.normal(0.03, 1, 300), "far": rng.normal(1, 1, 300), "few": [1, 1, 1, 1]}
    got = met.bootstrap_pvalue(runs(spark, values), ["run_id"]).toPandas().set_index("run_id")["p_value"]
    spark.conf.unset("spark.tidemark.chunkRows")
    x = values["null"]
    draws = rng.choice(x - x.mean(), (4000, len(x))).mean(axis=1)
    assert got["null"] == pytest.approx((abs(draws) >= abs(x.mean())).mean(), abs=0.06)
    assert (got["far"], got["few"]) == (0.0, 1.0)


def test_resamples_take_each_row_once_on_average():
    w = met.draw_weights(np.array([*range(2000), 2**40, 2**40 + 1]), 0, 250)
    assert w.shape == (2002, 1000) and (w.mean(), w.var()) == (pytest.approx(1, abs=0.01), pytest.approx(1, abs=0.02))
    assert abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.12
    assert (w[:, 100:200] == met.draw_weights(np.array([*range(2000), 2**40, 2**40 + 1]), 25, 25)).all()


def test_every_resample_draws_a_poisson_count_of_its_own():
    at = np.array([*range(3000), met.PRIME - 1, met.PRIME, 2**40])
    got = met.poisson_weights(at, 0, 1000)
    draw = np.arange(1000)
    for p, row in zip(at.tolist()[::500] + at.tolist()[-3:], [*got[::500], *got[-3:]]):
        x = (p % met.PRIME * 48_271 + draw * 69_621 + 7) % met.PRIME
        for shift in (1, 3):
            x = (x * x % met.PRIME + x * shift + draw) % met.PRIME
        assert (row == np.searchsorted(met.POISSON, x, "left")).all()
    shares = np.bincount(got.astype(int).ravel(), minlength=8)[:8] / got.size
    assert shares == pytest.approx([np.exp(-1) / math.factorial(k) for k in range(8)], abs=0.002)
    assert got.max() >= 7 and abs(np.corrcoef(got[:, :40].T) - np.eye(40)).max() < 0.12
    assert (met.poisson_weights(at, 96, 8) == got[:, 96:104]).all()


def test_pvalue_is_that_of_poisson_resamples(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.05, 1, 500)
    got = met.bootstrap_pvalue(runs(spark, {"a": x}), ["run_id"]).first()["p_value"]
    w = met.poisson_weights(np.arange(500), 0, 1000)
    means = x @ w / w.sum(0)
    assert got == pytest.approx((abs(means - x.mean()) >= abs(x.mean())).mean(), abs=1e-9)


GOOD_RUN = {"n_trades": 30, "win_rate": 0.43, "sharpe": 0.5, "max_dd": -375.0, "p_value": 0.05}


@pytest.mark.parametrize("change", [{}, *({k: v} for k, v in {"n_trades": 29, "win_rate": 0.4299, "sharpe": 0.4999, "max_dd": -375.01, "p_value": 0.051}.items())])
def test_the_gate_at_and_beyond_each_limit(spark, change):
    run = spark.createDataFrame([{**GOOD_RUN, **change}], "n_trades long, win_rate double, sharpe double, max_dd double, p_value double")
    assert run.select(met.passes_gates(F.lit(1500.0))).first()[0] is (not change)


def test_a_good_run_passes_and_a_short_or_poor_one_does_not(spark):
    rng = np.random.default_rng(4)
    good = np.where(rng.random(60) < 0.8, 3.0, -1.0)
    got = met.summarise(runs(spark, {"good": good, "short": good[:20], "poor": -good}), ["run_id"]).toPandas().set_index("run_id")
    assert got["passes_gates"].to_dict() == {"good": True, "short": False, "poor": False}
    assert got.loc["good", "p_value"] == 0 and got.loc["poor", "p_value"] == 0


def test_equity_adds_up_unrounded_profits(spark):
    trades = spark.createDataFrame([("a", i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), 0.0, 0.004, 0.1) for i in range(10)], "symbol string, rn long, exit_ts timestamp, net_pnl double, net_raw double, fees double")
    last = collect(context.equity_curve(trades), "trade_rn").iloc[-1]
    assert (last.total_pnl, last.equity, last.n_trades) == (0.04, 10_000.04, 10)


def test_folds_and_splits(spark):
    series = index_rows(frame(spark, pd.concat([make_bars(103, "a"), make_bars(3, "b")])))
    folds = slices.folds(series, 4).groupBy("symbol", "fold").agg(F.min("rn"), F.max("rn"), F.max("n")).toPandas()
    assert sorted(folds.loc[folds.symbol == "a"].itertuples(index=False, name=None)) == [
        ("a", 0, 0, 24, 25), ("a", 1, 0, 24, 25), ("a", 2, 0, 24, 25), ("a", 3, 0, 27, 28)]
    assert folds.loc[folds.symbol == "b"].values.tolist() == [["b", 3, 0, 2, 3]]
    split = slices.holdout(series).filter("symbol = 'a'").groupBy("split").count().toPandas().set_index("split")["count"]
    assert split.to_dict() == {"train": 82, "test": 21}
    assert slices.recent(series, 50, 100).filter("symbol = 'a'").count() == 3


def test_walk_forward_restarts_signals_in_each_fold(spark):
    pdf = make_bars(800, seed=8, step=0.5)
    series = index_rows(frame(spark, pdf))
    got = collect(research.walk_forward(series, "ema_trend"), "fold")
    signal = collect(add_signal(series, "ema_trend"), "ts")["signal"].to_numpy()
    assert got["fold"].tolist() == [1, 2, 3]
    for k in (1, 2, 3):
        part = slice(200 * k, 200 * (k + 1))
        want = slow_backtest(pdf[part].reset_index(drop=True), signal[part], warmup=0)
        row = got[got["fold"] == k].iloc[0]
        assert row.n_trades == len(want)
        assert row.train_end == pdf["ts"][200 * k - 1] and row.test_start == pdf["ts"][200 * k]


def test_parameter_sweep_honours_parameters(spark):
    series = index_rows(frame(spark, make_bars(600, seed=5, step=0.6)))
    got = research.parameter_sweep(series, "vwap_bounce", [{"deviation_pct": 0.005}, {"deviation_pct": 0.03}])
    by = got.toPandas().set_index("candidate")
    assert by.loc[0, "n_trades"] > by.loc[1, "n_trades"]
    lone = barriers.backtest(signal_chunks(series, "vwap_bounce", after=1), series).count()
    both = research.parameter_sweep(series, "vwap_bounce", [{"deviation_pct": 0.01}]).toPandas()
    assert both["n_trades"].tolist() == [lone]
    assert len(research.parameter_grid("ema_trend", 2)) == 8
    assert research.parameter_sample("ema_trend", 5, 1) == research.parameter_sample("ema_trend", 5, 1)


def touches(high, low, start, end, upper, lower):
    """First touch, bar by bar."""
    out = []
    for s, e, u, d in zip(start, end, upper, lower):
        out.append(next((i for i in range(s, e) if high[i] >= u or low[i] <= d), e))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_galloping_search_equals_the_bar_loop(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    mid = np.cumsum(rng.normal(0, 1, n))
    high, low = mid + rng.random(n), mid - rng.random(n)
    high[rng.random(n) < 0.1] = low[rng.random(n) < 0.1] = np.nan
    start = rng.integers(0, n, 300)
    end = np.minimum(start + rng.integers(0, 2 * n, 300), n)
    base, reach = mid[start], rng.choice([0, 0.5, 3, 20, np.nan], 300)
    got = barriers.first_outside(high, low, start, end, base + reach, base - reach)
    assert got.tolist() == touches(high, low, start, end, base + reach, base - reach)


def test_long_horizons_need_memory_for_the_chunk_only():
    """20,000 bars ahead for 16,384 entries: a matrix of them would hold 328 million cells an array."""
    import tracemalloc

    rng = np.random.default_rng(3)
    path = pd.DataFrame({"_rn": np.arange(40_000), "_us": np.arange(40_000), "_close": 100 + np.cumsum(rng.normal(0, 0.05, 40_000))})
    path["_high"], path["_low"] = path["_close"] + 0.1, path["_close"] - 0.1
    rn = np.arange(16_384)
    found = pd.DataFrame({"rn": rn, "signal": 1, "entry_price": path["_close"].to_numpy()[rn + 1], "tp": 0.2, "sl": 0.1, "horizon": 20_000})
    tracemalloc.start()
    got = barriers._label(found, path)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert got["horizon_bars"].max() > 12 and set(got["exit_reason"]) <= {"tp", "sl", "horizon"}
    some = rng.integers(0, 16_384, 40)
    entry = found["entry_price"].to_numpy()[some]
    want = touches(path["_high"].to_numpy(), path["_low"].to_numpy(), some + 1, some + 20_001, entry * 1.2, entry * 0.9)
    at = np.where(got["exit_reason"][some] == "horizon", some + 20_001, some + 1 + got["horizon_bars"][some])
    assert at.tolist() == want


def test_runs_that_share_bars_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(barriers, "TASK_ENTRIES", 50)
    series = index_rows(frame(spark, make_bars(500, seed=6, step=0.6)))
    candidates = [{"deviation_pct": 0.001 * i} for i in range(1, 6)]
    dealt = collect(research.parameter_sweep(series, "vwap_bounce", candidates), "candidate")
    monkeypatch.setattr(barriers, "TASK_ENTRIES", 1 << 17)
    whole = collect(research.parameter_sweep(series, "vwap_bounce", candidates), "candidate")
    assert dealt["n_trades"].sum() > 200
    pd.testing.assert_frame_equal(dealt, whole)
