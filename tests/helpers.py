"""Generated series and slow, obvious versions of the operators."""

import numpy as np
import pandas as pd

BAR = ["open", "high", "low", "close", "volume"]


def make_bars(rows, symbol="a", seed=0, start="2024-01-01", minutes=1, step=0.3):
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, step, rows)), 2)
    opens = np.round(close + rng.normal(0, 0.2, rows), 2)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=rows, freq=f"{minutes}min"),
            "open": opens,
            "high": np.maximum(opens, close) + np.round(rng.uniform(0, 0.4, rows), 2),
            "low": np.minimum(opens, close) - np.round(rng.uniform(0, 0.4, rows), 2),
            "close": close,
            "volume": np.round(rng.uniform(0, 50, rows), 1),
        }
    )


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def collect(df, *order):
    return df.toPandas().sort_values(list(order), ignore_index=True)


def wilder_rsi(close, period=14):
    d = close.diff()
    up = d.where(d > 0, 0.0).where(d.notna())
    down = (-d).where(d < 0, 0.0).where(d.notna())
    a, b = (s.ewm(alpha=1 / period, min_periods=period).mean() for s in (up, down))
    return 100 - 100 / (1 + a / b.where(b != 0))


def ema(x, period):
    return x.ewm(span=period, min_periods=period).mean()


def expected_indicators(g):
    """The standard feature set of one series, in plain pandas."""
    o, h, lo, c, v = (g[k] for k in BAR)
    out = pd.DataFrame({"rsi_14": wilder_rsi(c), "macd": ema(c, 12) - ema(c, 26)})
    out["macd_signal"] = ema(out["macd"], 9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    for p in (9, 21, 50):
        out[f"ema_{p}"] = ema(c, p)
    total = v.cumsum()
    out["vwap"] = ((h + lo + c) / 3 * v).cumsum() / total.where(total != 0)
    out["obi"] = (np.sign(c.diff()) * v).fillna(0).cumsum()
    ha_close, ha_open = (o + h + lo + c) / 4, [o.iloc[0]]
    for x in ha_close.iloc[:-1]:
        ha_open.append((ha_open[-1] + x) / 2)
    out["ha_open"], out["ha_close"] = ha_open, ha_close
    out["ha_high"] = np.maximum.reduce([h, lo, c, out["ha_open"]])
    out["ha_low"] = np.minimum.reduce([h, lo, c, out["ha_open"]])
    prev = c.shift()
    tr = pd.concat([h - lo, (h - prev).abs(), (lo - prev).abs()], axis=1).max(axis=1)
    out["atr_14"] = tr.rolling(14).mean()
    up, down = h.diff(), -lo.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    plus.iloc[0] = minus.iloc[0] = np.nan
    a = out["atr_14"].where(out["atr_14"] != 0)
    pdi, mdi = 100 * plus.rolling(14).mean() / a, 100 * minus.rolling(14).mean() / a
    both = pdi + mdi
    out["adx_14"] = ((pdi - mdi).abs() / both.where(both != 0) * 100).rolling(14).mean()
    above = (c > out["ema_50"]).astype(float).rolling(50).mean()
    regime = np.where(out["atr_14"] > out["atr_14"].rolling(100).mean() * 1.5, 3, 0)
    trending = out["adx_14"] >= 20
    regime = np.where(trending & (above > 0.6), 1, regime)
    out["regime"] = np.where(trending & (above < 0.4), 2, regime)
    return out


def greedy(rows, cooldown):
    kept = []
    for r in sorted(rows):
        if not kept or r - kept[-1] >= cooldown:
            kept.append(r)
    return kept


def slow_backtest(g, signal, horizon=12, warmup=50, cooldown=2, tp=0.005, sl=0.005, size=50.0):
    """Bar-by-bar episodes of one series."""
    out, last, n = [], None, len(g)
    o, h, lo, c = (g[k].to_numpy() for k in ("open", "high", "low", "close"))
    for i in range(warmup, n):
        if signal[i] == 0 or i + 1 + horizon >= n or (last is not None and i - last < cooldown):
            continue
        last, e, s = i, o[i + 1], int(signal[i])
        target, stop, found = e * (1 + s * tp), e * (1 - s * sl), None
        for k in range(horizon):
            hit_sl = lo[i + 1 + k] <= stop if s == 1 else h[i + 1 + k] >= stop
            hit_tp = h[i + 1 + k] >= target if s == 1 else lo[i + 1 + k] <= target
            if hit_sl or hit_tp:
                found = (k, "sl", stop) if hit_sl else (k, "tp", target)
                break
        k, why, x = found or (horizon - 1, "horizon", c[i + horizon])
        net = s * (x - e) / e * size - size * 0.0023
        out.append((i, why, k, round(x, 2), net))
    return pd.DataFrame(out, columns=["rn", "exit_reason", "horizon_bars", "exit_price", "net_raw"])
