"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations


import re

from tidemark import fixtures as fx
from tidemark.operators.metrics import COUNTS, MIX, POISSON

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, value AS price,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS qty, event_id % 2 = 1 AS is_buyer_maker
  FROM events)"""


def money(x, digits):
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"


# Plain columns rounded to six digits, to be rounded the way the queries are.
_PLAIN_ROUND = re.compile(r"round\(([^(),]+), 6\)")


def bars(name="bars", bucket="date_trunc('hour', ts)"):
    return f"""{name} AS (
  SELECT symbol, {bucket} AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ts) AS close, sum(qty) AS volume
  FROM ticks GROUP BY ALL)"""


def rebar(name, src, bucket, keys="symbol"):
    return f"""{name} AS (
  SELECT {keys}, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, ts) AS close, sum(volume) AS volume
  FROM {src} GROUP BY {keys}, {bucket})"""


def bucket(seconds):
    return f"make_timestamp((epoch_us(ts) // {seconds * 1000000}) * {seconds * 1000000})"


SERIES = """x AS (
  SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n,
         lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def with_(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


def ewm(name, src, value, alpha, periods, keys="symbol", position="rn"):
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    outs = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    fade = f"pow({1 - alpha!r}, a.{position} - b.{position})"
    return f"""{name} AS (
  SELECT {outs}, a.{position},
         CASE WHEN count(b.{value}) >= {periods}
              THEN sum(b.{value} * {fade}) / sum(CASE WHEN b.{value} IS NOT NULL THEN {fade} END) END AS v
  FROM {src} a JOIN {src} b ON {on} AND b.{position} <= a.{position} GROUP BY {outs}, a.{position})"""


def roll(fn, value, rows, keys="symbol"):
    w = f"(PARTITION BY {keys} ORDER BY rn ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {w} = {rows} THEN {fn}({value}) OVER {w} END"


def macd(fast, slow, signal, tag=""):
    return [
        ewm(f"mf{tag}", "x", "close", 2 / (fast + 1), fast),
        ewm(f"ms{tag}", "x", "close", 2 / (slow + 1), slow),
        f"ml{tag} AS (SELECT symbol, rn, mf{tag}.v - ms{tag}.v AS m FROM mf{tag} JOIN ms{tag} USING (symbol, rn))",
        ewm(f"mg{tag}", f"ml{tag}", "m", 2 / (signal + 1), signal),
        f"macd{tag} AS (SELECT symbol, rn, m, mg{tag}.v AS s, m - mg{tag}.v AS h FROM ml{tag} JOIN mg{tag} USING (symbol, rn))",
    ]


def rsi(period, tag=""):
    return [
        f"""chg{tag} AS (SELECT symbol, rn, CASE WHEN close - pc IS NOT NULL THEN greatest(close - pc, 0) END AS g,
                  CASE WHEN close - pc IS NOT NULL THEN greatest(pc - close, 0) END AS l FROM x)""",
        ewm(f"gain{tag}", f"chg{tag}", "g", 1 / period, period),
        ewm(f"loss{tag}", f"chg{tag}", "l", 1 / period, period),
        f"""rsi{tag} AS (SELECT symbol, rn, 100 - 100 / (1 + gain{tag}.v / nullif(loss{tag}.v, 0)) AS v
                  FROM gain{tag} JOIN loss{tag} USING (symbol, rn))""",
    ]


CUMULATIVE = """cum AS (
  SELECT symbol, rn,
         sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap,
         sum(coalesce(sign(close - pc) * volume, 0)) OVER w AS obi
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY rn))"""

HEIKIN = [
    """hk AS (
  SELECT a.symbol, a.rn, pow(0.5, a.rn) * min(CASE WHEN b.rn = 0 THEN b.open END)
         + coalesce(sum(CASE WHEN b.rn < a.rn THEN (b.open + b.high + b.low + b.close) / 4 * pow(0.5, a.rn - b.rn) END), 0) AS ha_open
  FROM x a JOIN x b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.rn)""",
    """ha AS (
  SELECT symbol, rn, ha_open, (open + high + low + close) / 4 AS ha_close,
         greatest(high, low, close, ha_open) AS ha_high, least(high, low, close, ha_open) AS ha_low
  FROM x JOIN hk USING (symbol, rn))""",
]

TRUE_RANGE = """tr0 AS (
  SELECT symbol, rn, close,
         greatest(abs(high - low), coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
         CASE WHEN ph IS NULL THEN NULL WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
         CASE WHEN ph IS NULL THEN NULL WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm
  FROM x)"""


def adx(period=14):
    return [
        f"""dm AS (SELECT *, {roll('avg', 'tr', period)} AS atr, {roll('avg', 'pdm', period)} AS ap,
                 {roll('avg', 'mdm', period)} AS am FROM tr0)""",
        """di AS (SELECT *, 100 * ap / nullif(atr, 0) AS pdi, 100 * am / nullif(atr, 0) AS mdi FROM dm)""",
        """dx0 AS (SELECT *, abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100 AS dx FROM di)""",
        f"adx AS (SELECT *, {roll('avg', 'dx', period)} AS adx FROM dx0)",
    ]


REGIME = [
    ewm("e50", "x", "close", 2 / 51, 50),
    f"""rg0 AS (SELECT symbol, rn, atr, adx, {roll('avg', 'atr', 100)} AS am100,
             CASE WHEN adx.close > e50.v THEN 1.0 ELSE 0.0 END AS above FROM adx JOIN e50 USING (symbol, rn))""",
    f"rg1 AS (SELECT *, {roll('avg', 'above', 50)} AS share FROM rg0)",
    """rg AS (SELECT symbol, rn, CASE WHEN adx >= 20 AND share < 0.4 THEN 2 WHEN adx >= 20 AND share > 0.6 THEN 1
             WHEN atr > am100 * 1.5 THEN 3 ELSE 0 END AS regime FROM rg1)""",
]

BASE = [TICKS, bars(), SERIES]
FULL = [
    *BASE, *rsi(14), *macd(12, 26, 9), ewm("e9", "x", "close", 0.2, 9), ewm("e21", "x", "close", 2 / 22, 21),
    CUMULATIVE, *HEIKIN, TRUE_RANGE, *adx(), *REGIME,
    """ind AS (
  SELECT x.*, rsi.v AS rsi_14, macd.m AS macd, macd.s AS macd_signal, macd.h AS macd_hist, e9.v AS ema_9,
         e21.v AS ema_21, e50.v AS ema_50, vwap, obi, ha_open, ha_high, ha_low, ha_close, adx.atr AS atr_14,
         adx.adx AS adx_14, regime
  FROM x JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn) JOIN e9 USING (symbol, rn)
  JOIN e21 USING (symbol, rn) JOIN e50 USING (symbol, rn) JOIN cum USING (symbol, rn) JOIN ha USING (symbol, rn)
  JOIN adx USING (symbol, rn) JOIN rg USING (symbol, rn))""",
]


def rounded(*columns, digits=6):
    return ", ".join(f"{money(c, digits)} AS {c.split('.')[-1]}" for c in columns)


BAR_OUT = rounded("open", "high", "low", "close", "volume")
SIGNALS = {
    "rsi": """CASE WHEN rsi_14 > 70 AND regime = 0 THEN -1 WHEN rsi_14 < 30 AND regime = 0 THEN 1 ELSE 0 END""",
    "macd": """CASE WHEN macd_hist < 0 AND lag(macd_hist) OVER w >= 0 THEN -1
                    WHEN macd_hist > 0 AND lag(macd_hist) OVER w <= 0 THEN 1 ELSE 0 END""",
    "ema": """CASE WHEN close < ema_50 AND ema_9 < ema_21 THEN -1
                   WHEN close > ema_50 AND ema_9 > ema_21 THEN 1 ELSE 0 END""",
    "vwap": """CASE WHEN (close - vwap) / vwap > 0.01 THEN -1 WHEN (close - vwap) / vwap < -0.01 THEN 1 ELSE 0 END""",
}
HA_STREAK = [
    "g0 AS (SELECT symbol, rn, CAST(ha_close > ha_open AS INT) AS g FROM ha)",
    "g1 AS (SELECT *, coalesce(CAST(g = lag(g) OVER (PARTITION BY symbol ORDER BY rn) AS INT), 0) AS same FROM g0)",
    """g2 AS (SELECT *, sum(1 - same) OVER w AS run, sum(same) OVER w AS alt
             FROM g1 WINDOW w AS (PARTITION BY symbol ORDER BY rn))""",
    """g3 AS (SELECT symbol, rn, sum(g) OVER (PARTITION BY symbol, run ORDER BY rn) AS greens,
                    sum(1 - g) OVER (PARTITION BY symbol, alt ORDER BY rn) AS reds FROM g2)""",
    "sg AS (SELECT symbol, rn, CASE WHEN reds >= 3 THEN -1 WHEN greens >= 3 THEN 1 ELSE 0 END AS signal FROM g3)",
]


def greedy(name, src, keys, cooldown):
    """Cooldown thinning by recursion over candidate rows."""
    on = " AND ".join(f"c.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    outs = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (
  SELECT {keys}, min(rn) AS rn FROM {src} GROUP BY {keys}
  UNION ALL
  SELECT {outs}, (SELECT min(c.rn) FROM {src} c WHERE {on} AND c.rn >= k.rn + {cooldown}) AS rn
  FROM {name} k WHERE k.rn IS NOT NULL)"""


def exits(signals, tp, sl, horizon):
    return f"(SELECT *, {tp} AS tp, {sl} AS sl, {horizon} AS hz FROM {signals})"


def trades(signals, series="x", keys="symbol", bar_keys=None, warmup=50, cooldown=2, size=50.0, tag=""):
    """CTEs from a relation ``signals(keys, rn, signal, tp, sl, hz)`` to ``trades``."""
    ks = [k.strip() for k in keys.split(",")]
    bs = [k.strip() for k in (bar_keys or keys).split(",")]

    def cols(a):
        return ", ".join(f"{a}.{k}" for k in ks)

    def on(a, b, names):
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)

    up = "u IS NOT NULL AND (d IS NULL OR u < d)"
    target = "CASE WHEN signal = 1 THEN e * (1 + tp) ELSE e * (1 - tp) END"
    stop = "CASE WHEN signal = 1 THEN e * (1 - sl) ELSE e * (1 + sl) END"
    return [
        f"""cand{tag} AS (SELECT {cols('s')}, s.rn, s.signal, s.tp, s.sl, s.hz FROM {signals} s JOIN {series} b
             ON {on('s', 'b', bs)} AND s.rn = b.rn
             WHERE s.signal <> 0 AND s.rn >= {warmup} AND s.rn + 1 + s.hz < b.n)""",
        greedy(f"kept{tag}", f"cand{tag}", keys, cooldown),
        f"""ent{tag} AS (SELECT c.*, b.open AS e, b.ts AS ets
             FROM cand{tag} c JOIN kept{tag} k ON {on('c', 'k', ks)} AND c.rn = k.rn
             JOIN {series} b ON {on('c', 'b', bs)} AND b.rn = c.rn + 1)""",
        f"""path{tag} AS (SELECT {cols('t')}, t.rn, hz, b.rn - t.rn - 1 AS off, b.close,
               CASE WHEN signal = 1 THEN b.high >= {target} ELSE b.low <= {target} END AS up,
               CASE WHEN signal = 1 THEN b.low <= {stop} ELSE b.high >= {stop} END AS dn
             FROM ent{tag} t JOIN {series} b ON {on('t', 'b', bs)} AND b.rn BETWEEN t.rn + 1 AND t.rn + hz)""",
        f"""fst{tag} AS (SELECT {keys}, rn, min(CASE WHEN up THEN off END) AS u, min(CASE WHEN dn THEN off END) AS d,
               max(CASE WHEN off = hz - 1 THEN close END) AS lc FROM path{tag} GROUP BY ALL)""",
        f"""epi{tag} AS (SELECT {cols('t')}, t.rn, signal, e, ets,
               CASE WHEN {up} THEN 'tp' WHEN d IS NOT NULL THEN 'sl' ELSE 'horizon' END AS exit_reason,
               CASE WHEN {up} THEN u WHEN d IS NOT NULL THEN d ELSE hz - 1 END AS off,
               CASE WHEN {up} THEN {target} WHEN d IS NOT NULL THEN {stop} ELSE lc END AS x
             FROM ent{tag} t JOIN fst{tag} f ON {on('t', 'f', ks)} AND t.rn = f.rn)""",
        f"""pnl0{tag} AS (SELECT *, CASE WHEN signal = 1 THEN 1 ELSE -1 END * (x - e) / e * {size} AS gross,
               {size} * 0.0023 AS cost FROM epi{tag})""",
        f"""trades{tag} AS (SELECT {cols('p')}, p.rn, p.ets AS ts, CASE WHEN signal = 1 THEN 'BUY' ELSE 'SELL' END AS direction,
               {money('e', 2)} AS entry_price, {money('p.x', 2)} AS exit_price, exit_reason,
               b.ts AS exit_ts, p.off AS horizon_bars, {money('gross', 2)} AS gross_pnl, {size} * 0.002 AS fees,
               {size} * 0.0002 AS spread_cost, {size} * 0.0001 AS slippage, {money('gross - cost', 2)} AS net_pnl, gross - cost AS net_raw,
               CASE WHEN gross - cost > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome
             FROM pnl0{tag} p JOIN {series} b ON {on('p', 'b', bs)} AND b.rn = p.rn + 1 + p.off)""",
    ]


def recursive(*ctes):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def metrics(tag="", keys="symbol", order="rn"):
    """CTE ``summary`` over ``src``: everything but the p-value."""
    src = f"trades{tag}"
    inf = "'Infinity'::DOUBLE"
    return [
        f"""cumu{tag} AS (SELECT {keys}, {order}, sum(net_pnl) OVER (PARTITION BY {keys} ORDER BY {order}) AS cum FROM {src})""",
        f"""peak{tag} AS (SELECT {keys}, cum, greatest(0, max(cum) OVER (PARTITION BY {keys} ORDER BY {order})) AS pk FROM cumu{tag})""",
        f"dd{tag} AS (SELECT {keys}, least(0, min(cum - pk)) AS max_dd FROM peak{tag} GROUP BY {keys})",
        f"""agg{tag} AS (SELECT {keys}, count(*) AS n, count(*) FILTER (net_pnl > 0) AS w, sum(net_pnl) AS t, avg(net_pnl) AS a,
               coalesce(stddev_samp(net_pnl), 0) AS sd, coalesce(stddev_samp(net_pnl) FILTER (net_pnl < 0), 0) AS ds,
               coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) AS won, coalesce(-sum(net_pnl) FILTER (net_pnl < 0), 0) AS lost
             FROM {src} GROUP BY {keys})""",
        f"""summary{tag} AS (SELECT {keys}, n AS n_trades, w AS wins, n - w AS losses, {money('w / n', 4)} AS win_rate,
               {money('t', 2)} AS total_pnl, {money('a', 2)} AS avg_pnl, {money('CASE WHEN sd > 0 THEN a / sd ELSE 0 END', 4)} AS sharpe,
               CASE WHEN ds > 0 THEN {money('a / nullif(ds, 0)', 4)} WHEN a > 0 THEN {inf} ELSE 0 END AS sortino,
               CASE WHEN lost > 0 THEN {money('won / nullif(lost, 0)', 4)} ELSE {inf} END AS profit_factor,
               {money('max_dd', 2)} AS max_dd
             FROM agg{tag} JOIN dd{tag} USING ({keys}))""",
    ]


def bootstrap(keys="symbol", position="rn", resamples=1000):
    """CTE ``pv(keys, p_value)`` over ``trades(keys, rn, net_pnl)``: bytes of mixed 32-bit words of position and draw as weights."""
    low, high, number, a, b = (f"{m}::HUGEINT" for m in MIX)
    ends = ", ".join(str(sum(COUNTS[: i + 1])) for i in range(len(COUNTS) - 1))

    def mixed(x, shift):
        return f"xor({x}, {x} >> {shift})"

    return [
        f"pm AS (SELECT {keys}, avg(net_pnl) AS mean, count(*) AS n FROM trades GROUP BY {keys})",
        f"""p0 AS (SELECT {keys}, net_pnl, word, ((({position}) % 4294967296 * {low} + ({position}) // 4294967296 * {high} + word * {number} + 1) % 4294967296)::BIGINT AS x
             FROM trades, range(0, {-(-resamples // 4)}) r(word))""",
        f"p1 AS (SELECT {keys}, net_pnl, word, ({mixed('x', 16)} * {a} % 4294967296)::BIGINT AS x FROM p0)",
        f"p2 AS (SELECT {keys}, net_pnl, word, ({mixed('x', 15)} * {b} % 4294967296)::BIGINT AS x FROM p1)",
        f"p3 AS (SELECT {keys}, net_pnl, word, {mixed('x', 16)} AS x FROM p2)",
        f"p4 AS (SELECT {keys}, net_pnl, 4 * word + k AS draw, len(list_filter([{ends}], lambda t: ((x >> (8 * k)) & 255) >= t)) AS w FROM p3, range(0, 4) q(k))",
        f"p5 AS (SELECT {keys}, draw, sum(w * net_pnl) / sum(w) AS m FROM p4 GROUP BY {keys}, draw)",
        f"""pv AS (SELECT {keys}, CASE WHEN max(n) < 5 THEN 1 ELSE avg(CASE WHEN abs(m - mean) >= abs(mean) THEN 1.0 ELSE 0.0 END) END AS p_value
             FROM p5 JOIN pm USING ({keys}) GROUP BY {keys})""",
    ]


GATES = """n_trades >= 30 AND win_rate >= 0.43 AND sharpe >= 0.5 AND abs(max_dd) / (n_trades * 50.0) <= 0.25 AND p_value <= 0.05"""

TRADE_OUT = """symbol, rn, ts, direction, entry_price, exit_price, exit_reason, exit_ts, CAST(horizon_bars AS BIGINT) AS horizon_bars,
  gross_pnl, round(fees, 4) AS fees, round(spread_cost, 4) AS spread_cost, round(slippage, 4) AS slippage, net_pnl, outcome"""
VWAP_SIG = [*BASE, CUMULATIVE, f"sig AS (SELECT symbol, rn, {SIGNALS['vwap']} AS signal FROM x JOIN cum USING (symbol, rn))"]
VWAP_TRADES = [*VWAP_SIG, *trades(exits("sig", 2.0, 0.9, 12))]


def build() -> dict[str, str]:
    o = {}
    o["resample_bars"] = with_(
        TICKS, bars("bars_1h"), *(rebar(f"r{h}", "bars_1h", bucket(h * 3600)) for h in (4, 12, 24)),
    ) + " UNION ALL ".join(
        f"SELECT symbol, ts, {BAR_OUT}, '{name}' AS interval FROM {src}"
        for name, src in (("1h", "bars_1h"), ("4h", "r4"), ("12h", "r12"), ("1d", "r24"))
    )
    o["indicator_vwap"] = with_(*BASE, CUMULATIVE) + f"SELECT symbol, ts, {rounded('vwap')} FROM x JOIN cum USING (symbol, rn)"
    o["signal_vwap"] = with_(*VWAP_SIG) + "SELECT symbol, ts, signal FROM sig JOIN x USING (symbol, rn)"
    o["signal_cooldown"] = recursive(
        *VWAP_SIG,
        "cand AS (SELECT symbol, rn FROM sig JOIN x USING (symbol, rn) WHERE signal <> 0 AND rn >= 50 AND rn + 13 < n)",
        *(greedy(f"k{c}", "cand", "symbol", c) for c in (2, 5, 12)),
    ) + " UNION ALL ".join(f"SELECT symbol, rn, {c} AS cooldown FROM k{c} WHERE rn IS NOT NULL" for c in (2, 5, 12))
    o["trade_costs"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, direction,
        {money('s * 0.001', 6)} AS entry_fee, {money('s * 0.001', 6)} AS exit_fee, {money('s * 0.0002', 6)} AS spread_cost,
        {money('slip', 6)} AS slippage, {money('s * 0.0022 + slip', 6)} AS total,
        {money("CASE WHEN direction = 'SELL' THEN -1 ELSE 1 END * (ex - en) / en * s", 6)} AS gross
      FROM (SELECT *, l_quantity AS s, l_extendedprice AS en, l_extendedprice * (1 + l_tax - l_discount) AS ex,
              CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS direction,
              CASE WHEN l_extendedprice * 100 > 0 THEN l_quantity * least(1 + 0.5 * l_quantity / (l_extendedprice * 100) * 10000, 20) / 10000
                   ELSE l_quantity * 0.0001 END AS slip FROM lineitem)"""
    o["backtest_trades"] = recursive(*VWAP_TRADES) + f"SELECT {TRADE_OUT} FROM trades"
    o["backtest_summary"] = recursive(*VWAP_TRADES, *metrics(), *bootstrap()) + f"""SELECT summary.*, round(p_value, 6) AS p_value, {GATES} AS passes_gates
        FROM summary JOIN pv USING (symbol)"""
    o["indicator_shift_diff"] = with_(*BASE) + f"""SELECT symbol, ts, lag(close, 3) OVER w AS shift_3,
        round(close - lag(close, 3) OVER w, 6) AS diff_3, round(close / nullif(lag(close, 3) OVER w, 0) - 1, 6) AS pct_3
        FROM x WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""
    o["indicator_rolling"] = with_(*BASE) + f"""SELECT symbol, ts, round({roll('avg', 'close', 20)}, 6) AS sma,
        round({roll('stddev_samp', 'close', 20)}, 6) AS std, {roll('max', 'high', 20)} AS hi, {roll('min', 'low', 20)} AS lo FROM x"""
    o["indicator_obv"] = with_(*BASE, CUMULATIVE) + "SELECT symbol, ts, obi FROM x JOIN cum USING (symbol, rn)"
    o["indicator_atr"] = with_(*BASE, TRUE_RANGE) + f"""SELECT symbol, ts, round(a, 6) AS atr_14 FROM x JOIN
        (SELECT symbol, rn, {roll('avg', 'tr', 14)} AS a FROM tr0) USING (symbol, rn)"""
    o["indicator_ema"] = with_(*BASE, ewm("e9", "x", "close", 0.2, 9), ewm("e50", "x", "close", 2 / 51, 50)) + \
        "SELECT symbol, ts, round(e9.v, 6) AS ema_9, round(e50.v, 6) AS ema_50 FROM x JOIN e9 USING (symbol, rn) JOIN e50 USING (symbol, rn)"
    o["indicator_rsi"] = with_(*BASE, *rsi(14)) + "SELECT symbol, ts, round(v, 6) AS rsi_14 FROM x JOIN rsi USING (symbol, rn)"
    o["indicator_macd"] = with_(*BASE, *macd(12, 26, 9)) + \
        "SELECT symbol, ts, round(m, 6) AS macd, round(s, 6) AS macd_signal, round(h, 6) AS macd_hist FROM x JOIN macd USING (symbol, rn)"
    o["indicator_heikin_ashi"] = with_(*BASE, *HEIKIN) + \
        f"SELECT symbol, ts, {rounded('ha_open', 'ha_high', 'ha_low', 'ha_close')} FROM x JOIN ha USING (symbol, rn)"
    o["indicator_adx"] = with_(*BASE, TRUE_RANGE, *adx()) + "SELECT symbol, ts, round(adx, 6) AS adx_14 FROM x JOIN adx USING (symbol, rn)"
    o["indicator_regime"] = with_(*BASE, TRUE_RANGE, *adx(), *REGIME) + "SELECT symbol, ts, regime FROM x JOIN rg USING (symbol, rn)"
    all_cols = ("rsi_14", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21", "ema_50", "vwap", "obi", "ha_open",
                "ha_high", "ha_low", "ha_close", "atr_14", "adx_14")
    o["indicators_all"] = with_(*FULL) + f"SELECT symbol, ts, {BAR_OUT}, {rounded(*all_cols)}, regime FROM ind"
    o["indicator_by_name"] = with_(
        *BASE, *rsi(7), ewm("e20", "x", "close", 2 / 21, 20), TRUE_RANGE,
        f"a10 AS (SELECT symbol, rn, {roll('avg', 'tr', 10)} AS a FROM tr0)",
    ) + "SELECT symbol, ts, round(rsi.v, 6) AS rsi, round(e20.v, 6) AS ema, round(a, 6) AS atr, close AS price FROM x JOIN rsi USING (symbol, rn) JOIN e20 USING (symbol, rn) JOIN a10 USING (symbol, rn)"
    o["indicator_derived"] = with_(*BASE, ewm("e20", "x", "close", 2 / 21, 20), ewm("v10", "x", "volume", 2 / 11, 10)) + f"""
        SELECT symbol, ts, {money('(close - e20.v) / e20.v * 100', 6)} AS ema_gap_pct, {money('sqrt(abs(close - v10.v))', 6)} AS volume_root,
               {money('close / max(close) OVER (PARTITION BY symbol)', 6)} AS share_of_top
        FROM x JOIN e20 USING (symbol, rn) JOIN v10 USING (symbol, rn)"""
    for name in ("rsi", "macd", "ema"):
        o[f"signal_{name}"] = with_(*FULL) + \
            f"SELECT symbol, ts, {SIGNALS[name]} AS signal FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY rn)"
    o["signal_ha_streak"] = with_(*BASE, *HEIKIN, *HA_STREAK) + "SELECT symbol, ts, signal FROM sg JOIN x USING (symbol, rn)"
    o.update(rule_oracles())
    o.update(ranking_oracles())
    o.update(external_oracles())
    o.update(table_oracles())
    stream_oracles(o)
    return {name: _PLAIN_ROUND.sub(lambda m: money(m.group(1), 6), sql) for name, sql in o.items()}


# rules ---------------------------------------------------------------------------------


def choice(values, index):
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[({index}) % {len(values)} + 1]"


def documents(name, table, key, size, where="true"):
    condition = f"""{{'i': {choice(fx.DOC_INDICATORS, f'{key} + 3 * j')}, 'o': {choice(fx.DOC_OPS, f'{size} + 5 * j')},
        'r': {choice(fx.DOC_ROLLING, f'{key} + j')}, 'p': CASE WHEN ({key} + j) % 5 <> 0 THEN 10 + {size} END}}"""
    return f"""{name} AS (SELECT {key} AS rule_key, {key} % 13 = 0 AS anonymous, {key} % 11 = 0 AS wordy,
        CASE WHEN {key} % 17 <> 0 THEN list_transform(range(0, CAST({key} % 3 + 1 AS BIGINT)), lambda j: {condition}) END AS conds
      FROM {table} WHERE {where})"""


FINGERPRINT = """substr(md5('[' || coalesce(list_aggregate(list_transform(list_sort(list_transform(conds,
    lambda c: {'i': coalesce(c.i, '?'), 'o': coalesce(c.o, '?')})), lambda p: '["' || p.i || '", "' || p.o || '"]'), 'string_agg', ', '), '') || ']'), 1, 12)"""


def stored_conditions(name, table, key, size):
    """``name``: one row per condition of the stored documents (rule, fingerprint, indicator, operator, level, exits)."""
    i, o = f"(({key} * 7 + s * 3 + j * (1 + s % 4)) % 5)", f"(({key} + s * 5 + j * (4 + {key} % 7)) % 9)"
    level = " ".join(f"WHEN {n} THEN {v.replace('D', '::DOUBLE')}" for n, v in enumerate(fx.STORED_LEVELS.values()))
    return f"""{name}c AS (SELECT {key} AS k, 'rule_' || {key} AS rule_id, {choice(list(fx.STORED_LEVELS), i)} AS i, {choice(fx.STORED_OPS, o)} AS o,
           CASE WHEN {o} = 8 THEN 3 ELSE CASE {i} {level} END END AS v
         FROM (SELECT {key}, CAST({size} AS BIGINT) AS s, unnest(range(0, CAST({key} % 3 + 1 AS BIGINT))) AS j FROM {table} WHERE {key} % 13 <> 0)),
{name}f AS (SELECT rule_id, {FINGERPRINT} AS fp FROM (SELECT rule_id, list({{'i': i, 'o': o}}) AS conds FROM {name}c GROUP BY rule_id))"""


def stored_signals(name, src, columns):
    """``name(rule_id, symbol, rn, signal, tp, sl, hz)``: where all conditions of the stored rules hold on ``src``."""
    w = "(PARTITION BY symbol ORDER BY rn)"
    values = " UNION ALL ".join(
        f"""SELECT symbol, rn, '{i}' AS i, {x} AS x, lag({x}) OVER {w} AS prev, {roll('avg', x, 20, 'symbol')} AS mean,
              sum(CASE WHEN {x} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING) AS ups FROM {src}"""
        for i, x in columns.items()
    )
    tests = {
        "lt": "x < v", "gt": "x > v", "lte": "x <= v", "gte": "x >= v", "cross_above": "prev <= v AND x > v", "cross_below": "prev >= v AND x < v",
        "gt_rolling": "x > mean", "lt_rolling": "x < mean", "streak_gte": "ups = 3",
    }
    case = " ".join(f"WHEN '{op}' THEN {test}" for op, test in tests.items())
    return f"""{name}v AS ({values}),
{name} AS (SELECT rule_id, symbol, rn, 1 AS signal, any_value(0.01::DOUBLE + (k % 4) / 100::DOUBLE) AS tp, any_value(0.01::DOUBLE + (k % 3) / 100::DOUBLE) AS sl,
             any_value([12, 24, 48][k % 3 + 1]) AS hz
           FROM docc JOIN tried USING (rule_id) JOIN {name}v USING (i) WHERE rn >= 50 GROUP BY rule_id, symbol, rn
           HAVING bool_and(coalesce(CASE o {case} END, false)))"""


def any_(test):
    return f"coalesce(len(list_filter(conds, lambda c: coalesce({test}, false))) > 0, false)"


GAPS = """SELECT symbol, p + 3600000 AS from_ms, epoch_ms(ts) AS to_ms, (epoch_ms(ts) - p - 3600000) // 3600000 AS missing
        FROM (SELECT symbol, ts, lag(epoch_ms(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM x) WHERE epoch_ms(ts) > p + 3600000"""


def indicator_rules(rule_list, columns, src, keys="symbol"):
    """One (rule_id, keys, rn, signal, tp, sl, hz) relation of plain threshold, cross and sma rules."""
    w = f"(PARTITION BY {keys} ORDER BY rn)"
    parts = []
    for r in rule_list:
        tests = []
        for c in r.conditions:
            x = columns.get(c.indicator, c.indicator)
            sign = {"lt": "<", "gt": ">", "lte": "<=", "gte": ">=", "eq": "=", "ne": "<>"}
            if c.op in sign:
                tests.append(f"{x} {sign[c.op]} {c.value}")
            elif c.op == "cross_above":
                tests.append(f"lag({x}) OVER {w} <= {c.value} AND {x} > {c.value}")
            else:
                tests.append(f"{x} {'>' if c.op == 'gt_rolling' else '<'} {roll('avg', x, c.period, keys)}")
        parts.append(f"""SELECT '{r.rule_id}' AS rule_id, {keys}, rn,
          CASE WHEN rn >= 50 AND {' AND '.join(f'coalesce({t}, false)' for t in tests)} THEN 1 ELSE 0 END AS signal,
          {r.tp} AS tp, {r.sl} AS sl, {r.horizon} AS hz FROM {src}""")
    return " UNION ALL ".join(parts)


COLUMNS = {"rsi": "rsi_14", "adx": "adx_14", "atr": "atr_14", "ema": "ema_20"}
WITH_E20 = [*FULL, ewm("e20", "x", "close", 2 / 21, 20), "i20 AS (SELECT ind.*, e20.v AS ema_20 FROM ind JOIN e20 USING (symbol, rn))"]
SPLIT = """sp AS (SELECT *, CASE WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM x),
xs AS (SELECT symbol, split, ts, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol, split ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol, split) AS n FROM sp)"""


def fold_series(name, src, extra=""):
    return f"""{name}0 AS (SELECT *, least(rn // (n // 4), 3) AS fold FROM {src}),
{name} AS (SELECT symbol, fold, ts, open, high, low, close, volume{extra},
         row_number() OVER (PARTITION BY symbol, fold ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol, fold) AS n FROM {name}0)"""


def fold_bounds(name, src):
    return f"""{name}a AS (SELECT symbol, fold, min(ts) AS test_start, max(ts) AS test_end, max(n) AS rows FROM {src} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, min(test_start) OVER p AS train_start, max(test_end) OVER p AS train_end, sum(rows) OVER p AS before
         FROM {name}a WINDOW p AS (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
         WHERE before >= 72 AND rows >= 17)"""


FOLD_METRICS = ("n_trades", "sharpe", "total_pnl", "max_dd", "win_rate", "profit_factor")


def walk(signal_name):
    return [
        *FULL,
        fold_series("xf", "ind", ", macd_hist, vwap"),
        f"sigf AS (SELECT symbol, fold, rn, {SIGNALS[signal_name]} AS signal FROM xf WINDOW w AS (PARTITION BY symbol, fold ORDER BY rn))",
        *trades(exits("sigf", 0.005, 0.005, 12), "xf", "symbol, fold", warmup=0),
        *metrics(keys="symbol, fold"),
        fold_bounds("fb", "xf"),
        f"""wf AS (SELECT fb.symbol, CAST(fb.fold AS INT) AS fold, train_start, train_end, test_start, test_end,
             {', '.join(f'coalesce({m}, 0) AS {m}' for m in FOLD_METRICS)}
           FROM fb LEFT JOIN summary s ON fb.symbol = s.symbol AND fb.fold = s.fold)""",
    ]


def wf_summary(src, keys):
    return f"""SELECT {keys}, count(*) AS n_folds, CAST(sum(n_trades) AS BIGINT) AS n_trades_total, {money('avg(sharpe)', 4)} AS oos_sharpe_mean,
        {money('stddev_samp(sharpe)', 4)} AS oos_sharpe_std, min(sharpe) AS oos_sharpe_min, max(sharpe) AS oos_sharpe_max,
        {money('sum(total_pnl)', 2)} AS oos_pnl_total, sum(n_trades) >= 30 AND bool_and(sharpe > 0) AS passes
      FROM {src} GROUP BY {keys}"""


def condition_columns(tests):
    return ", ".join(f"CAST(coalesce({t}, false) AS INT) AS c{i}" for i, t in enumerate(tests))


def streak(x, rows):
    return f"sum(CASE WHEN {x} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW) = {rows}"


def rule_oracles():
    o = {}
    w = "(PARTITION BY symbol ORDER BY rn)"
    full = with_(*FULL)
    o["rules_threshold"] = full + "SELECT symbol, ts, " + condition_columns([
        "rsi_14 < 45", "close > 60", "volume <= 300", "adx_14 >= 20", "regime = 2", "regime <> 2", "0 < 5", "0 > 5"]) + " FROM ind"
    o["rules_cross"] = full + "SELECT symbol, ts, " + condition_columns([
        f"lag(close) OVER {w} <= 50 AND close > 50", f"lag(rsi_14) OVER {w} >= 50 AND rsi_14 < 50",
        f"lag(macd_hist) OVER {w} <= 0 AND macd_hist > 0"]) + " FROM ind"
    o["rules_rolling"] = with_(*WITH_E20, ewm("er", "ind", "rsi_14", 2 / 11, 10)) + "SELECT symbol, ts, " + condition_columns([
        f"close > {roll('avg', 'close', 20)}", "close < ema_20", f"volume > {roll('avg', 'volume', 10)}", "rsi_14 < er.v"]) + \
        " FROM i20 JOIN er USING (symbol, rn)"
    o["rules_streak"] = full + "SELECT symbol, ts, " + condition_columns([
        streak("macd_hist > 0", 3), streak("close - pc < 0", 2), "false", streak("obi > 0", 4)]) + " FROM ind"
    o["rules_evaluate"] = full + f"""SELECT symbol, ts, CASE WHEN rn >= 50 AND coalesce(rsi_14 < 55, false)
        AND coalesce(close < {roll('avg', 'close', 20)}, false) THEN 1 ELSE 0 END AS signal FROM ind"""
    docs = documents("docs", "part", "p_partkey", "p_size")
    rolls = "c.o IN ('gt_rolling', 'lt_rolling')"
    ops = ", ".join(f"'{p}'" for p in fx.DOC_OPS[:12])
    errors = [
        ("anonymous", "missing name"), ("conds IS NULL", "missing entry_conditions"),
        (any_("c.i IS NULL"), "condition missing indicator"), (any_("c.o IS NULL"), "condition missing op"),
        (any_(f"c.o NOT IN ({ops})"), "invalid op"), (any_(f"{rolls} AND c.r IS NULL"), "rolling op needs a method"),
        (any_(f"{rolls} AND c.r NOT IN ('sma', 'ema')"), "invalid rolling method"),
        (any_(f"{rolls} AND c.p IS NULL"), "rolling op needs a period"),
        ("wordy AND conds IS NOT NULL", "value is not a number"),
    ]
    listed = ", ".join(f"CASE WHEN {t} THEN '{text}' END" for t, text in errors)
    o["rules_validate"] = with_(docs) + f"""SELECT rule_key, len(e) = 0 AS valid, coalesce(list_aggregate(e, 'string_agg', '; '), '') AS errors
        FROM (SELECT rule_key, list_filter([{listed}], lambda v: v IS NOT NULL) AS e FROM docs)"""
    o["rules_fingerprint"] = with_(docs) + f"SELECT rule_key, {FINGERPRINT} AS fp FROM docs"
    o["rules_dedup"] = with_(docs, documents("old", "(SELECT * REPLACE (s_suppkey * 9 AS s_suppkey) FROM supplier)", "s_suppkey", "s_nationkey")) + f"""
        SELECT min(rule_key) AS rule_key, fp FROM (SELECT rule_key, {FINGERPRINT} AS fp FROM docs)
        WHERE fp NOT IN (SELECT {FINGERPRINT} FROM old) GROUP BY fp"""
    from checks.queries import PLAIN_RULES, RANDOM_RULES

    o["rule_sweep"] = recursive(
        *WITH_E20, f"sigr AS ({indicator_rules(RANDOM_RULES, COLUMNS, 'i20')})",
        *trades("sigr", keys="rule_id, symbol", bar_keys="symbol"), *metrics(keys="rule_id, symbol"),
    ) + "SELECT * FROM summary"
    stored = [
        stored_conditions("doc", "part", "p_partkey", "p_size"), stored_conditions("old", "nation", "n_nationkey", "n_regionkey"),
        """tried AS (SELECT rule_id FROM docf WHERE fp NOT IN (SELECT fp FROM oldf) QUALIFY row_number() OVER (PARTITION BY fp ORDER BY rule_id) = 1)""",
    ]
    stored_columns = {"rsi": "rsi_14", "close": "close", "volume": "volume", "macd": "macd", "ema": "ema_20"}
    o["rule_store_sweep"] = recursive(
        *WITH_E20, *stored, stored_signals("sigd", "i20", stored_columns), *trades("sigd", keys="rule_id, symbol", bar_keys="symbol"), *metrics(keys="rule_id, symbol")
    ) + "SELECT * FROM summary"
    train = "xt AS (SELECT * EXCLUDE (split) FROM xs WHERE split = 'train')"
    recent = """xr0 AS (SELECT *, greatest(least(2880, n - 100), 0) AS k FROM xt),
xr AS (SELECT symbol, ts, open, high, low, close, volume, rn - (n - k) AS rn, k AS n FROM xr0 WHERE rn >= n - k)"""
    o["rule_screen"] = recursive(
        *BASE, SPLIT, train, recent,
        f"sigq AS ({indicator_rules(PLAIN_RULES, {}, 'xr')})",
        *trades("sigq", "xr", "rule_id, symbol", "symbol", tag="q"), *metrics("q", "rule_id, symbol"),
        f"sigt AS ({indicator_rules(PLAIN_RULES, {}, 'xt')})",
        *trades("sigt", "xt", "rule_id, symbol", "symbol", tag="t"), *metrics("t", "rule_id, symbol"),
    ) + "SELECT summaryt.* FROM summaryt SEMI JOIN (SELECT * FROM summaryq WHERE sharpe > -0.05 AND n_trades >= 3) USING (rule_id, symbol)"

    def indicators_on(src, tag):
        """``i{tag}``: the indicators of the stored rules, begun anew on a slice."""
        parts = [
            f"y{tag} AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM {src})",
            *rsi(14, tag), *macd(12, 26, 9, tag), ewm(f"e{tag}", "x", "close", 2 / 21, 20),
            f"""i{tag} AS (SELECT x.*, rsi{tag}.v AS rsi_14, macd{tag}.m AS macd, e{tag}.v AS ema_20
              FROM y{tag} x JOIN rsi{tag} USING (symbol, rn) JOIN macd{tag} USING (symbol, rn) JOIN e{tag} USING (symbol, rn))""",
        ]
        return [t.replace("FROM x)", f"FROM y{tag})").replace("FROM x a JOIN x b", f"FROM y{tag} a JOIN y{tag} b") for t in parts]

    o["rule_store_screen"] = recursive(
        *BASE, SPLIT, train, recent, *stored,
        *indicators_on("xr", "_r"), stored_signals("sig_r", "i_r", stored_columns),
        *trades("sig_r", "xr", "rule_id, symbol", "symbol", tag="_q"), *metrics("_q", "rule_id, symbol"),
        *indicators_on("xt", "_t"), stored_signals("sig_t", "i_t", stored_columns),
        *trades("sig_t", "xt", "rule_id, symbol", "symbol", tag="_w"), *metrics("_w", "rule_id, symbol"),
    ) + "SELECT summary_w.* FROM summary_w SEMI JOIN (SELECT * FROM summary_q WHERE sharpe > -0.05 AND n_trades >= 3) USING (rule_id, symbol)"
    periods = (3, 15, 30, 100)
    grid = [(f, m, s) for f in (3, 15) for m in (15, 30) for s in (30, 100)]
    candidates = " UNION ALL ".join(
        f"""SELECT {i} AS candidate, symbol, rn, CASE WHEN close < p{s} AND p{f} < p{m} THEN -1 WHEN close > p{s} AND p{f} > p{m} THEN 1 ELSE 0 END AS signal FROM emas"""
        for i, (f, m, s) in enumerate(grid)
    )
    o["param_sweep"] = recursive(
        *BASE, *(ewm(f"e{p}", "x", "close", 2 / (p + 1), p) for p in periods),
        f"""emas AS (SELECT x.symbol, x.rn, close, {', '.join(f'e{p}.v AS p{p}' for p in periods)} FROM x
             {' '.join(f'JOIN e{p} USING (symbol, rn)' for p in periods)})""",
        f"sigp AS ({candidates})", *trades(exits("sigp", 2.0, 0.9, 12), keys="candidate, symbol", bar_keys="symbol"),
        *metrics(keys="candidate, symbol"),
        """scored AS (SELECT candidate, symbol, coalesce(n_trades, 0) AS n_trades, coalesce(sharpe, 0) AS sharpe
             FROM (SELECT DISTINCT symbol FROM x) CROSS JOIN range(0, 8) r(candidate) LEFT JOIN summary USING (candidate, symbol))""",
        "fit AS (SELECT *, CASE WHEN n_trades >= 30 THEN sharpe ELSE -999.0 END AS fitness FROM scored)",
    ) + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fitness DESC, candidate) AS rank FROM fit) WHERE rank <= 4"""
    keys = "rule_id, symbol, split"
    o["holdout_overfit"] = recursive(
        *BASE, SPLIT, train, f"sigh AS ({indicator_rules(PLAIN_RULES, {}, 'xs', 'symbol, split')})",
        *trades("sigh", "xs", keys, "symbol, split", tag="h"), *metrics("h", keys),
        fold_series("xf", "xt"), f"sigf AS (SELECT * EXCLUDE (tp, sl, hz) FROM ({indicator_rules(PLAIN_RULES, {}, 'xf', 'symbol, fold')}))",
        *trades(exits("sigf", 0.005, 0.005, 12), "xf", "rule_id, symbol, fold", "symbol, fold", warmup=0, tag="f"),
        *metrics("f", "rule_id, symbol, fold"), fold_bounds("fb", "xf"),
        "ids AS (SELECT DISTINCT rule_id FROM sigh)",
        """wff AS (SELECT rule_id, symbol, fold, coalesce(n_trades, 0) AS n_trades, coalesce(sharpe, 0) AS sharpe, coalesce(total_pnl, 0) AS total_pnl
             FROM fb CROSS JOIN ids LEFT JOIN summaryf USING (rule_id, symbol, fold))""",
        f"wfs AS ({wf_summary('wff', 'rule_id, symbol')})",
        "big AS (SELECT DISTINCT symbol FROM xs WHERE split = 'test' AND n > 100)",
        """joined AS (SELECT r.rule_id, s.symbol, coalesce(a.sharpe, 0) AS sharpe, coalesce(a.win_rate, 0) AS win_rate,
             coalesce(a.profit_factor, 0) AS profit_factor, coalesce(a.total_pnl, 0) AS total_pnl, coalesce(a.max_dd, 0) AS max_dd,
             coalesce(a.n_trades, 0) AS n_trades, coalesce(b.sharpe, 0) AS oos_sharpe, coalesce(b.n_trades, 0) AS oos_trades,
             coalesce(wfs.oos_sharpe_mean, 0) AS wf_sharpe, coalesce(wfs.passes, false) AS wf_passes
           FROM ids r CROSS JOIN (SELECT DISTINCT symbol FROM x) s
           LEFT JOIN summaryh a ON a.rule_id = r.rule_id AND a.symbol = s.symbol AND a.split = 'train'
           LEFT JOIN summaryh b ON b.rule_id = r.rule_id AND b.symbol = s.symbol AND b.split = 'test' AND s.symbol IN (SELECT symbol FROM big)
           LEFT JOIN wfs ON wfs.rule_id = r.rule_id AND wfs.symbol = s.symbol)""",
    ) + "SELECT *, oos_sharpe < sharpe - 0.3 AND oos_trades >= 10 AS overfit FROM joined"
    return o


# evaluation and ranking ------------------------------------------------------------------

PNL = """trades AS (SELECT l_returnflag AS run_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_shipdate,
    l_partkey, l_suppkey, l_extendedprice) AS rn, round(l_extendedprice * (l_discount - 0.05) / 100, 2) AS net_pnl FROM lineitem)"""
BOARD = """board AS (SELECT *, oos_sharpe < sharpe - 0.3 AND oos_trades >= 10 AS overfit FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_nationkey AS generation, c_acctbal / 10000 AS sharpe, coalesce(k, 0) AS n_trades,
         c_acctbal / 10000 - (c_custkey % 7) / 10 AS oos_sharpe, coalesce(k, 0) // 2 AS oos_trades
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey))"""


def ranking_oracles():
    o = {}
    o["max_drawdown"] = with_(PNL, *metrics(keys="run_id")[:3]) + f"SELECT run_id, {money('max_dd', 6)} AS max_dd FROM dd"
    poisson = ", ".join(str(t) for t in POISSON)
    o["bootstrap_pvalue"] = with_(
        PNL,
        "m AS (SELECT run_id, avg(net_pnl) AS mean, count(*) AS n FROM trades GROUP BY run_id)",
        "x0 AS (SELECT run_id, net_pnl, b, ((rn - 1) % 2147483647 * 48271 + b * 69621 + 7) % 2147483647 AS x FROM trades, range(0, 1000) r(b))",
        "x1 AS (SELECT run_id, net_pnl, b, (x * x % 2147483647 + x * 1 + b) % 2147483647 AS x FROM x0)",
        "x2 AS (SELECT run_id, net_pnl, b, (x * x % 2147483647 + x * 3 + b) % 2147483647 AS x FROM x1)",
        f"w AS (SELECT run_id, net_pnl, b, len(list_filter([{poisson}], lambda t: x > t)) AS w FROM x2)",
        "d AS (SELECT run_id, b, sum(w * net_pnl) / sum(w) AS mean_b FROM w GROUP BY run_id, b)",
    ) + """SELECT run_id, CASE WHEN max(n) < 5 THEN 1 ELSE round(avg(CASE WHEN abs(mean_b - mean) >= abs(mean) THEN 1.0 ELSE 0.0 END), 6) END AS p_value
        FROM d JOIN m USING (run_id) GROUP BY run_id"""
    o["temporal_split"] = with_(*BASE, SPLIT) + """
        SELECT split AS part, symbol, ts, rn FROM xs
        UNION ALL SELECT 'recent', symbol, ts, rn - (n - least(300, n - 100)) FROM x WHERE rn >= n - least(300, n - 100)
        UNION ALL SELECT 'tail', symbol, ts, rn FROM x WHERE rn >= n - 200"""
    o["walk_forward_folds"] = recursive(*walk("macd")) + "SELECT * FROM wf"
    o["walk_forward_summary"] = recursive(*walk("vwap")) + wf_summary("wf", "symbol")
    o["market_context"] = with_(*FULL) + f"""SELECT symbol, {', '.join(f"{money(f'avg(CASE WHEN regime = {r} THEN 1.0 ELSE 0.0 END)', 6)} AS share_{r}" for r in range(4))},
        arg_max(close, rn) AS last_price,
        {money('(arg_max(close, rn) - max(CASE WHEN rn = greatest(n - 300, 0) THEN close END)) / max(CASE WHEN rn = greatest(n - 300, 0) THEN close END) * 100', 6)} AS return_pct,
        {money('avg(volume)', 6)} AS avg_volume, {money('arg_max(adx_14, rn)', 6)} AS latest_adx FROM ind GROUP BY symbol"""
    o["equity_curve"] = recursive(*VWAP_TRADES) + f"""SELECT symbol, exit_ts, rn AS trade_rn, {money('10000 + sum(net_raw) OVER w', 2)} AS equity,
        {money('sum(net_raw) OVER w', 2)} AS total_pnl, {money('sum(fees) OVER w', 4)} AS total_fees, count(*) OVER w AS n_trades
        FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, rn ROWS UNBOUNDED PRECEDING)"""
    o["leaderboard_compact"] = with_(BOARD) + """SELECT CAST(run_id AS VARCHAR) AS run_id, generation, round(sharpe, 6) AS sharpe, n_trades,
        CASE WHEN generation >= 12 THEN round(oos_sharpe, 6) END AS oos_sharpe, CASE WHEN generation >= 12 THEN oos_trades END AS oos_trades,
        CASE WHEN generation >= 12 THEN CAST(overfit AS INT) END AS overfit FROM board WHERE CAST(run_id AS BIGINT) % 50 <> 7"""
    o["leaderboard_topk"] = with_(BOARD) + """SELECT run_id, round(sharpe, 6) AS sharpe, n_trades, round(oos_sharpe, 6) AS oos_sharpe
        FROM board WHERE n_trades > 0 AND sharpe >= 0.2 ORDER BY sharpe DESC, run_id LIMIT 25"""
    o["leaderboard_topk_per_group"] = with_(BOARD) + """SELECT generation, rank, run_id, round(sharpe, 6) AS sharpe FROM (
        SELECT *, row_number() OVER (PARTITION BY generation ORDER BY sharpe DESC, run_id) AS rank FROM board) WHERE rank <= 3"""
    o["leaderboard_digest"] = with_(BOARD) + """SELECT count(*) AS n_tested,
        count(*) FILTER (sharpe > 0 AND n_trades >= 30 AND NOT overfit) AS n_positive, count(*) FILTER (n_trades >= 10) AS n_ranked,
        count(*) FILTER (n_trades >= 10 AND sharpe > 0) AS n_ranked_positive, round(avg(sharpe) FILTER (n_trades >= 10), 6) AS mean_sharpe,
        count(*) FILTER (n_trades >= 10 AND oos_trades >= 10 AND NOT overfit) AS n_oos_passed, round(max(sharpe), 6) AS best_sharpe,
        (SELECT run_id FROM board ORDER BY sharpe DESC, run_id LIMIT 1) AS best_run FROM board"""
    o["lineage_chain"] = """WITH RECURSIVE c AS (SELECT o_orderkey AS strategy_id, 0 AS hop, o_orderkey AS node FROM orders
        UNION ALL SELECT c.strategy_id, c.hop + 1, node // 2 FROM c JOIN orders p ON p.o_orderkey = c.node // 2 WHERE c.node > 0)
        SELECT * FROM c"""
    return o


# external series -------------------------------------------------------------------------

TICK_OBS = "obs AS (SELECT symbol AS source, ts, price AS value FROM ticks)"
ORDER_OBS = "obs AS (SELECT o_orderpriority AS source, o_orderdate AS ts, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
NAMES = ("click", "error", "purchase", "signup", "view")
PIVOT = ", ".join(f"max(value) FILTER (source = '{n}') AS {n}" for n in NAMES)
WIDE = f"wide AS (SELECT ts, {PIVOT} FROM filled GROUP BY ts)"


def grid(seconds):
    us = seconds * 1000000
    return f"""grid AS (SELECT source, make_timestamp(CAST(t AS BIGINT)) AS ts FROM (
        SELECT source, unnest(range(CAST(floor(epoch_us(min(ts)) / {us}) AS BIGINT) * {us}, CAST(ceil(epoch_us(max(ts)) / {us}) AS BIGINT) * {us} + 1, {us})) AS t
        FROM obs GROUP BY source))"""


ASOF = "filled AS (SELECT g.source, g.ts, o.value, o.ts AS seen FROM grid g ASOF LEFT JOIN obs o ON g.source = o.source AND g.ts >= o.ts)"
ON_GRID = """pts AS (SELECT g.source, g.ts, o.value, row_number() OVER (PARTITION BY g.source ORDER BY g.ts) AS k
  FROM grid g LEFT JOIN obs o USING (source, ts))"""


def external_oracles():
    o = {}
    o["external_json_parse"] = """SELECT source, ts, arg_min(value, k) AS value FROM (
        SELECT o_orderpriority || '/' || (o_orderkey // 100) % 4 AS source, o_orderdate + INTERVAL 7305 DAYS AS ts, o_totalprice AS value,
          o_orderkey AS k FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 29 <> 0) GROUP BY source, ts"""
    o["external_csv_parse"] = """SELECT o_orderpriority AS source, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS value
        FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 19 <> 0 GROUP BY 1, 2"""
    o["external_retention"] = """WITH r AS (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'A' ELSE 'B' END AS source, o_orderdate AS ts,
          o_totalprice AS value, o_orderkey FROM orders)
        SELECT r.* FROM r WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS"""
    o["external_upsert"] = """SELECT 'orders' AS source, ts, arg_max(value, (late, k)) AS value, strftime(ts, '%Y-%m') AS month FROM (
        SELECT o_orderdate AS ts, o_totalprice AS value, o_orderkey AS k, o_orderkey % 3 = 0 AND o_orderdate >= TIMESTAMP '1998-01-01' AS late
        FROM orders) GROUP BY ts"""
    o["external_align_ffill"] = with_(TICKS, TICK_OBS, grid(3600), ASOF) + f"SELECT source, ts, {rounded('value')} FROM filled"
    faded = money("value * greatest(0, 1 - ((epoch_us(ts) - epoch_us(seen)) // 900000000) / 4)", 6)
    o["external_align_decay"] = with_(TICKS, TICK_OBS, grid(900), ASOF) + f"SELECT source, ts, {faded} AS value FROM filled"
    between = money("CASE WHEN nk IS NULL OR nk = pk THEN pv ELSE pv + (nv - pv) * (k - pk) / (nk - pk) END", 6)
    o["external_align_interpolate"] = with_(ORDER_OBS, grid(86400), ON_GRID,
        """nb AS (SELECT source, ts, value, k, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER a AS pk,
             last_value(value IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER b AS nk,
             first_value(value IGNORE NULLS) OVER b AS nv FROM pts
           WINDOW a AS (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING),
                  b AS (PARTITION BY source ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""") + \
        f"SELECT source, ts, {between} AS value FROM nb"
    w = "OVER (PARTITION BY source ORDER BY k)"
    total = money(f"CASE WHEN k > 1 THEN coalesce(value, 0) + coalesce(lag(value) {w}, 0) END", 6)
    mean = money(f"(value + lag(value) {w}) / 2", 6)
    o["external_align_sum_avg"] = with_(ORDER_OBS, grid(86400), ON_GRID) + f"""
        SELECT source, ts, {total} AS value, 'sum' AS method FROM pts UNION ALL SELECT source, ts, {mean} AS value, 'avg' AS method FROM pts"""
    o["features_join_external"] = with_(*BASE, TICK_OBS, grid(14400), ASOF, WIDE) + f"""
        SELECT symbol, x.ts, close, {', '.join(NAMES)}, last_value(view IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn) AS view_bound,
          0.0 AS nosuch FROM x LEFT JOIN wide USING (ts)"""
    columns = ("rsi_14", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21", "ema_50", "vwap", "obi", "ha_open", "ha_high",
               "ha_low", "ha_close", "atr_14", "adx_14")
    o["features_build"] = with_(*FULL, TICK_OBS, grid(14400), ASOF, WIDE) + \
        f"SELECT symbol, ts, {BAR_OUT}, {rounded(*columns)}, regime, {', '.join(NAMES)} FROM ind LEFT JOIN wide USING (ts)"
    return o


# tables and ingest -----------------------------------------------------------------------


def table_oracles():
    o = {}
    base = with_(TICKS, bars())
    o["klines_to_bars"] = with_(TICKS, bars(), rebar("r4", "bars", bucket(14400))) + f"SELECT symbol, ts, {BAR_OUT} FROM r4"
    first = "(SELECT symbol, date_trunc('day', min(ts)) AS d FROM bars GROUP BY symbol)"
    o["resample_calendar"] = with_(
        TICKS, bars(), f"b3 AS (SELECT bars.*, d FROM bars JOIN {first} USING (symbol))",
        rebar("c3", "b3", "CAST(d + INTERVAL 3 DAYS * (date_diff('day', d, ts) // 3) AS TIMESTAMP)"),
        rebar("cw", "bars", "CAST(date_trunc('week', ts) + INTERVAL 6 DAYS AS TIMESTAMP)"),
        rebar("cm", "bars", "CAST(last_day(ts) AS TIMESTAMP)"),
    ) + " UNION ALL ".join(f"SELECT symbol, ts, {BAR_OUT}, '{i}' AS interval FROM {t}" for i, t in (("3d", "c3"), ("1w", "cw"), ("1M", "cm")))
    o["rollup_5m_1h"] = with_(TICKS, bars("b5", bucket(300)), bars("b60", bucket(3600))) + " UNION ALL ".join(
        f"SELECT symbol, ts, {BAR_OUT}, '{i}' AS interval FROM {t}" for i, t in (("5m", "b5"), ("1h", "b60")))
    o["rollup_maintained"] = o["rollup_5m_1h"]
    o["bars_upsert"] = base + """SELECT 'test' AS exchange, symbol, ts, open, high, low,
        round(CASE WHEN hour(ts) % 2 = 0 THEN close + 2 ELSE close END, 6) AS close, volume, strftime(ts, '%Y-%m') AS month FROM bars"""
    o["bars_range_scan"] = base + """SELECT 'range' AS part, 'test' AS exchange, * FROM bars
        WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'
        UNION ALL SELECT 'days', 'test', * FROM bars WHERE ts >= TIMESTAMP '2024-01-26'"""
    o["bars_coverage"] = base + """SELECT 'test' AS exchange, symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol"""
    o["bars_append_compact"] = base + """SELECT 'test' AS exchange, symbol, ts, open, high, low, round(CASE WHEN hour(ts) % 2 = 1 THEN close
          WHEN ts >= TIMESTAMP '2024-01-26' THEN close + 3 ELSE close + 2 END, 6) AS close, volume FROM bars"""
    o["bars_manifest_coverage"] = o["bars_coverage"]
    o["bars_insert_ignore"] = base + """SELECT symbol, ts, open, high, low, round(CASE WHEN hour(ts) % 2 = 0 THEN close ELSE close + 1 END, 6) AS close, volume FROM bars"""
    o["bar_gaps"] = with_(*BASE) + GAPS
    o["incremental_new_rows"] = with_(TICKS, bars(), """m AS (SELECT symbol, max(ts) AS mark FROM bars WHERE symbol <> 'click'
          AND ts < CASE WHEN symbol = 'view' THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-20' END GROUP BY symbol)""") + """
        SELECT bars.* FROM bars LEFT JOIN m USING (symbol) WHERE mark IS NULL OR ts >= mark + INTERVAL 60 SECONDS"""
    sma = roll("avg", "close", 5)
    raised = money(f"{sma} + CASE WHEN hour(ts) % 2 = 0 THEN 1 ELSE 0 END", 6)
    o["features_upsert"] = with_(*BASE) + f"""SELECT symbol, ts, open, high, low, close, volume,
        {raised} AS sma_5, CAST(volume AS BIGINT) AS count,
        CASE WHEN hour(ts) % 2 = 0 THEN CAST(close > open AS VARCHAR) END AS up, strftime(ts, '%Y-%m') AS month FROM x"""
    o["features_range_scan"] = with_(*BASE, f"""f AS (SELECT symbol, ts, open, high, low, close, volume, {money(sma, 6)} AS sma_5,
          CAST(close > open AS VARCHAR) AS up, CAST(volume AS BIGINT) AS count FROM x)""") + """
        SELECT *, count(*) OVER s AS rows, min(ts) OVER s AS first_ts, max(ts) OVER s AS last_ts FROM f
        WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 06:00:00' WINDOW s AS (PARTITION BY symbol)"""
    win = "(PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
    h6, h12 = win.format(21600000), win.format(43200000)
    change = money("CASE WHEN count(*) OVER w >= 2 THEN (price - first_value(price) OVER w) / first_value(price) OVER w * 100 END", 6)
    o["trailing_return_30s"] = with_(TICKS) + f"""SELECT symbol, ts_ms, seq, price, count(*) OVER w AS ticks, {change} AS return_pct
        FROM ticks WINDOW w AS {h6}"""
    o["trailing_trade_flow"] = with_(TICKS, "t AS (SELECT *, price * qty AS pq, CASE WHEN is_buyer_maker THEN -price * qty ELSE price * qty END AS s FROM ticks)") + f"""
        SELECT symbol, ts_ms, seq, {money('sum(s) OVER a', 6)} AS cvd_short, {money('sum(s) OVER b', 6)} AS cvd_long,
          {money('sum(pq) OVER b / nullif(sum(qty) OVER b, 0)', 6)} AS vwap, count(*) OVER b AS trade_count
        FROM t WINDOW a AS {h6}, b AS {h12}"""
    o["feed_staleness"] = with_(TICKS) + """SELECT symbol, max(ts) AS last_ts,
        round((epoch_us(TIMESTAMP '2024-01-30 23:58:00') - epoch_us(max(ts))) / 1e6, 6) AS age_s,
        (epoch_us(TIMESTAMP '2024-01-30 23:58:00') - epoch_us(max(ts))) / 1e6 < 1200 AS alive FROM ticks GROUP BY symbol"""
    return o


# streaming -------------------------------------------------------------------------------


def stream_oracles(o):
    for name, source in {"stream_trailing_return": "trailing_return_30s", "stream_trade_flow": "trailing_trade_flow"}.items():
        o[name] = o[source]
    o["stream_features"] = with_(*FULL) + o["indicators_all"].rsplit("\n", 1)[-1]
    o["stream_rollup"] = with_(TICKS, bars()) + f"SELECT symbol, ts, {BAR_OUT} FROM bars"
    o["stream_bar_sink"] = with_(TICKS, bars()) + "SELECT 'bars' AS sink, * FROM bars UNION ALL SELECT 'copy', * FROM bars"
    o["stream_closed_bars"] = """SELECT symbol, open_time_ms, min(seq) AS seq, arg_min(close, seq) AS close, true AS is_closed FROM (
        SELECT event_type AS symbol, epoch_us(date_trunc('hour', ts)) // 1000 AS open_time_ms, event_id AS seq, value AS close FROM events
        WHERE event_id % 3 = 0) GROUP BY symbol, open_time_ms"""
    o["stream_bar_gaps"] = o["bar_gaps"]
    o["stream_parse_events"] = """WITH e AS (SELECT event_id AS seq, event_id % 4 AS kind, upper(event_type) || 'USDT' AS symbol, event_type AS asset,
          epoch_us(ts) // 1000 AS ms, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events WHERE event_id % 37 <> 0)
        SELECT seq, CASE WHEN kind < 2 THEN 'trade' WHEN kind = 2 THEN 'ticker' ELSE 'candle' END AS kind, symbol, asset,
          CASE WHEN kind = 2 AND seq % 3 <> 0 THEN ms + 5 ELSE ms END AS ts_ms, CASE WHEN kind < 3 THEN value END AS price,
          CASE WHEN kind < 2 THEN k END AS qty, CASE WHEN kind < 2 THEN CAST(seq % 8 < 4 AS INT) END AS is_buyer_maker,
          CASE WHEN kind = 3 THEN value END AS open, CASE WHEN kind = 3 THEN value END AS high, CASE WHEN kind = 3 THEN value END AS low,
          CASE WHEN kind = 3 THEN value END AS close, CASE WHEN kind = 3 THEN k END AS volume, CASE WHEN kind = 3 THEN CAST(seq % 3 = 0 AS INT) END AS is_closed
        FROM e"""
    exit_side = """CASE WHEN s.side = 0 THEN NULL
        WHEN (s.side = 1 AND b.high >= s.e * 1.5) OR (s.side = -1 AND b.low <= s.e * 0.5) THEN 'tp'
        WHEN (s.side = 1 AND b.low <= s.e * 0.6) OR (s.side = -1 AND b.high >= s.e * 1.4) THEN 'sl'
        WHEN b.rn - s.since >= 12 THEN 'horizon' END"""
    o["stream_episodes"] = recursive(
        *VWAP_SIG, "b AS (SELECT x.*, signal FROM x JOIN sig USING (symbol, rn))",
        f"""s AS (SELECT symbol, CAST(49 AS BIGINT) AS rn, 0 AS side, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS TIMESTAMP) AS ets, CAST(0 AS BIGINT) AS since,
               CAST(NULL AS VARCHAR) AS why, 0 AS cside, CAST(NULL AS DOUBLE) AS ce, CAST(NULL AS DOUBLE) AS cx, CAST(NULL AS TIMESTAMP) AS cts,
               CAST(NULL AS TIMESTAMP) AS xts, CAST(0 AS BIGINT) AS held
             FROM (SELECT DISTINCT symbol FROM b)
             UNION ALL
             SELECT symbol, rn, CASE WHEN side <> 0 AND w IS NULL THEN side ELSE signal END,
               CASE WHEN side <> 0 AND w IS NULL THEN e WHEN signal <> 0 THEN close END,
               CASE WHEN side <> 0 AND w IS NULL THEN ets WHEN signal <> 0 THEN ts END,
               CASE WHEN side <> 0 AND w IS NULL THEN since ELSE rn END, w, side, e,
               CASE w WHEN 'tp' THEN e * (1 + side * 0.5) WHEN 'sl' THEN e * (1 - side * 0.4) ELSE close END, ets, ts, rn - since
             FROM (SELECT b.symbol, b.rn, b.close, b.ts, b.signal, s.side, s.e, s.ets, s.since, {exit_side} AS w
                   FROM s JOIN b ON s.symbol = b.symbol AND b.rn = s.rn + 1))""",
    ) + f"""SELECT symbol, CASE WHEN cside = 1 THEN 'LONG' ELSE 'SHORT' END AS side, cts AS entry_ts, xts AS exit_ts, {money('ce', 2)} AS entry_price,
        {money('cx', 2)} AS exit_price, why AS exit_reason, held AS bars_held, {money('cside * (cx - ce) / ce * 50', 2)} AS gross_pnl, 0.1 AS fees,
        {money('cside * (cx - ce) / ce * 50 - 0.1', 2)} AS net_pnl FROM s WHERE why IS NOT NULL"""  # fmt: skip
    win = "(PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
    o["stream_candle_states"] = with_(*BASE, f"g AS ({GAPS})") + f"""
        SELECT symbol, 'gap' AS kind, NULL::BIGINT AS at_ms, from_ms, to_ms, missing, NULL::DOUBLE AS volume, NULL::BIGINT AS candles_ready, NULL::BIGINT AS gaps FROM g
        UNION ALL
        SELECT symbol, 'state', max(epoch_ms(ts)), NULL, NULL, NULL, {money('arg_max(volume, rn)', 6)}, count(*), coalesce(any_value(k), 0)
        FROM x LEFT JOIN (SELECT symbol, count(*) AS k FROM g GROUP BY symbol) USING (symbol) GROUP BY symbol"""
    o["stream_snapshot"] = with_(*BASE, "t AS (SELECT *, price * qty AS pq, CASE WHEN is_buyer_maker THEN -price * qty ELSE price * qty END AS s FROM ticks)",
        "last AS (SELECT symbol, arg_max(volume, rn) AS volume, count(*) AS candles_ready FROM x GROUP BY symbol)",
        """g AS (SELECT symbol, count(*) AS gaps FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM x)
             WHERE ts > p + INTERVAL 1 HOUR GROUP BY symbol)""") + f"""
        SELECT symbol, ts_ms, seq, price, return_pct, cvd_short, cvd_long, vwap, trade_count, volume, candles_ready, coalesce(gaps, 0) AS gaps
        FROM (SELECT symbol, ts_ms, seq, price, {money('CASE WHEN count(*) OVER a >= 2 THEN (price - first_value(price) OVER a) / first_value(price) OVER a * 100 END', 6)} AS return_pct,
          {money('sum(s) OVER a', 6)} AS cvd_short, {money('sum(s) OVER b', 6)} AS cvd_long,
          {money('sum(pq) OVER b / nullif(sum(qty) OVER b, 0)', 6)} AS vwap, count(*) OVER b AS trade_count,
          row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) AS k
          FROM t WINDOW a AS {win.format(21600000)}, b AS {win.format(43200000)}) JOIN last USING (symbol) LEFT JOIN g USING (symbol) WHERE k = 1"""
    return o
