"""SQL counterparts of the registered queries, in DuckDB's dialect.

The bar chain is written the long way on purpose: an explicit gap-free grid, joined and carried
forward, then row-based lags. The library computes the same values without those rows.
"""

from __future__ import annotations

# The columns of a bar, spelled out so that the SQL takes nothing from the library that it checks.
CARRIED = [
    "last_best_bid_size", "last_best_ask_size", "last_best_bid_price", "last_best_ask_price", "mean_best_bid_size",
    "mean_best_ask_size",
]
COUNTS = {
    "num_added_orders": "action = 'A'",
    "num_canceled_orders": "action = 'C'",
    "num_traded_orders": "action = 'T'",
}
FLOWS = {
    "added_bid": "action = 'A' AND side = 'B'",
    "canceled_bid": "action = 'C' AND side = 'B'",
    "added_ask": "action = 'A' AND side = 'A'",
    "canceled_ask": "action = 'C' AND side = 'A'",
}
QUOTE_STATS = [
    "mid_price_first", "weighted_mid_price_first", "mid_price_last", "weighted_mid_price_last", "last_spread",
    "last_best_bid_price", "last_best_ask_price", "last_best_bid_size", "last_best_ask_size", "mid_price_mean",
    "weighted_mid_price_mean", "mean_spread", "mean_best_bid_price", "mean_best_ask_price", "mean_best_bid_size",
    "mean_best_ask_size", "mean_second_ask_price", "mean_second_bid_price", "std_mid_price", "std_spread",
    "std_best_bid_size", "std_best_ask_size", "mid_price_high", "mid_price_low",
]
TRADE_STATS = [
    "trade_open", "trade_close", "trade_high", "trade_low",
]
BOOK = [
    "mid_price_variation", "mean_mid_price_variation", "weighted_mid_price_variation", "mid_price_variation_class",
    "mean_mid_price_variation_class", "next_5_mean_mid_price_variation_class", "weighted_mid_price_variation_class",
    "total_bid_volume", "total_ask_volume", "mean_order_book_imbalance", "last_order_book_imbalance",
    "total_net_order_flow", "num_added_orders", "num_canceled_orders", "num_traded_orders",
    "order_book_imbalance_5s", "order_flow_5s", "bid_volume_variation", "ask_volume_variation",
    "bid_price_variation", "ask_price_variation",
]
BAR_COLUMNS = [*QUOTE_STATS, *BOOK, *TRADE_STATS]

WIDE = {"symbols": 3, "rate_s": 3600}
DEEP = {"symbols": 1, "rate_s": 900}

CAL = ["time_since_open", "is_monday", "is_tuesday", "is_wednesday", "is_thursday", "is_friday"]
INTEGERS = {
    "last_best_bid_size",
    "last_best_ask_size",
    "total_net_order_flow",
    "bid_volume_variation",
    "ask_volume_variation",
    "bid_price_variation",
    "ask_price_variation",
    "total_bid_volume",
    "total_ask_volume",
    *COUNTS,
}
CLASSES = {c for c in BAR_COLUMNS if c.endswith("_class")} | {"is_monday", "is_tuesday", "is_wednesday", "is_thursday", "is_friday"}


def q(name: str) -> str:
    return f'"{name}"'


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.487) / 1e6"


def out(name: str) -> str:
    """A column in its output type."""
    if name in INTEGERS:
        return f"CAST({q(name)} AS BIGINT) AS {q(name)}"
    if name in CLASSES:
        return f"CAST({q(name)} AS INTEGER) AS {q(name)}"
    if name in ("symbol", "session", "bar_ts", "split"):
        return q(name)
    if name in ("bar_ix", "ord", "split_ord", "n_rows", "row_nr"):
        return f"CAST({q(name)} AS BIGINT) AS {q(name)}"
    return f"{r6(q(name))} AS {q(name)}"


def pick(names: list[str], table: str, where: str = "") -> str:
    return f"SELECT {', '.join(out(n) for n in names)} FROM {table} {where}"


def event_ticks(symbols: int) -> str:
    """The tick columns derived from ``events``."""
    return f"""SELECT CAST(user_id % {symbols} AS VARCHAR) AS symbol, CAST(ts AS DATE) AS session,
         epoch_us(ts) % 86400000000 AS tod, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'C' WHEN 'signup' THEN 'M' ELSE 'A' END AS action,
         CASE WHEN (event_id // 3) % 2 = 0 THEN 'B' ELSE 'A' END AS side,
         100 + floor(value) / 64 AS price, 1 + event_id % 100 AS size,
         CASE WHEN event_id % 97 <> 0 THEN 100 + floor(value) / 64 END AS bid,
         CASE WHEN event_id % 89 <> 0 THEN 100 + floor(value) / 64 + (1 + event_id % 5) / 64 END AS ask,
         (event_id * 7) % 50 AS bid_sz, (event_id * 13) % 40 AS ask_sz
  FROM events"""


#: A day whose rows lie in its file in the order of MIXED, and the event clock of the daily files, in microseconds.
MIXED_DAY, MIXED, COARSE_US = "2024-01-09", "event_id * 7919 % 1009", 600_000_000


def daily_rows(symbols: int) -> str:
    """The ticks of the daily files: ``row`` in the file, ``recv_us`` and the coarse ``event_us`` of the day."""
    return f"""SELECT *, tod AS recv_us, tod // {COARSE_US} * {COARSE_US} AS event_us, row_number() OVER (PARTITION BY symbol, session
      ORDER BY CASE WHEN session = DATE '{MIXED_DAY}' THEN {MIXED.replace('event_id', 'seq')} ELSE 0 END, seq) - 1 AS row
    FROM ({event_ticks(symbols)}) AS e WHERE isodow(session) <= 5"""


def daily_ticks(symbols: int, opens_us: int, closes_us: int) -> str:
    """Ticks of the daily files on the coarse clock, ordered by time, then row, inside the hours."""
    return f"""SELECT * REPLACE (event_us AS tod, row_number() OVER (PARTITION BY symbol, session ORDER BY event_us, row) AS seq)
    FROM ({daily_rows(symbols)}) AS r WHERE event_us BETWEEN {opens_us} AND {closes_us}"""


def chain(symbols: int, rate_s: int, ticks: str | None = None) -> str:
    """CTEs from ticks (those of ``events`` by default) to complete bars with labels and book features (``full_bars``)."""
    rate = rate_s * 1_000_000
    w = "(PARTITION BY symbol, session ORDER BY bar_ix)"
    s = "(PARTITION BY symbol, session)"
    upto = "(PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def first(x, f="TRUE"):
        return f"arg_min({x}, seq) FILTER (WHERE {x} IS NOT NULL AND {f})"

    def last(x, f="TRUE"):
        return f"arg_max({x}, seq) FILTER (WHERE {x} IS NOT NULL AND {f})"

    masks = {
        "added_bid": "action = 'A' AND side = 'B'",
        "canceled_bid": "action = 'C' AND side = 'B'",
        "added_ask": "action = 'A' AND side = 'A'",
        "canceled_ask": "action = 'C' AND side = 'A'",
    }
    kinds = {"num_added_orders": "A", "num_canceled_orders": "C", "num_traded_orders": "T"}
    assert list(masks) == list(FLOWS) and list(kinds) == list(COUNTS)
    spans = ", ".join(
        f"min(bar_ix) FILTER (WHERE {n} IS NOT NULL) AS {n}_lo, max(bar_ix) FILTER (WHERE {n} IS NOT NULL) AS {n}_hi"
        for n in [*masks, *kinds]
    )
    raw = [c for c in [*QUOTE_STATS, *TRADE_STATS] if c not in CARRIED]

    def inside(n):
        return f"g.bar_ix BETWEEN sp.{n}_lo AND sp.{n}_hi"

    def net(a, c):
        return f"CASE WHEN {inside(a)} AND {inside(c)} THEN coalesce(b.{a}, 0) - coalesce(b.{c}, 0) END"

    def var(x, y):
        return f"{x} / nullif({y}, 0) - 1"

    return f"""
ticks AS ({ticks or event_ticks(symbols)}),
priced AS (
  SELECT *, coalesce((ask + bid) / 2, ask, bid) AS mid, ask - bid AS spread,
         coalesce((ask * bid_sz + bid * ask_sz) / nullif(bid_sz + ask_sz, 0), ask, bid) AS wmid,
         tod // {rate} AS bar_ix
  FROM ticks),
occupied AS (
  SELECT symbol, session, bar_ix,
    {first('mid')} AS mid_price_first, {last('mid')} AS mid_price_last, max(mid) AS mid_price_high, min(mid) AS mid_price_low,
    avg(mid) AS mid_price_mean, stddev_samp(mid) AS std_mid_price,
    {first('wmid')} AS weighted_mid_price_first, {last('wmid')} AS weighted_mid_price_last, avg(wmid) AS weighted_mid_price_mean,
    {last('spread')} AS last_spread, avg(spread) AS mean_spread, stddev_samp(spread) AS std_spread,
    {last('bid')} AS last_best_bid_price, avg(bid) AS mean_best_bid_price,
    {last('ask')} AS last_best_ask_price, avg(ask) AS mean_best_ask_price,
    {last('bid_sz')} AS last_best_bid_size, avg(bid_sz) AS mean_best_bid_size, stddev_samp(bid_sz) AS std_best_bid_size,
    {last('ask_sz')} AS last_best_ask_size, avg(ask_sz) AS mean_best_ask_size, stddev_samp(ask_sz) AS std_best_ask_size,
    avg(ask + 1 / 64) AS mean_second_ask_price, avg(bid - 1 / 64) AS mean_second_bid_price,
    {first('price', "action = 'T'")} AS trade_open, {last('price', "action = 'T'")} AS trade_close,
    max(price) FILTER (WHERE action = 'T') AS trade_high, min(price) FILTER (WHERE action = 'T') AS trade_low,
    {', '.join(f"sum(size) FILTER (WHERE {m}) AS {n}" for n, m in masks.items())},
    {', '.join(f"nullif(count(*) FILTER (WHERE action = '{a}'), 0) AS {n}" for n, a in kinds.items())}
  FROM priced GROUP BY symbol, session, bar_ix),
spans AS (SELECT symbol, session, min(bar_ix) AS lo, max(bar_ix) AS hi, {spans} FROM occupied GROUP BY symbol, session),
bins AS (SELECT symbol, session, unnest(range(lo, hi + 1)) AS bar_ix FROM spans),
grid AS (
  SELECT g.symbol, g.session, g.bar_ix, b.mid_price_first IS NOT NULL OR b.bar_ix IS NOT NULL AS occupied,
    CAST(g.session AS TIMESTAMP) + to_microseconds(g.bar_ix * {rate}) AS bar_ts,
    row_number() OVER (PARTITION BY g.symbol, g.session ORDER BY g.bar_ix) AS grid_nr,
    {', '.join(f'b.{c}' for c in raw)},
    {', '.join(f"last_value(b.{c} IGNORE NULLS) OVER (PARTITION BY g.symbol, g.session ORDER BY g.bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in CARRIED)},
    {', '.join(f"CASE WHEN {inside(n)} THEN coalesce(b.{n}, 0) END AS {n}" for n in kinds)},
    {net('added_bid', 'canceled_bid')} AS total_bid_volume, {net('added_ask', 'canceled_ask')} AS total_ask_volume
  FROM bins g LEFT JOIN occupied b USING (symbol, session, bar_ix) JOIN spans sp USING (symbol, session)),
moves AS (
  SELECT *, {var('mid_price_last', 'mid_price_first')} AS mid_price_variation,
    {var('mid_price_mean', 'mid_price_first')} AS mean_mid_price_variation,
    {var('weighted_mid_price_last', 'weighted_mid_price_first')} AS weighted_mid_price_variation,
    (trunc(mean_best_bid_size) - trunc(mean_best_ask_size)) / nullif(mean_best_bid_size + mean_best_ask_size, 0) AS mean_order_book_imbalance,
    (last_best_bid_size - last_best_ask_size) / nullif(last_best_bid_size + last_best_ask_size, 0) AS last_order_book_imbalance,
    last_best_bid_size - last_best_ask_size AS total_net_order_flow
  FROM grid),
lagged AS (
  SELECT *,
    CASE WHEN abs(mid_price_variation) > 0 THEN sign(mid_price_variation) ELSE 0 END + 1 AS mid_price_variation_class,
    CASE WHEN mean_mid_price_variation >= 0 THEN 1 ELSE 0 END AS mean_mid_price_variation_class,
    CASE WHEN weighted_mid_price_variation > 0 THEN 1 ELSE 0 END AS weighted_mid_price_variation_class,
    CASE WHEN grid_nr > 4 AND (mean_mid_price_variation + lead(mean_mid_price_variation, 1) OVER {w} + lead(mean_mid_price_variation, 2) OVER {w}
      + lead(mean_mid_price_variation, 3) OVER {w} + lead(mean_mid_price_variation, 4) OVER {w}) / 5 > 0 THEN 1 ELSE 0 END AS next_5_mean_mid_price_variation_class,
    (lag(mean_order_book_imbalance, 4) OVER {w} + lag(mean_order_book_imbalance, 3) OVER {w} + lag(mean_order_book_imbalance, 2) OVER {w}
      + lag(mean_order_book_imbalance, 1) OVER {w} + mean_order_book_imbalance) / 5 AS order_book_imbalance_5s,
    (lag(total_net_order_flow, 4) OVER {w} + lag(total_net_order_flow, 3) OVER {w} + lag(total_net_order_flow, 2) OVER {w}
      + lag(total_net_order_flow, 1) OVER {w} + total_net_order_flow) / 5 AS order_flow_5s,
    last_best_bid_size - lag(last_best_bid_size) OVER {w} AS bid_volume_variation,
    last_best_ask_size - lag(last_best_ask_size) OVER {w} AS ask_volume_variation,
    trunc(last_best_bid_price) - lag(trunc(last_best_bid_price)) OVER {w} AS bid_price_variation,
    trunc(last_best_ask_price) - lag(trunc(last_best_ask_price)) OVER {w} AS ask_price_variation,
    {calendar(rate)}
  FROM moves),
full_bars AS (
  SELECT *, row_number() OVER {w} AS row_nr FROM lagged
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in BAR_COLUMNS)})"""


def calendar(rate: int) -> str:
    days = ["monday", "tuesday", "wednesday", "thursday", "friday"]
    flags = ", ".join(f"CASE WHEN isodow(session) = {k + 1} THEN 1 ELSE 0 END AS is_{d}" for k, d in enumerate(days))
    return f"(bar_ix * {rate} - 34200000000) / 1e6 AS time_since_open, {flags}"


def native_columns() -> dict[str, str]:
    """Window indicators on ``full_bars`` (all but the stochastic)."""
    h, lo, o, c, m = "mid_price_high", "mid_price_low", "mid_price_first", "mid_price_last", "mid_price_mean"
    w = "(PARTITION BY symbol, session ORDER BY bar_ix)"

    def roll(fn, x, n):
        frame = f"(PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN row_nr >= {n} THEN {fn}({x}) OVER {frame} END"

    cols = {f"OLL{n}": f"{o} - {roll('min', lo, n)}" for n in (3, 5, 10, 15)}
    cols |= {f"OHH{n}": f"{roll('max', h, n)} - {o}" for n in (3, 5)}
    cols |= {f"rmCO({n})": roll("avg", f"{c} - {o}", n) for n in (3, 4, 5, 6)}
    cols["CO"] = f"{c} - {o}"
    cols |= {f"C{k}O{k}": f"lag({c} - {o}, {k}) OVER {w}" for k in (1, 2, 3)}
    cols["range"] = f"{h} - {lo}"
    cols["OH1"] = f"lag({h} - {o}) OVER {w}"
    cols |= {f"MA_{n}": roll("avg", m, n) for n in (10, 20)}
    cols["HMA_10"] = f"({m} * 10 + " + " + ".join(f"lag({m}, {k}) OVER {w} * {10 - k}" for k in range(1, 10)) + ") / 55"
    mean, dev = roll("avg", m, 20), roll("stddev_pop", m, 20)
    cols["Bollinger_Upper"], cols["Bollinger_Lower"] = f"{mean} + 2 * {dev}", f"{mean} - 2 * {dev}"
    cols["U_minus_L"] = f"4 * {dev}"
    cols["MA20dSTD"] = roll("stddev_samp", c, 20)
    mid = f"({h} + {lo}) / 2"
    cols["AO_5_10"] = f"{roll('avg', mid, 5)} - {roll('avg', mid, 10)}"
    up, down = ([f"lag({x}, {k}) OVER {w}" if k else x for k in range(8)] for x in (h, lo))
    best_up, best_down = f"greatest({', '.join(up)})", f"least({', '.join(down)})"
    for name, best, vals in (("AROONU_7", best_up, up), ("AROOND_7", best_down, down)):
        ages = " ".join(f"WHEN {v} = {best} THEN {k}" for k, v in enumerate(vals))
        cols[name] = f"CASE WHEN row_nr >= 8 THEN 100.0 * (7 - CASE {ages} END) / 7 END"
    return cols


def indicator_chain() -> str:
    """CTEs from ``full_bars`` to ``technical`` (window and recursive indicators, before the drop)."""
    w = "(PARTITION BY symbol, session ORDER BY bar_ix)"
    upto = "(PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    seven = "(PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    three = "(PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    native = ", ".join(f"{e} AS {q(n)}" for n, e in native_columns().items())
    wilder = []
    for n in (5, 7, 10):
        for x in ("tr", "up", "dn"):
            seed = f"CASE WHEN b.row_nr = {n + 1} THEN b.{x}_sum{n} WHEN b.row_nr > {n + 1} THEN p.{x}{n} * (1 - 1.0 / {n}) + b.{x} END"
            wilder.append(f"{seed} AS {x}{n}")
    wsums = ", ".join(
        f"sum({x}) OVER (PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {x}_sum{n}"
        for n in (5, 7, 10)
        for x in ("tr", "up", "dn")
    )
    alpha = {"e8": "2.0 / 9", "e21": "2.0 / 22", "e15": "2.0 / 16"}
    m = "mid_price_mean"
    quick, calm = "2.0 / 3", "2.0 / 11"

    def ema_step(name, a):
        return f"{a} * b.{m} + (1 - {a}) * p.{name} AS {name}"

    dis = ", ".join(
        f"CASE WHEN tr{n} IS NULL THEN NULL WHEN tr{n} = 0 THEN 0 ELSE 100 * {x}{n} / tr{n} END AS {out_}_{n}"
        for n in (5, 7, 10)
        for x, out_ in (("up", "DMP"), ("dn", "DMN"))
    )
    dx = ", ".join(
        f"CASE WHEN DMP_{n} + DMN_{n} = 0 THEN 0 ELSE 100 * abs(DMP_{n} - DMN_{n}) / (DMP_{n} + DMN_{n}) END AS dx{n}" for n in (5, 7, 10)
    )
    dxsums = ", ".join(
        f"avg(dx{n}) OVER (PARTITION BY symbol, session ORDER BY bar_ix ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS dxm{n}" for n in (5, 7, 10)
    )
    adx = ", ".join(
        f"CASE WHEN b.row_nr = {2 * n} THEN b.dxm{n} WHEN b.row_nr > {2 * n} THEN (p.ADX_{n} * {n - 1} + b.dx{n}) / {n} END AS ADX_{n}"
        for n in (5, 7, 10)
    )
    return f"""
stoch_k AS (
  SELECT *, CASE WHEN row_nr >= 7 THEN 100 * (mid_price_last - min(mid_price_low) OVER {seven})
    / nullif(max(mid_price_high) OVER {seven} - min(mid_price_low) OVER {seven}, 0) END AS raw_k, {native}
  FROM full_bars),
stoch_d AS (SELECT *, CASE WHEN count(raw_k) OVER {three} = 3 THEN avg(raw_k) OVER {three} END AS raw_d FROM stoch_k),
windowed AS (
  SELECT *, last_value(raw_k IGNORE NULLS) OVER {upto} AS "STOCHk_7_3_3", last_value(raw_d IGNORE NULLS) OVER {upto} AS "STOCHd_7_3_3"
  FROM stoch_d),
steps AS (
  SELECT symbol, session, bar_ix, row_nr, {m},
    greatest(mid_price_high, lag(mid_price_last) OVER {w}) - least(mid_price_low, lag(mid_price_last) OVER {w}) AS tr0,
    mid_price_high - lag(mid_price_high) OVER {w} AS du, lag(mid_price_low) OVER {w} - mid_price_low AS dd,
    coalesce({m} - lag({m}) OVER {w}, 0) AS dm,
    abs({m} - lag({m}, 3) OVER {w}) AS far,
    abs({m} - lag({m}, 1) OVER {w}) + abs(lag({m}, 1) OVER {w} - lag({m}, 2) OVER {w}) + abs(lag({m}, 2) OVER {w} - lag({m}, 3) OVER {w}) AS path
  FROM full_bars),
directions AS (
  SELECT *, CASE WHEN row_nr > 1 THEN tr0 END AS tr, CASE WHEN row_nr > 1 THEN CASE WHEN du > dd AND du > 0 THEN du ELSE 0 END END AS up,
    CASE WHEN row_nr > 1 THEN CASE WHEN dd > du AND dd > 0 THEN dd ELSE 0 END END AS dn,
    power(coalesce(far / nullif(path, 0), 0) * ({quick} - {calm}) + {calm}, 2) AS kr
  FROM steps),
summed AS (SELECT *, {wsums} FROM directions),
walk AS (
  SELECT b.symbol, b.session, b.bar_ix, b.row_nr, b.{m} AS e8, b.{m} AS e21, b.{m} AS e15, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss,
    CAST(NULL AS DOUBLE) AS kama, CAST(NULL AS DOUBLE) AS sig,
    {', '.join(f'CAST(NULL AS DOUBLE) AS {x}{n}' for n in (5, 7, 10) for x in ('tr', 'up', 'dn'))}
  FROM summed b WHERE b.row_nr = 1
  UNION ALL
  SELECT b.symbol, b.session, b.bar_ix, b.row_nr, {', '.join(ema_step(n, a) for n, a in alpha.items())},
    greatest(b.dm, 0) / 7 + p.gain * (6.0 / 7) AS gain, greatest(-b.dm, 0) / 7 + p.loss * (6.0 / 7) AS loss,
    CASE WHEN b.row_nr = 3 THEN b.{m} WHEN b.row_nr > 3 THEN p.kama + b.kr * (b.{m} - p.kama) END AS kama,
    CASE WHEN b.row_nr = 21 THEN ({alpha['e8']} * b.{m} + (1 - {alpha['e8']}) * p.e8) - ({alpha['e21']} * b.{m} + (1 - {alpha['e21']}) * p.e21)
         WHEN b.row_nr > 21 THEN (1.0 / 3) * (({alpha['e8']} * b.{m} + (1 - {alpha['e8']}) * p.e8) - ({alpha['e21']} * b.{m} + (1 - {alpha['e21']}) * p.e21)) + (2.0 / 3) * p.sig END AS sig,
    {', '.join(wilder)}
  FROM walk p JOIN summed b ON b.symbol = p.symbol AND b.session = p.session AND b.row_nr = p.row_nr + 1),
di AS (SELECT *, {dis} FROM walk),
dxs AS (SELECT *, {dx} FROM di),
dxmeans AS (SELECT *, {dxsums} FROM dxs),
adx_walk AS (
  SELECT symbol, session, row_nr, {', '.join(f'CAST(NULL AS DOUBLE) AS ADX_{n}' for n in (5, 7, 10))} FROM dxmeans WHERE row_nr = 1
  UNION ALL
  SELECT b.symbol, b.session, b.row_nr, {adx}
  FROM adx_walk p JOIN dxmeans b ON b.symbol = p.symbol AND b.session = p.session AND b.row_nr = p.row_nr + 1),
technical AS (
  SELECT windowed.*, DMP_5, DMP_10, DMN_5, DMN_10, ADX_5, ADX_7, ADX_10,
    CASE WHEN windowed.row_nr >= 25 THEN e8 - e21 - sig END AS "MACD_8_21_5",
    CASE WHEN windowed.row_nr >= 7 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS "RSI_7",
    CASE WHEN windowed.row_nr >= 15 THEN e15 END AS "EMA_15", kama AS "KAMA_3_2_10"
  FROM windowed JOIN di USING (symbol, session, row_nr) JOIN adx_walk USING (symbol, session, row_nr))"""


def with_bars(select: str, scope: dict) -> str:
    return f"WITH RECURSIVE {chain(**scope)}\n{select}"


def with_indicators(select: str, scope: dict = DEEP, ticks: str | None = None) -> str:
    return f"WITH RECURSIVE {chain(**scope, ticks=ticks)},{indicator_chain()}\n{select}"
