"""Registered queries: name -> (Spark query, SQL or None).

Ticks come from ``events``. ``WIDE`` is three symbols on hourly bars, ``DEEP`` one symbol on 15-minute
bars (enough bars per session for the indicators). Every query reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import sql
from checks.sql import DEEP, WIDE, out, pick, q, r6, with_bars, with_indicators
from tidebook.functions.rates import time_of_day_us
from tidebook.operators import analysis, bars, book, calendar, dataset, evaluation, importance, indicators, labels, models
from tidebook.operators import recursive, series
from tidebook.plans import feature_table as ft
from tidebook.plans import ranking as rank
from tidebook.session import scratch_dir, written
from tidebook.sources import ticks as src

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
RATES = {3600: "1h", 900: "15min"}
KEYS = ["symbol", "session", "bar_ts"]


def register(name: str, oracle: str | None):
    def add(query: Query) -> Query:
        REGISTRY[name] = (lambda spark, folder: rounded(query(spark, folder)), oracle)
        return query

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals by a formula both engines evaluate alike.

    The boundary sits off the half, so that no exact binary or decimal fraction falls on it.
    """
    cols = [
        f"floor(`{f.name}` * 1e6D + 0.487D) / 1e6D AS `{f.name}`" if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields
    ]
    return df.selectExpr(*cols)


def ticks(spark, folder, scope=WIDE) -> DataFrame:
    return src.event_ticks(spark, folder, scope["symbols"])


def rate(scope) -> str:
    return RATES[scope["rate_s"]]


def occupied(spark, folder, scope=WIDE) -> DataFrame:
    return bars.bars(ticks(spark, folder, scope), rate(scope))


def complete(spark, folder, scope=WIDE) -> DataFrame:
    return ft.bar_features(ticks(spark, folder, scope), rate(scope))


def shown(df: DataFrame, columns: list[str], scope=WIDE) -> DataFrame:
    return bars.with_bar_time(df, rate(scope)).selectExpr(*KEYS, *[f"`{c}`" for c in columns])


# --- scans and ticks -------------------------------------------------------------------------------


@register(
    "tick_prices",
    with_bars(
        f"SELECT symbol, session, seq, {r6('mid')} AS mid_price, {r6('spread')} AS bid_ask_spread, {r6('wmid')} AS weighted_mid_price FROM priced",
        WIDE,
    ),
)
def tick_prices(spark, folder):
    return bars.tick_prices(ticks(spark, folder)).select(
        "symbol", "session", "seq", "mid_price", "bid_ask_spread", "weighted_mid_price"
    )


@register(
    "action_masks",
    with_bars(
        """SELECT symbol, session, action = 'T' AS is_trade, action = 'A' AS is_add, action = 'C' AS is_cancel, side = 'B' AS is_bid,
        side = 'A' AS is_ask, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM priced GROUP BY ALL""",
        WIDE,
    ),
)
def action_masks(spark, folder):
    keys = ["symbol", "session", "is_trade", "is_add", "is_cancel", "is_bid", "is_ask"]
    return bars.action_masks(ticks(spark, folder)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size")
    )


@register(
    "market_hours",
    with_bars("SELECT symbol, session, seq, tod AS tod_us FROM priced WHERE tod BETWEEN 34200000000 AND 57600000000", WIDE),
)
def market_hours(spark, folder):
    kept = src.market_hours(ticks(spark, folder))
    return kept.select("symbol", "session", "seq", F.expr(time_of_day_us()).alias("tod_us"))


@register(
    "business_days",
    """SELECT session, count(*) AS n_ticks FROM (SELECT CAST(ts AS DATE) AS session FROM events) t
    WHERE isodow(session) <= 5 GROUP BY session""",
)
def business_days(spark, folder):
    all_ticks = ticks(spark, folder)
    first, last = all_ticks.agg(F.min("session"), F.max("session")).first()
    days = src.business_days(spark, str(first), str(last))
    counts = all_ticks.groupBy("session").agg(F.count(F.lit(1)).alias("n_ticks"))
    return days.join(counts, "session")


@register(
    "missing_sessions",
    """WITH have AS (SELECT DISTINCT CAST(user_id % 500 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS session FROM events),
    days AS (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS session
             FROM (SELECT CAST(min(session) AS TIMESTAMP) AS lo, CAST(max(session) AS TIMESTAMP) AS hi FROM have))
    SELECT s.symbol, d.session FROM (SELECT DISTINCT symbol FROM have) s, days d
    WHERE isodow(d.session) <= 5 AND NOT EXISTS (SELECT 1 FROM have h WHERE h.symbol = s.symbol AND h.session = d.session)""",
)
def missing_sessions(spark, folder):
    many = src.event_ticks(spark, folder, 500)
    first, last = many.agg(F.min("session"), F.max("session")).first()
    return src.missing_sessions(many, str(first), str(last))


@register(
    "tick_table_scan",
    with_bars(
        """SELECT symbol, session, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size, count(bid) AS n_bid, sum(ask) AS sum_ask
        FROM priced WHERE session BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' GROUP BY symbol, session""",
        WIDE,
    ),
)
def tick_table_scan(spark, folder):
    path = f"{scratch_dir(spark)}/ticks-{uuid.uuid4().hex}"
    src.write_features(ticks(spark, folder), path)
    days = src.read_tick_table(spark, path, "2024-01-08", "2024-01-19")
    return days.groupBy("symbol", "session").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("total_size"),
        F.count("bid_px_00").alias("n_bid"),
        F.sum("ask_px_00").alias("sum_ask"),
    )


@register(
    "days_union",
    with_bars(
        "SELECT session, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM priced GROUP BY session", WIDE
    ),
)
def days_union(spark, folder):
    """Daily files of the weekdays and of the weekends, each read as one list of paths, put together."""
    where, days = daily_folder(spark, folder, WIDE["symbols"])
    symbols = [str(k) for k in range(WIDE["symbols"])]
    weekend, week = [[d for d in days if (d.weekday() >= 5) == late] for late in (True, False)]
    read = [src.read_daily_ticks(spark, src.daily_paths(where, some, symbols, src.DAILY_FOLDERS), "ts_recv") for some in (week, weekend)]
    whole = read[0].unionByName(read[1])
    return whole.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"))


def daily_folder(spark, folder, symbols: int) -> tuple[str, list]:
    """Daily files of the ticks with two nanosecond clocks, a coarse one with many ties and a fine one; the rows of
    one day are not in order. Returns the folder and the days."""
    path = f"{scratch_dir(spark)}/daily-{uuid.uuid4().hex}"
    # Tick columns, and the order of the rows in their file.
    every = src.event_ticks(spark, folder, symbols).withColumns(
        {
            "ts_event": F.expr(f"ts_us DIV {sql.COARSE_US} * {sql.COARSE_US} * 1000"),
            "ts_recv": F.expr("ts_us * 1000 + 777"),
            "place": F.expr(f"CASE WHEN session = DATE'{sql.MIXED_DAY}' THEN {sql.MIXED.replace('event_id', 'seq')} ELSE 0 END"),
        }
    )
    days = [r["session"] for r in every.select("session").distinct().collect()]  # one row per day
    src.write_daily_ticks(every.drop("ts_us"), path, ["place", "seq"])
    return path, sorted(days)


@register(
    "daily_scan",
    f"""SELECT symbol, session, clock, CAST(row AS BIGINT) AS seq, CAST(epoch_us(CAST(session AS TIMESTAMP)) + CASE clock WHEN 'event' THEN event_us ELSE recv_us END AS BIGINT) AS ts_us,
      action, side, {r6('price')} AS price, {r6('bid')} AS bid_px_00, {r6('ask')} AS ask_px_00, CAST(size AS BIGINT) AS size
    FROM ({sql.daily_rows(1)}) AS r, (VALUES ('event'), ('receive')) AS c(clock)""",
)
def daily_scan(spark, folder):
    """All daily files of the business days on both clocks."""
    where, days = daily_folder(spark, folder, 1)
    paths = src.daily_paths(where, ft.weekdays_between(str(days[0]), str(days[-1])), ["0"], src.DAILY_FOLDERS)
    clocks = {"event": "ts_event", "receive": "ts_recv"}
    event, receive = [src.read_daily_ticks(spark, paths, column).withColumn("clock", F.lit(name)) for name, column in clocks.items()]
    return event.unionByName(receive).select("symbol", "session", "clock", "seq", "ts_us", "action", "side", "price", "bid_px_00", "ask_px_00", "size")


@register(
    "head",
    with_bars(
        f"SELECT symbol, session, seq, {r6('mid')} AS mid_price FROM priced ORDER BY session, seq LIMIT 5",
        WIDE,
    ),
)
def head(spark, folder):
    return (
        bars.tick_prices(ticks(spark, folder)).orderBy("session", "seq").limit(5).select("symbol", "session", "seq", "mid_price")
    )


# --- bars ------------------------------------------------------------------------------------------


def bar_query(name: str, columns: list[str], make: Query, table: str, scope=WIDE, where: str = ""):
    register(name, with_bars(pick([*KEYS, *columns], table, where), scope))(
        lambda spark, folder: shown(make(spark, folder), columns, scope)
    )


STD = list(bars.DEVIATION)
CORE = [c for c in bars.QUOTE_STATS if c not in STD]
NET = ["total_bid_volume", "total_ask_volume"]
bar_query("bars_core", CORE, occupied, "grid", where="WHERE occupied")
bar_query("bars_deviation", STD, occupied, "grid", where="WHERE occupied")
bar_query("bars_trade_ohlc", bars.TRADE_STATS, occupied, "grid", where="WHERE occupied")
bar_query("bars_net_volume", NET, occupied, "grid", where="WHERE occupied")
bar_query("bars_action_counts", list(bars.COUNTS), occupied, "grid", where="WHERE occupied")
bar_query(
    "bars_dense_ffill",
    [*bars.CARRIED, *bars.COUNTS, *NET, "mid_price_last", "mean_best_bid_price"],
    lambda s, f: bars.dense_grid(ticks(s, f), rate(WIDE)),
    "grid",
)
bar_query("bars_full", book.BAR_COLUMNS, complete, "full_bars")


@register("bars_safe_order", with_bars(pick([*KEYS, *bars.FIRST, *bars.LAST, "trade_open", "trade_close"], "grid", "WHERE occupied"), WIDE))
def bars_safe_order(spark, folder):
    """First and last by (time, order) instead of by order alone."""
    safe = bars.bars(ticks(spark, folder), rate(WIDE), order=("ts_us", "seq"))
    return shown(safe, [c for c in [*bars.FIRST, *bars.LAST, "trade_open", "trade_close"]])


# --- labels and book features ----------------------------------------------------------------------


def labelled(spark, folder, scope=WIDE):
    return labels.labels(occupied(spark, folder, scope))


def booked(spark, folder, scope=WIDE):
    return book.book_features(occupied(spark, folder, scope))


MOVE_CLASSES = [c for c in book.LABELS if not c.startswith("next_5")]
bar_query("labels", [*book.MOVES, *MOVE_CLASSES], labelled, "lagged", where="WHERE occupied")
bar_query("label_next5", ["next_5_mean_mid_price_variation_class"], labelled, "lagged", where="WHERE occupied")
bar_query("label_next5_deep", ["next_5_mean_mid_price_variation_class"], lambda s, f: labelled(s, f, DEEP), "lagged", DEEP, "WHERE occupied")
IMBALANCE = ["mean_order_book_imbalance", "last_order_book_imbalance", "total_net_order_flow"]
ROLLED = ["order_book_imbalance_5s", "order_flow_5s"]
DELTAS = ["bid_volume_variation", "ask_volume_variation", "bid_price_variation", "ask_price_variation"]
bar_query("imbalance", IMBALANCE, booked, "lagged", where="WHERE occupied")
bar_query("rolling_flow", ROLLED, booked, "lagged", where="WHERE occupied")
bar_query("book_deltas", DELTAS, booked, "lagged", where="WHERE occupied")


@register(
    "label_threshold",
    with_bars(
        """SELECT symbol, session, bar_ts, CAST(CASE WHEN abs(mid_price_variation) > 0.002 THEN sign(mid_price_variation) ELSE 0 END + 1 AS INTEGER)
        AS mid_price_variation_class, CAST(CASE WHEN mean_mid_price_variation > 0 THEN 1 ELSE 0 END AS INTEGER) AS mean_mid_price_variation_class
        FROM lagged WHERE occupied""",
        WIDE,
    ),
)
def label_threshold(spark, folder):
    """A flat band of 0.2 %, and an unchanged mean counted as down."""
    banded = labels.labels(occupied(spark, folder), threshold=0.002, zero_is_up=False)
    return shown(banded, ["mid_price_variation_class", "mean_mid_price_variation_class"])


@register(
    "label_next_bar",
    with_bars(
        """SELECT * FROM (SELECT symbol, session, bar_ts, CAST(lead(mean_mid_price_variation_class) OVER (PARTITION BY symbol ORDER BY bar_ts)
        AS INTEGER) AS mean_mid_price_variation_class FROM full_bars) t WHERE mean_mid_price_variation_class IS NOT NULL""",
        WIDE,
    ),
)
def label_next_bar(spark, folder):
    table = written(complete(spark, folder).select("symbol", "session", "bar_ix", "mean_mid_price_variation_class"), "bars")
    return shown(labels.next_bar_target(table, "mean_mid_price_variation_class"), ["mean_mid_price_variation_class"])


# --- indicators ------------------------------------------------------------------------------------


def deep_bars(spark, folder):
    return complete(spark, folder, DEEP)


def indicator_query(name: str, columns: list[str], make: Callable[[DataFrame], DataFrame]):
    register(name, with_indicators(pick([*KEYS, *columns], "technical")))(
        lambda spark, folder: shown(make(deep_bars(spark, folder)), columns, DEEP)
    )


for _name, _columns, _family in [
    ("open_extremes", ["OLL3", "OLL5", "OLL10", "OLL15", "OHH3", "OHH5"], indicators.open_extremes),
    ("rolling_co", [f"rmCO({n})" for n in (3, 4, 5, 6)], indicators.close_open),
    ("lags_range", ["CO", "C1O1", "C2O2", "C3O3", "range", "OH1"], indicators.close_open),
    ("sma_wma", ["MA_10", "MA_20", "HMA_10"], indicators.moving_averages),
    ("bollinger", ["Bollinger_Upper", "Bollinger_Lower", "U_minus_L", "MA20dSTD"], indicators.bollinger),
    ("aroon", ["AROONU_7", "AROOND_7"], indicators.aroon),
    ("awesome", ["AO_5_10"], indicators.awesome),
]:
    indicator_query(_name, _columns, lambda df, family=_family: indicators.with_families(df, family()))
indicator_query(
    "stochastic",
    ["STOCHk_7_3_3", "STOCHd_7_3_3"],
    lambda df: indicators.carried_stochastic(indicators.with_families(df, indicators.stochastic())),
)
for _name, _columns in [
    ("ema", ["EMA_15"]),
    ("macd", ["MACD_8_21_5"]),
    ("rsi", ["RSI_7"]),
    ("kama", ["KAMA_3_2_10"]),
    ("adx_dmi", ["ADX_5", "ADX_7", "ADX_10", "DMP_5", "DMP_10", "DMN_5", "DMN_10"]),
]:
    # In blocks of sixteen bars, as sessions of very many bars are; ``feature_table`` takes a session in one.
    indicator_query(_name, _columns, lambda df: recursive.recursive_indicators(df, block_rows=16))

bar_query("calendar", ft.CALENDAR, lambda s, f: calendar.calendar_features(occupied(s, f), rate(WIDE)), "lagged", where="WHERE occupied")


@register(
    "market_session",
    with_bars(
        "SELECT symbol, session, bar_ts, CASE WHEN time_since_open > 12600 THEN 1 ELSE 0 END AS market_session FROM lagged WHERE occupied",
        WIDE,
    ),
)
def market_session(spark, folder):
    timed = calendar.calendar_features(occupied(spark, folder), rate(WIDE))
    return shown(calendar.market_session(timed), ["market_session"])


FEATURES = [*book.BAR_COLUMNS, *ft.INDICATORS, *ft.CALENDAR]


@register(
    "feature_table",
    with_indicators(pick([*KEYS, *FEATURES], "technical", "WHERE " + " AND ".join(f"{q(c)} IS NOT NULL" for c in ft.INDICATORS))),
)
def feature_table(spark, folder):
    return ft.features_of(ticks(spark, folder, DEEP), rate(DEEP)).drop("bar_ix")


#: Aroon with the earliest of equal extremes, and an unchanged mean counted as down.
DAILY_SQL = {
    **{
        name: "CASE WHEN row_nr >= 8 THEN 100.0 * (7 - CASE " + " ".join(f"WHEN lag({x}, {k}) OVER w8 = {best}({x}) OVER w8b THEN {k}" for k in range(7, 0, -1)) + " ELSE 0 END) / 7 END"
        for name, x, best in (("AROONU_7", "mid_price_high", "max"), ("AROOND_7", "mid_price_low", "min"))
    },
    "mean_mid_price_variation_class": "CASE WHEN mean_mid_price_variation > 0 THEN 1 ELSE 0 END",
}


def daily_sql() -> str:
    columns = ", ".join(out(c) for c in [*KEYS, *FEATURES])
    replaced = ", ".join(f"{e} AS {q(c)}" for c, e in DAILY_SQL.items())
    kept = " AND ".join(f"{q(c)} IS NOT NULL" for c in ft.INDICATORS)
    by = "PARTITION BY symbol, session ORDER BY bar_ix"
    tail = f"""SELECT {columns} FROM (SELECT * REPLACE ({replaced}) FROM technical
      WINDOW w8 AS ({by}), w8b AS ({by} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS t WHERE {kept}"""
    return with_indicators(tail, DEEP, sql.daily_ticks(1, 2 * 3_600_000_000, 23 * 3_600_000_000))


@register("daily_feature_table", daily_sql())
def daily_feature_table(spark, folder):
    """The feature table from daily files: the coarse clock, whose ties rows decide, a day out of order, and options."""
    where, days = daily_folder(spark, folder, 1)
    table = ft.feature_table(
        spark, where, str(days[0]), str(days[-1]), "15min", symbols=["0"], time_col="ts_event", zero_is_up=False, time_ordered=False,
        hours=("02:00", "23:00"), ties="earliest", pattern=src.DAILY_FOLDERS,
    )
    return table.drop("bar_ix")


# --- datasets --------------------------------------------------------------------------------------

SEQ_FEATURES = dataset.FEATURE_SETS["classifier"]
TARGET = "mean_mid_price_variation_class"


def model_table(spark, folder, scope=WIDE) -> DataFrame:
    """Complete bars with calendar columns, written once."""
    timed = calendar.calendar_features(complete(spark, folder, scope), rate(scope))
    columns = ["symbol", "session", "bar_ix", *book.BAR_COLUMNS, *ft.CALENDAR]
    return written(timed.select(*columns), "features")


def split_table(spark, folder) -> DataFrame:
    return dataset.chronological_split(dataset.with_positions(model_table(spark, folder)))


SPLIT = """,
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS ord, count(*) OVER (PARTITION BY symbol) AS n_rows FROM full_bars),
divided AS (SELECT *, CASE WHEN ord < floor(n_rows * 0.7::DOUBLE) THEN 'train'
  WHEN ord < floor(n_rows * 0.7::DOUBLE) + floor(n_rows * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed),
splits AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY ord) - 1 AS split_ord FROM divided)"""


def with_split(select: str) -> str:
    return f"WITH RECURSIVE {sql.chain(**WIDE)}{SPLIT}\n{select}"


@register("chrono_split", with_split(pick([*KEYS, "ord", "n_rows", "split", "split_ord"], "splits")))
def chrono_split(spark, folder):
    return shown(split_table(spark, folder), ["ord", "n_rows", "split", "split_ord"])


LOOK_BACK = 12


def exploded(seqs: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """One row per step of a sequence."""
    steps = seqs.select("symbol", "split", "split_ord", *targets, F.posexplode("x").alias("step", "row"))
    values = [F.col("row")[i].alias(c) for i, c in enumerate(features)]
    return steps.select("symbol", "split", "split_ord", "step", *values, *targets)


def sequence_sql(features: list[str], targets: dict[str, str], scaled: bool) -> str:
    joined = "splits l JOIN splits f ON f.symbol = l.symbol AND f.split = l.split AND f.split_ord BETWEEN l.split_ord - {k} AND l.split_ord - 1"
    ends = f"(PARTITION BY l.symbol, l.split, l.split_ord)"

    def value(c):
        if not scaled:
            return r6(f"f.{c}")
        lo, hi = f"min(f.{c}) OVER {ends}", f"max(f.{c}) OVER {ends}"
        return r6(f"CASE WHEN {hi} = {lo} THEN 0 ELSE (f.{c} - {lo}) / ({hi} - {lo}) END")

    labels_ = ", ".join(f"{e} AS {n}" for n, e in targets.items())
    return with_split(
        f"""SELECT l.symbol, l.split, CAST(l.split_ord AS BIGINT) AS split_ord,
        CAST(f.split_ord - l.split_ord + {LOOK_BACK} AS INTEGER) AS step, {', '.join(f'{value(c)} AS {c}' for c in features)}, {labels_}
        FROM {joined.format(k=LOOK_BACK)} WHERE l.split_ord >= {LOOK_BACK}"""
    )


Y = {"y": f"CAST(l.{TARGET} AS INTEGER)"}


@register("sequences", sequence_sql(SEQ_FEATURES, Y, scaled=False))
def sequences(spark, folder):
    seqs = dataset.sequences(split_table(spark, folder), SEQ_FEATURES, TARGET, LOOK_BACK, scale=None, chunk_rows=64)
    return exploded(seqs, SEQ_FEATURES, ["y"])


@register("sequences_scaled", sequence_sql(SEQ_FEATURES, Y, scaled=True))
def sequences_scaled(spark, folder):
    seqs = dataset.sequences(split_table(spark, folder), SEQ_FEATURES, TARGET, LOOK_BACK)
    return exploded(seqs, SEQ_FEATURES, ["y"])


TWO = ["mid_price_variation", "std_mid_price"]


@register("sequences_two_targets", sequence_sql(["mean_spread", "time_since_open"], {t: r6(f"l.{t}") for t in TWO}, scaled=False))
def sequences_two_targets(spark, folder):
    seqs = dataset.sequences(split_table(spark, folder), ["mean_spread", "time_since_open"], TWO, LOOK_BACK, scale=None)
    return exploded(seqs, ["mean_spread", "time_since_open"], TWO)


def scaler_sql(columns: list[str], center: str, width: str) -> str:
    fits = ", ".join(f"{center.format(c)} AS {c}_m, coalesce(nullif({width.format(c)}, 0), 1) AS {c}_s" for c in columns)
    values = ", ".join(f"{r6(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in columns)
    return with_split(
        f"SELECT symbol, session, bar_ts, split, {values} FROM splits, (SELECT {fits} FROM splits WHERE split = 'train') t"
    )


def scaled_by(kind: str, columns: list[str]):
    def query(spark, folder):
        table = written(split_table(spark, folder), "split")
        fitted = dataset.fit_scaler(table.where("split = 'train'"), columns, kind)
        return shown(dataset.scale(table, fitted), ["split", *columns])

    return query


MINMAX = ["time_since_open", "mean_spread", "num_added_orders"]
STANDARD = ["total_ask_volume", "total_bid_volume", "mid_price_variation", "std_mid_price", "mid_price_mean"]
register("minmax_global", scaler_sql(MINMAX, "min({0})", "max({0}) - min({0})"))(scaled_by("minmax", MINMAX))
register("standard_global", scaler_sql(STANDARD, "avg({0})", "stddev_pop({0})"))(scaled_by("standard", STANDARD))


@register(
    "inverse_scaling",
    with_split(f"SELECT symbol, session, bar_ts, split, {', '.join(f'{r6(c)} AS {c}_hat' for c in TWO)} FROM splits"),
)
def inverse_scaling(spark, folder):
    table = written(split_table(spark, folder), "split")
    fitted = dataset.fit_scaler(table.where("split = 'train'"), TWO, "standard")
    guessed = dataset.scale(table, fitted).withColumns({f"{c}_hat": F.col(c) for c in TWO})
    return shown(dataset.unscale(guessed, fitted, {f"{c}_hat": c for c in TWO}), ["split", *[f"{c}_hat" for c in TWO]])


# --- analysis --------------------------------------------------------------------------------------

NUMERIC = [c for c in book.BAR_COLUMNS if c not in book.LABELS]


def describe_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS feature, count({c}) AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min,
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q25, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS q50,
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q75, {r6(f'max({c})')} AS max FROM full_bars"""
        for c in NUMERIC
    ]
    return with_bars(" UNION ALL ".join(rows), WIDE)


@register("describe", describe_sql())
def describe(spark, folder):
    return analysis.describe(model_table(spark, folder), NUMERIC)


CORR = dataset.FEATURE_SETS["classifier"]


@register(
    "correlation",
    with_bars(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({a}, {b})')} AS r FROM full_bars" for a in CORR for b in CORR
        ),
        WIDE,
    ),
)
def correlation(spark, folder):
    return analysis.correlation(model_table(spark, folder), CORR)


SMALL = ["std_mid_price", "mean_mid_price_variation", "weighted_mid_price_variation", "total_net_order_flow"]


def small_sql(value: str) -> str:
    return with_bars(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({value.format(c=a)}, {value.format(c=b)})')} AS r FROM full_bars" for a in SMALL for b in SMALL
        ),
        WIDE,
    )


@register("correlation_small_moves", small_sql("{c} * 1e-7::DOUBLE"))
def correlation_small_moves(spark, folder):
    table = model_table(spark, folder).select(*[(F.col(c).cast("double") * F.lit(1e-7)).alias(c) for c in SMALL])
    return analysis.correlation(table, SMALL)


@register("correlation_with_nulls", small_sql("CASE WHEN {c} > 0 THEN CAST({c} AS DOUBLE) END"))
def correlation_with_nulls(spark, folder):
    table = model_table(spark, folder).select(*[F.when(F.col(c) > 0, F.col(c).cast("double")).alias(c) for c in SMALL])
    return analysis.correlation(table, SMALL)


@register("class_counts", with_bars('SELECT CAST(mid_price_variation_class AS INTEGER) AS "class", count(*) AS n FROM full_bars GROUP BY 1', WIDE))
def class_counts(spark, folder):
    return analysis.class_counts(complete(spark, folder), "mid_price_variation_class")


@register("classes", with_bars('SELECT DISTINCT CAST(mean_mid_price_variation_class AS INTEGER) AS "class" FROM full_bars', WIDE))
def classes(spark, folder):
    return analysis.classes(complete(spark, folder), TARGET)


@register(
    "top_correlated",
    with_bars(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {r6(f'abs(corr({c}, mean_mid_price_variation))')} AS score FROM full_bars"
            for c in CORR
            if c != "mean_mid_price_variation"
        )
        + ") t ORDER BY score DESC, feature LIMIT 5",
        WIDE,
    ),
)
def top_correlated(spark, folder):
    target = "mean_mid_price_variation"
    pairs = analysis.correlation(model_table(spark, folder), CORR).where((F.col("feature_b") == target) & (F.col("feature_a") != target))
    return analysis.top(pairs.select(F.col("feature_a").alias("feature"), F.abs("r").alias("score")), "score", 5)


MI_BINS = 10


# Columns that both engines hold exactly, so that values equal to an edge are equal in both.
EXACT = ["total_bid_volume", "total_ask_volume", "last_best_bid_price", "last_best_ask_price", "last_best_bid_size", "last_best_ask_size", "last_spread", "num_added_orders"]


def mutual_info_sql() -> str:
    moved = f"(SELECT *, lead({TARGET}) OVER (PARTITION BY symbol ORDER BY bar_ts) AS cls FROM full_bars)"
    rows = f"(SELECT * FROM {moved} m WHERE cls IS NOT NULL)"
    parts = [
        f"""SELECT '{c}' AS feature, {r6('sum(n * 1.0 / total * ln(n * 1.0 * total / (in_bin * in_class)))')} AS mutual_information FROM (
        SELECT n, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY bin) AS in_bin, sum(n) OVER (PARTITION BY cls) AS in_class FROM (
        SELECT bin, cls, count(*) AS n FROM (
        SELECT len(list_filter(edges, lambda e: e < x)) AS bin, cls FROM (SELECT {c} AS x, cls FROM {rows} f) v,
        (SELECT list_distinct(list(x)) AS edges FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) AS rk, count(*) OVER () AS n FROM {rows} g) o
        WHERE rk IN ({', '.join(f'greatest(CAST(ceil(n * {k} / {MI_BINS}) AS BIGINT), 1)' for k in range(1, MI_BINS))})) e) b GROUP BY bin, cls) j) s"""
        for c in EXACT
    ]
    return with_bars(" UNION ALL ".join(parts), WIDE)


@register("mutual_info", mutual_info_sql())
def mutual_info(spark, folder):
    """What the features tell about the class of the next bar."""
    table = written(labels.next_bar_target(model_table(spark, folder).select("symbol", "session", "bar_ix", *EXACT, TARGET), TARGET), "next")
    return analysis.mutual_information(table, EXACT, TARGET, MI_BINS)


# --- evaluation, on deterministic pseudo-predictions ------------------------------------------------

MODELS, NUM_CLASSES = 3, 3
LOGIT = "((event_id * (7 + 4 * {m}) + user_id * (3 + {k}) + {k} * 29) % 101) / 25.0"

GUESSES = (
    "guesses AS (SELECT event_id AS row_id, m AS model_id, CAST((event_id * 5 + user_id) % 3 AS INTEGER) AS y, ["
    + ", ".join(f"CAST({LOGIT.format(m='m', k=k)} AS DOUBLE)" for k in range(NUM_CLASSES))
    + f"] AS scores FROM events, (SELECT unnest(range({MODELS})) AS m) ms), "
    + "powers AS (SELECT *, list_transform(scores, lambda s: exp(s - list_max(scores))) AS e FROM guesses), "
    + "soft AS (SELECT row_id, model_id, y, list_transform(e, lambda v: v / (e[1] + e[2] + e[3])) AS p FROM powers), "
    + "single AS (SELECT *, CAST(CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 0 WHEN p[2] >= p[3] THEN 1 ELSE 2 END AS INTEGER) AS yhat FROM soft), "
    + "pooled AS (SELECT row_id, max(y) AS y, count(*) FILTER (WHERE yhat = 0) AS v0, count(*) FILTER (WHERE yhat = 1) AS v1, "
    + "count(*) FILTER (WHERE yhat = 2) AS v2, [avg(p[1]), avg(p[2]), avg(p[3])] AS p FROM single GROUP BY row_id), "
    + "votes AS (SELECT row_id, y, p, CAST(CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS INTEGER) AS yhat FROM pooled)"
)


def guesses(spark, folder) -> DataFrame:
    events = spark.read.schema(src.EVENT_SCHEMA).parquet(f"{folder}/events.parquet")
    logits = [F.expr(LOGIT.format(m="model_id", k=k)).cast("double") for k in range(NUM_CLASSES)]
    return (
        events.select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))).alias("model_id"))
        .select(
            F.col("event_id").alias("row_id"),
            "model_id",
            ((F.col("event_id") * 5 + F.col("user_id")) % 3).cast("int").alias("y"),
            F.array(*logits).alias("scores"),
        )
    )


def voted(spark, folder) -> DataFrame:
    return evaluation.ensemble(evaluation.with_prediction(guesses(spark, folder)), NUM_CLASSES)


P_OUT = ", ".join(f"{r6(f'p[{k + 1}]')} AS p{k}" for k in range(NUM_CLASSES))


def flat_p(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col("p")[k].alias(f"p{k}") for k in range(NUM_CLASSES)])


@register("argmax", f"WITH {GUESSES} SELECT row_id, CAST(model_id AS INTEGER) AS model_id, y, yhat, {P_OUT} FROM single")
def argmax(spark, folder):
    return flat_p(evaluation.with_prediction(guesses(spark, folder)), "row_id", "model_id", "y", "yhat")


@register("ensemble_vote", f"WITH {GUESSES} SELECT row_id, y, yhat, {P_OUT} FROM votes")
def ensemble_vote(spark, folder):
    return flat_p(voted(spark, folder), "row_id", "y", "yhat")


@register("log_probabilities", f"WITH {GUESSES} SELECT row_id, {', '.join(f'{r6(f'ln(p[{k + 1}])')} AS log_p{k}' for k in range(3))} FROM votes")
def log_probabilities(spark, folder):
    logs = evaluation.log_probabilities(voted(spark, folder))
    return logs.select("row_id", *[F.col("log_p")[k].alias(f"log_p{k}") for k in range(NUM_CLASSES)])


@register("accuracy", f"WITH {GUESSES} SELECT {r6('avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM votes")
def accuracy(spark, folder):
    return evaluation.accuracy(voted(spark, folder))


@register(
    "confusion",
    f"WITH {GUESSES} SELECT y, "
    + ", ".join(f"count(*) FILTER (WHERE yhat = {k}) AS predicted_{k}" for k in range(3))
    + " FROM (SELECT y, yhat FROM votes UNION ALL SELECT CAST(unnest(range(3)) AS INTEGER), NULL) t GROUP BY y",
)
def confusion(spark, folder):
    return evaluation.confusion_matrix(voted(spark, folder), NUM_CLASSES)


REPORT = (
    "cls AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS c), "
    "tally AS (SELECT c, count(*) FILTER (WHERE y = c AND yhat = c) AS hits, count(*) FILTER (WHERE y = c) AS actual, "
    "count(*) FILTER (WHERE yhat = c) AS predicted FROM votes, cls GROUP BY c), "
    "pr AS (SELECT *, coalesce(hits * 1.0 / nullif(predicted, 0), 0) AS pre, coalesce(hits * 1.0 / nullif(actual, 0), 0) AS rec FROM tally), "
    "f AS (SELECT *, coalesce(2.0 * pre * rec / nullif(pre + rec, 0), 0) AS f1 FROM pr)"
)


def report_row(label: str, p: str, r: str, f1: str, n: str) -> str:
    return f"SELECT {label} AS label, {r6(p)} AS precision, {r6(r)} AS recall, {r6(f1)} AS f1, CAST({n} AS BIGINT) AS support FROM f"


_hit = "sum(hits) * 1.0 / sum(actual)"
REPORT_SQL = " UNION ALL ".join(
    [
        report_row("CAST(c AS VARCHAR)", "pre", "rec", "f1", "actual"),
        report_row("'accuracy'", _hit, _hit, _hit, "sum(actual)"),
        report_row("'macro avg'", "avg(pre)", "avg(rec)", "avg(f1)", "sum(actual)"),
        report_row("'weighted avg'", *[f"sum({x} * actual) / sum(actual)" for x in ("pre", "rec", "f1")], "sum(actual)"),
    ]
)


@register("class_report", f"WITH {GUESSES}, {REPORT} {REPORT_SQL}")
def class_report(spark, folder):
    return evaluation.class_report(voted(spark, folder))


def histogram_sql(value: str, table: str, bins: int) -> str:
    return f"""v AS (SELECT y, {value} AS v FROM {table}), lim AS (SELECT y, min(v) AS lo, max(v) AS hi FROM v GROUP BY y),
    placed AS (SELECT y, CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / {bins}.0::DOUBLE, 0)), 0), {bins - 1}) + 1 AS INTEGER) AS bin FROM v JOIN lim USING (y)),
    every AS (SELECT y, lo, hi, CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin FROM lim)
    SELECT y, bin, {r6(f'lo + (hi - lo) / {bins}.0::DOUBLE * (bin - 1)')} AS bin_start, count(placed.bin) AS n
    FROM every LEFT JOIN placed USING (y, bin) GROUP BY y, bin, lo, hi"""


@register("prob_hist", f"WITH {GUESSES}, {histogram_sql('p[y + 1]', 'single', 30)}")
def prob_hist(spark, folder):
    return evaluation.prob_histogram(evaluation.with_prediction(guesses(spark, folder)), 30)


def uniform_sql(seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || row_id), 1, 8))::BIGINT / 4294967296.0)"


@register(
    "random_baseline",
    f"WITH {GUESSES} SELECT row_id, yhat AS y, CAST(floor({uniform_sql(0)} * 3) AS INTEGER) AS yhat, "
    + ", ".join(f"{r6(uniform_sql(1 + k))} AS p{k}" for k in range(3))
    + " FROM votes",
)
def random_baseline(spark, folder):
    """A random guess, set against the model's predictions."""
    against = voted(spark, folder).select("row_id", F.col("yhat").alias("y"))
    return flat_p(evaluation.random_baseline(against, NUM_CLASSES), "row_id", "y", "yhat")


@register(
    "reg_errors",
    with_bars(
        " UNION ALL ".join(
            f"""SELECT '{t}' AS target, {r6(f'avg(power(({t} - before) * 1000, 2))')} AS mse, {r6(f'avg(abs(({t} - before) * 1000))')} AS mae
            FROM (SELECT {t}, lag({t}) OVER (PARTITION BY symbol, session ORDER BY bar_ix) AS before FROM full_bars) t"""
            for t in TWO
        ),
        WIDE,
    ),
)
def reg_errors(spark, folder):
    """Errors, in thousandths, of predicting each value by the bar before."""
    w = bars.by_session()
    scaled = {t: F.col(t) * 1000 for t in TWO}
    table = complete(spark, folder).withColumns(scaled).withColumns({f"{t}_hat": F.lag(t).over(w) for t in TWO})
    return evaluation.regression_errors(table, TWO)


@register(
    "predicted_actual",
    with_split(
        f"""SELECT a.symbol, a.session, a.bar_ts, {r6('a.std_mid_price')} AS std_mid_price, {r6('p.std_mid_price')} AS std_mid_price_hat
        FROM splits a JOIN splits p ON p.symbol = a.symbol AND p.split = a.split AND p.split_ord = a.split_ord - {LOOK_BACK} WHERE a.split = 'test'"""
    ),
)
def predicted_actual(spark, folder):
    """A forecast that repeats the oldest step of the look-back window, aligned with the actual value."""
    table = written(split_table(spark, folder), "split").where("split = 'test'")
    seqs = dataset.sequences(table, ["std_mid_price"], "std_mid_price", LOOK_BACK, scale=None)
    keys = ["symbol", "split", "split_ord"]
    guess = seqs.select(*keys, F.col("x")[0][0].alias("std_mid_price_hat"))
    return shown(evaluation.aligned(guess, table, keys), ["std_mid_price", "std_mid_price_hat"])


# --- series ----------------------------------------------------------------------------------------

SERIES_VALUE = "mean_mid_price_variation"


def series_table(spark, folder) -> DataFrame:
    slim = complete(spark, folder).select("symbol", "session", "bar_ix", SERIES_VALUE)
    return series.series_of(dataset.with_positions(written(slim, "bars")), SERIES_VALUE)


SERIES_SQL = f", ys AS (SELECT symbol AS series_id, ord, {SERIES_VALUE} AS y, n_rows AS n FROM placed)"


def acf_sql(source: str, lags: int) -> str:
    terms = ", ".join(
        f"sum(d * lag{k}) / sum(d * d)" for k in range(lags + 1)
    )
    lagged = ", ".join(f"lag(d, {k}) OVER (PARTITION BY series_id ORDER BY ord) AS lag{k}" for k in range(lags + 1))
    return f"""(SELECT series_id, [{terms}] AS r FROM (SELECT series_id, d, {lagged} FROM
    (SELECT series_id, ord, y - avg(y) OVER (PARTITION BY series_id) AS d FROM {source}) c) l GROUP BY series_id)"""


def levinson_sql(source: str, order: int) -> str:
    """Recursive CTE ``dl`` over ``(series_id, r)``."""
    return f"""dl AS (SELECT series_id, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST([] AS DOUBLE[]) AS pac FROM {source}
    UNION ALL SELECT series_id, r, k + 1,
      list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k + 1 - j]), a), list_append(pac, a)
    FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0))
      / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) AS a FROM dl WHERE k < {order}) s)"""


def with_series(tail: str) -> str:
    return f"WITH RECURSIVE {sql.chain(**WIDE)}{SPLIT}{SERIES_SQL}{tail}"


@register(
    "acf",
    with_series(
        f" SELECT series_id, CAST(unnest(range(21)) AS INTEGER) AS lag, {r6('unnest(r)')} AS acf FROM {acf_sql('ys', 20)} a"
    ),
)
def acf(spark, folder):
    return series.acf(series_table(spark, folder), 20, chunk_rows=128)


@register(
    "pacf",
    with_series(
        f""", rs AS {acf_sql('ys', 20)}, {levinson_sql('rs', 20)}
        SELECT series_id, CAST(unnest(range(21)) AS INTEGER) AS lag, {r6('unnest(list_prepend(1.0, pac))')} AS pacf FROM dl WHERE k = 20"""
    ),
)
def pacf(spark, folder):
    return series.pacf(series_table(spark, folder), 20)


@register("adf", None)
def adf(spark, folder):
    return series.adf(series_table(spark, folder))


AR = 10
ARIMA_SQL = f""", steps AS (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY ord) AS dy, floor(n * 0.8::DOUBLE) AS n_train FROM ys),
moved AS (SELECT series_id, ord, dy AS y FROM steps WHERE ord > 0 AND ord < n_train),
rs AS {acf_sql('moved', AR)}, {levinson_sql('rs', AR)},
resid AS (SELECT s.*, CASE WHEN ord > {AR} THEN dy - ({' + '.join(f'phi[{k}] * lag(dy, {k}) OVER (PARTITION BY s.series_id ORDER BY ord)' for k in range(1, AR + 1))}) END AS e
  FROM steps s JOIN (SELECT * FROM dl WHERE k = {AR}) d USING (series_id)),
reg AS (SELECT *, lag(y) OVER o AS y1, lag(dy) OVER o AS x, lag(e) OVER o AS e1 FROM resid WINDOW o AS (PARTITION BY series_id ORDER BY ord)),
prods AS (SELECT *, CASE WHEN dy + x + e1 IS NOT NULL THEN x * x ELSE 0 END AS pxx, CASE WHEN dy + x + e1 IS NOT NULL THEN x * e1 ELSE 0 END AS pxe,
  CASE WHEN dy + x + e1 IS NOT NULL THEN e1 * e1 ELSE 0 END AS pee, CASE WHEN dy + x + e1 IS NOT NULL THEN x * dy ELSE 0 END AS pxy,
  CASE WHEN dy + x + e1 IS NOT NULL THEN e1 * dy ELSE 0 END AS pey FROM reg)"""
SOLVE = {"phi": "(sxy * see - sey * sxe) / nullif(sxx * see - sxe * sxe, 0)", "theta": "(sey * sxx - sxy * sxe) / nullif(sxx * see - sxe * sxe, 0)"}
SUMS = {"sxx": "pxx", "sxe": "pxe", "see": "pee", "sxy": "pxy", "sey": "pey"}
WALK_SQL = (
    ARIMA_SQL
    + f""", hist AS (SELECT *, {', '.join(f'sum({p}) OVER o AS {s}' for s, p in SUMS.items())} FROM prods
  WINDOW o AS (PARTITION BY series_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
walks AS (SELECT series_id, ord, y, {', '.join(f'{e} AS {n}' for n, e in SOLVE.items())}, y1, x, e1 FROM hist WHERE ord >= n_train),
fc AS (SELECT *, y1 + phi * x + theta * e1 AS forecast FROM walks)"""
)


@register(
    "arima_fit",
    with_series(
        ARIMA_SQL
        + f""" SELECT series_id, CAST(n_train AS BIGINT) AS n_train, {', '.join(f'{r6(e)} AS {n}' for n, e in SOLVE.items())} FROM (
        SELECT series_id, max(n_train) AS n_train, {', '.join(f'sum({p}) AS {s}' for s, p in SUMS.items())} FROM prods WHERE ord < n_train GROUP BY series_id) t"""
    ),
)
def arima_fit(spark, folder):
    return series.arima_fit(series_table(spark, folder), ar_order=AR)


@register(
    "arima_walk_forward",
    with_series(
        WALK_SQL
        + f" SELECT series_id, CAST(ord AS BIGINT) AS ord, {', '.join(f'{r6(c)} AS {c}' for c in ('y', 'phi', 'theta', 'forecast'))} FROM fc"
    ),
)
def arima_walk_forward(spark, folder):
    return series.arima_walk_forward(series_table(spark, folder), ar_order=AR, chunk_rows=128)


@register(
    "arima_accuracy",
    with_series(WALK_SQL + f" SELECT {r6('avg(CASE WHEN (y > 0) = (forecast > 0) THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM fc"),
)
def arima_accuracy(spark, folder):
    walk = series.arima_walk_forward(series_table(spark, folder), ar_order=AR)
    return evaluation.accuracy(series.sign_labels(walk))


# --- ranking and models (no SQL counterpart) ---------------------------------------------------------


def ranking(spark, folder) -> DataFrame:
    return rank.ranking_table(ticks(spark, folder, DEEP), rate(DEEP))


@register("rf_importance", None)
def rf_importance(spark, folder):
    return rank.rank_by_forests(ranking(spark, folder))


@register("shap_importance", None)
def shap_importance(spark, folder):
    return rank.rank_by_shap(ranking(spark, folder))


RANKED = list(dict.fromkeys(c for s in rank.BOTH for c in dataset.FEATURE_SETS[s]))


def ranking_sql(tail: str) -> str:
    """CTE ``ranked``: all ranked features of every bar, and ``cls``, the class of the symbol's next bar."""
    ready = " AND ".join(f"{q(c)} IS NOT NULL" for c in ft.LAST_READY)
    held = " AND ".join(f"{q(c)} IS NOT NULL" for c in RANKED)
    base = with_indicators("", DEEP).rstrip()
    return f"""{base}, ranked AS (SELECT {', '.join(q(c) for c in RANKED)}, cls
      FROM (SELECT *, lead({TARGET}) OVER (PARTITION BY symbol ORDER BY bar_ts) AS cls FROM technical WHERE {ready}) AS t WHERE cls IS NOT NULL AND {held}) {tail}"""


def r9(column: str, engine_one: str) -> str:
    """Nine decimals, so that values which the engines round apart still share a bin edge."""
    return f"floor({column} * 1e9{engine_one} + 0.487{engine_one}) / 1e9{engine_one}"


def mutual_info_sets_sql() -> str:
    ranks = ", ".join(f"greatest(CAST(ceil(n * {k} / 10) AS BIGINT), 1)" for k in range(1, 10))
    whole = "(PARTITION BY feature)"
    return ranking_sql(f""", tall AS (SELECT cls, feature, value FROM (SELECT cls, {', '.join(f"{r9(f'CAST({q(c)} AS DOUBLE)', '::DOUBLE')} AS {q(c)}" for c in RANKED)} FROM ranked)
        UNPIVOT (value FOR feature IN ({', '.join(q(c) for c in RANKED)}))),
      placed AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) AS rk, count(*) OVER {whole} AS n FROM tall),
      edges AS (SELECT feature, list(DISTINCT value) AS edges FROM placed WHERE rk IN ({ranks}) GROUP BY feature),
      binned AS (SELECT feature, len(list_filter(edges, lambda e: e < value)) AS bin, cls FROM tall JOIN edges USING (feature)),
      joint AS (SELECT feature, bin, cls, count(*) AS n FROM binned GROUP BY ALL),
      shares AS (SELECT feature, n, sum(n) OVER {whole} AS total, sum(n) OVER (PARTITION BY feature, bin) AS in_bin, sum(n) OVER (PARTITION BY feature, cls) AS in_class FROM joint),
      scored AS (SELECT feature, sum(n * 1.0 / total * ln(n * 1.0 * total / (in_bin * in_class))) AS value FROM shares GROUP BY feature),
      sets(feature_set, feature) AS (VALUES {', '.join(f"('{s}', '{c}')" for s in rank.BOTH for c in dataset.FEATURE_SETS[s])})
      SELECT feature_set, feature, {r6('value')} AS mutual_information FROM sets JOIN scored USING (feature)""")


@register(
    "correlation_sets",
    ranking_sql(f""", tall AS (SELECT row, feature, value FROM (SELECT row_number() OVER () AS row, {', '.join(f'CAST({q(c)} AS DOUBLE) AS {q(c)}' for c in RANKED)} FROM ranked)
        UNPIVOT (value FOR feature IN ({', '.join(q(c) for c in RANKED)})))
      SELECT a.feature AS feature_a, b.feature AS feature_b, {r6('corr(a.value, b.value)')} AS r FROM tall AS a JOIN tall AS b USING (row) GROUP BY ALL"""),
)
def correlation_sets(spark, folder):
    """Every pair of the features of both ranked sets."""
    return analysis.correlation(ranking(spark, folder), RANKED)


@register("mutual_info_sets", mutual_info_sets_sql())
def mutual_info_sets(spark, folder):
    even = [f"{r9(f'CAST(`{c}` AS DOUBLE)', 'D')} AS `{c}`" for c in RANKED]
    return rank.rank_by_information(ranking(spark, folder).selectExpr(*even, rank.TARGET))


@register("pca_selection", None)
def pca_selection(spark, folder):
    return rank.rank_by_components(ranking(spark, folder))


@register(
    "pca_correlation",
    with_bars(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({a}, {b})')} AS r FROM full_bars" for a in CORR for b in CORR
        ),
        WIDE,
    ),
)
def pca_correlation(spark, folder):
    """All components together give the correlations back: the sum of variance * loading * loading."""
    picked = importance.pca_selection(model_table(spark, folder), CORR, n_components=len(CORR), num_features_to_keep=len(CORR))
    shares = spark.createDataFrame([(f"PC{k + 1}", v * len(CORR)) for k, v in enumerate(picked.variance)], "component STRING, variance DOUBLE")
    sides = [picked.loadings.select("component", F.col("feature").alias(f"feature_{x}"), F.col("loading").alias(x)) for x in "ab"]
    pairs = sides[0].join(sides[1], "component").join(shares, "component")
    return pairs.groupBy("feature_a", "feature_b").agg(F.sum(F.col("variance") * F.col("a") * F.col("b")).alias("r"))


@register("shap_additivity", with_bars(f"SELECT {', '.join(KEYS)}, {r6('0.0::DOUBLE')} AS rest FROM full_bars", WIDE))
def shap_additivity(spark, folder):
    """Values, base and margin of every bar: nothing is left over."""
    table = bars.with_bar_time(model_table(spark, folder), rate(WIDE))
    model = importance.fit_boosted(table, CORR[:6], TARGET, maxIter=10)
    values = importance.shap_values(table, CORR[:6], model, KEYS)
    left = F.col("margin") - F.col("base") - F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    return values.select(*KEYS, F.round(left, 6).alias("rest"))


SEQUENCES_SQL = f"""SELECT symbol, split, CAST(split_ord AS BIGINT) AS split_ord, CAST({TARGET} AS INTEGER) AS y, 1.0::DOUBLE AS total
FROM splits WHERE split <> 'train' AND split_ord >= {LOOK_BACK}"""


@register("seq_classifier_outputs", with_split(SEQUENCES_SQL))
def seq_classifier_outputs(spark, folder):
    """Every validation and test sequence gets class probabilities."""
    seqs = written(dataset.sequences(split_table(spark, folder), SEQ_FEATURES[:4], TARGET, LOOK_BACK), "sequences")
    model = models.fit_sequence_classifier(seqs.where("split = 'train'"), LOOK_BACK, 4, hidden=(16,), epochs=20)
    guessed = models.predict_classes(model, seqs.where("split <> 'train'"))
    return guessed.select("symbol", "split", "split_ord", "y", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("seq_classifier", None)
def seq_classifier(spark, folder):
    """Reports of the validation and the test split, and of a random guess on the test split."""
    seqs = written(dataset.sequences(split_table(spark, folder), SEQ_FEATURES, TARGET, LOOK_BACK), "sequences")
    model = models.fit_sequence_classifier(seqs.where("split = 'train'"), LOOK_BACK, len(SEQ_FEATURES), epochs=100)
    reports = []
    for split in ("val", "test"):
        guessed = models.predict_classes(model, seqs.where(f"split = '{split}'"))
        reports.append(evaluation.class_report(guessed).select(F.lit(split).alias("split"), "*"))
    keyed = guessed.select(F.concat_ws(":", "symbol", "split_ord").alias("row_id"), "y")
    chance = evaluation.class_report(evaluation.random_baseline(keyed, 2))
    return reports[0].unionByName(reports[1]).unionByName(chance.select(F.lit("random").alias("split"), "*"))


@register("seq_regressor", None)
def seq_regressor(spark, folder):
    seqs = written(dataset.sequences(split_table(spark, folder), SEQ_FEATURES, TWO, LOOK_BACK), "sequences")
    fitted = models.fit_sequence_regressors(seqs.where("split = 'train'"), TWO)
    found = [
        evaluation.regression_errors(models.predict_values(fitted, seqs.where(f"split = '{split}'")), TWO).select(F.lit(split).alias("split"), "*")
        for split in ("val", "test")
    ]
    return found[0].unionByName(found[1])
