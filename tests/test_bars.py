import pytest
from frames import SCHEMA, random_ticks, session_bars, tick

from tidebook.functions.nulls import all_present
from tidebook.operators.bars import bars, dense_grid, tick_prices
from tidebook.operators.book import BAR_COLUMNS, book_features
from tidebook.operators.labels import labels, next_bar_target
from tidebook.plans.feature_table import bar_features


def rows_by_key(df):
    return {(r["symbol"], r["session"], r["bar_ix"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_complete_bars_match_bin_by_bin_evaluation(spark, seed):
    rows = random_ticks(seed)
    want = {}
    for symbol, session in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if (r[0], r[1]) == (symbol, session)]
        want |= {(symbol, session, ix): row for ix, row in session_bars(mine, 60).items()}
    assert want
    for order in (("seq",), ("ts_us", "seq")):
        got = rows_by_key(bar_features(spark.createDataFrame(rows, SCHEMA), "1min", order=order))
        assert got.keys() == want.keys()
        for key, row in want.items():
            for column in BAR_COLUMNS:
                assert got[key][column] == pytest.approx(row[column], abs=1e-9), (key, column)


def test_decisive_columns_imply_all_others(spark):
    table = book_features(labels(bars(spark.createDataFrame(random_ticks(7, n=120), SCHEMA), "1min")))
    every = rows_by_key(table.where(all_present(BAR_COLUMNS)))
    assert every.keys() == rows_by_key(bar_features(spark.createDataFrame(random_ticks(7, n=120), SCHEMA), "1min")).keys()


def test_price_fallbacks(spark):
    rows = [
        tick(0, 1, bid=None, ask=101.0),
        tick(1, 2, bid=99.0, ask=None),
        tick(2, 3, bid=None, ask=None),
        tick(3, 4, bid=99.0, ask=101.0, bid_sz=0, ask_sz=0),
        tick(4, 5, bid=99.0, ask=101.0, bid_sz=1, ask_sz=3),
    ]
    got = tick_prices(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [r["mid_price"] for r in got] == [101.0, 99.0, None, 100.0, 100.0]
    assert [r["weighted_mid_price"] for r in got] == [101.0, 99.0, None, 101.0, 99.5]
    assert [r["bid_ask_spread"] for r in got] == [None, None, None, 2.0, 2.0]


def test_masked_spans(spark):
    """Counts are 0 inside a subset's span, missing outside; a net volume needs both spans."""
    rows = [
        tick(0, 0, "T"),
        tick(1, 60, "A", "B", size=7),
        tick(2, 120, "C", "B", size=2),
        tick(3, 180, "T"),
        tick(4, 240, "A", "B", size=1),
        tick(5, 300, "T"),
    ]
    got = sorted(bars(spark.createDataFrame(rows, SCHEMA), "1min").collect(), key=lambda r: r["bar_ix"])
    assert [r["num_added_orders"] for r in got] == [None, 1, 0, 0, 1, None]
    assert [r["num_canceled_orders"] for r in got] == [None, None, 1, None, None, None]
    assert [r["num_traded_orders"] for r in got] == [1, 0, 0, 1, 0, 1]
    assert [r["total_bid_volume"] for r in got] == [None, None, -2, None, None, None]
    assert {r["total_ask_volume"] for r in got} == {None}


def test_dense_grid_fills_gaps(spark):
    rows = [tick(0, 0, bid_sz=3), tick(1, 180, bid_sz=9, bid=None), tick(2, 240, bid_sz=4)]
    got = sorted(dense_grid(spark.createDataFrame(rows, SCHEMA), "1min").collect(), key=lambda r: r["bar_ix"])
    assert [r["bar_ix"] for r in got] == [0, 1, 2, 3, 4]
    assert [r["last_best_bid_size"] for r in got] == [3, 3, 3, 9, 4]
    assert [r["last_best_bid_price"] for r in got] == [100.0, 100.0, 100.0, 100.0, 100.0]
    assert [r["mid_price_last"] for r in got] == [100.5, None, None, 101.0, 100.5]
    assert [r["mean_best_bid_price"] for r in got] == [100.0, None, None, None, 100.0]
    assert [r["num_added_orders"] for r in got] == [1, 0, 0, 1, 1]


def test_equal_times_keep_order(spark):
    rows = [tick(5, 1, bid=98.0, ask=98.0), tick(4, 1, bid=97.0, ask=97.0), tick(9, 1, bid=99.0, ask=99.0)]
    got = bars(spark.createDataFrame(rows, SCHEMA), "1s").first()
    assert (got["mid_price_first"], got["mid_price_last"], got["bar_ix"]) == (97.0, 99.0, 1)


def test_rate_that_does_not_divide_a_day(spark):
    rows = [tick(0, 6.9), tick(1, 7.0), tick(2, 86_399.5)]
    got = sorted(r["bar_ix"] for r in bars(spark.createDataFrame(rows, SCHEMA), "7s").collect())
    assert got == [0, 1, 12342]


def test_next_bar_target_crosses_sessions(spark):
    df = spark.createDataFrame(
        [("X", "d1", 1, 0), ("X", "d1", 4, 1), ("X", "d2", 0, 2), ("Y", "d1", 3, 3)],
        "symbol STRING, session STRING, bar_ix BIGINT, t INT",
    )
    got = sorted((r["symbol"], r["session"], r["bar_ix"], r["t"]) for r in next_bar_target(df, "t").collect())
    assert got == [("X", "d1", 1, 1), ("X", "d1", 4, 2)]


def test_threshold_and_zero(spark):
    rows = [tick(0, 0, bid=100.0, ask=100.0), tick(1, 1, bid=100.5, ask=100.5), tick(2, 60, bid=100.0, ask=100.0)]
    base = bars(spark.createDataFrame(rows, SCHEMA), "1min")

    def classes(**options):
        got = sorted(labels(base, **options).collect(), key=lambda r: r["bar_ix"])
        return [(r["mid_price_variation_class"], r["mean_mid_price_variation_class"]) for r in got]

    assert classes() == [(2, 1), (1, 1)]
    assert classes(threshold=0.01, zero_is_up=False) == [(1, 1), (1, 0)]
