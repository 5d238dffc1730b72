import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import dataset


def table(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows = []
    for symbol, sessions in sizes.items():
        for d, n in enumerate(sessions):
            for i in sorted(rng.sample(range(1000), n)):
                rows.append((symbol, f"d{d}", i, rng.random(), float(rng.randint(0, 3)), 1.5, rng.randint(0, 1)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol STRING, session STRING, bar_ix BIGINT, a DOUBLE, `b(1)` DOUBLE, flat DOUBLE, t INT")


def history(df, symbol):
    return [r for r in df.orderBy("session", "bar_ix").collect() if r["symbol"] == symbol]


def test_positions_and_split(spark):
    df = table(spark, {"X": [13, 20, 4], "Y": [7]})
    got = dataset.chronological_split(dataset.with_positions(df))
    for symbol, n in (("X", 37), ("Y", 7)):
        rows = history(got, symbol)
        assert [r["ord"] for r in rows] == list(range(n)) and {r["n_rows"] for r in rows} == {n}
        train, val = int(n * 0.7), int(n * 0.1)
        names = ["train"] * train + ["val"] * val + ["test"] * (n - train - val)
        assert [r["split"] for r in rows] == names
        assert [r["split_ord"] for r in rows] == [*range(train), *range(val), *range(n - train - val)]


@pytest.mark.parametrize("chunk_rows, scale", [(4, None), (7, "window"), (65_536, "window")])
def test_sequences(spark, chunk_rows, scale):
    features, k = ["a", "b(1)", "flat"], 4
    df = dataset.chronological_split(dataset.with_positions(table(spark, {"X": [13, 20, 4], "Y": [7]})))
    seqs = dataset.sequences(df, features, "t", k, scale=scale, chunk_rows=chunk_rows)
    got = {(r["symbol"], r["split"], r["split_ord"]): (np.array(r["x"]), r["y"]) for r in seqs.collect()}
    want = {}
    for symbol in "XY":
        for split in ("train", "val", "test"):
            rows = [r for r in history(df, symbol) if r["split"] == split]
            for i in range(len(rows) - k):
                x = np.array([[r[f] for f in features] for r in rows[i : i + k]])
                if scale:
                    width = x.max(0) - x.min(0)
                    x = (x - x.min(0)) / np.where(width == 0, 1, width)
                want[(symbol, split, i + k)] = (x, rows[i + k]["t"])
    assert got.keys() == want.keys() and len(got) > 20
    for key in want:
        assert np.allclose(got[key][0], want[key][0]) and got[key][1] == want[key][1]


def test_split_shorter_than_the_look_back(spark):
    df = dataset.chronological_split(dataset.with_positions(table(spark, {"X": [6]})))
    assert dataset.sequences(df, ["a"], "t", 16).count() == 0


def test_two_targets_keep_their_names(spark):
    df = dataset.chronological_split(dataset.with_positions(table(spark, {"X": [20]})))
    assert dataset.sequences(df, ["a"], ["b(1)", "flat"], 3).columns == ["symbol", "split", "split_ord", "x", "b(1)", "flat"]


def test_scalers(spark):
    df = table(spark, {"X": [50]})
    x = np.array([[r["a"], r["b(1)"], r["flat"]] for r in df.collect()])
    for kind, center, width in (("standard", x.mean(0), x.std(0)), ("minmax", x.min(0), np.ptp(x, axis=0))):
        fitted = dataset.fit_scaler(df, ["a", "b(1)", "flat"], kind)
        width = np.where(width == 0, 1, width)
        assert np.allclose(list(fitted.values()), np.stack([center, width], 1))
        scaled = dataset.scale(df, fitted)
        assert np.allclose([[r["a"], r["b(1)"], r["flat"]] for r in scaled.collect()], (x - center) / width)
        back = dataset.unscale(scaled.withColumn("guess", F.col("a")), fitted, {"guess": "a"})
        assert np.allclose([r["guess"] for r in back.collect()], x[:, 0])


def test_feature_sets_name_real_columns():
    from tidebook.operators.book import BAR_COLUMNS
    from tidebook.plans.feature_table import CALENDAR, INDICATORS

    known = {*BAR_COLUMNS, *INDICATORS, *CALENDAR, "market_session"}
    assert all(set(columns) <= known for columns in dataset.FEATURE_SETS.values())
    assert len(dataset.FEATURE_SETS["technical"]) == 39 and len(dataset.FEATURE_SETS["classifier"]) == 15
