import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import analysis, evaluation


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), float(rng.choice([1, 1, 1, 2, 7])), None if i % 3 else rng.random(), 5.0, i % 2) for i in range(3000)]
    return spark.createDataFrame(rows, "a DOUBLE, `b(2)` DOUBLE, gaps DOUBLE, flat DOUBLE, t INT").cache()


COLUMNS = ["a", "b(2)", "gaps", "flat"]


def arrays(frame):
    rows = frame.collect()
    return [np.array([r[c] for r in rows if r[c] is not None]) for c in COLUMNS]


@pytest.mark.parametrize("few", [0, 100, 1 << 16])
def test_order_statistics_are_exact(frame, few):
    data = [np.sort(x) for x in arrays(frame)]
    ranks = [[0, 1, len(x) // 3, len(x) // 2, len(x) - 1] for x in data]
    counts = analysis.sizes(frame, COLUMNS)
    got = analysis.order_statistics(frame, COLUMNS, ranks, counts, few)
    for x, rs, found in zip(data, ranks, got):
        assert found == {r: x[r] for r in rs}
    assert analysis.order_statistics(frame, COLUMNS, [[], [], [], []], counts) == [{}, {}, {}, {}]


def test_bits_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, np.inf, np.nan])
    bits = analysis.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert [analysis.double_of(int(b)) for b in bits[:-1]] == [v + 0.0 for v in x[:-1]]


def test_order_statistics_of_hard_columns(spark, monkeypatch):
    """One value in half of the rows, a million distinct neighbours, infinities: four passes all the same."""
    passes = []
    counts = analysis._digit_counts
    monkeypatch.setattr(analysis, "_digit_counts", lambda *args: passes.append(args) or counts(*args))
    df = spark.range(0, 1_000_000, 1, 8).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 0.25D ELSE CAST(id AS DOUBLE) / 7 - 60000 END AS half",
        "1e6D + CAST(pmod(id * 7919, 1000000) AS DOUBLE) * 2.3283064365386963E-10D AS near",
        "CASE WHEN id < 3 THEN double('-Infinity') WHEN id > 999990 THEN double('Infinity') ELSE -CAST(id AS DOUBLE) END AS ends",
    )
    ranks = [[0, 250_000, 499_999, 500_000, 999_999], [1, 123_456, 999_998], [0, 3, 500_000, 999_999]]
    data = [np.sort(c) for c in df.toPandas().to_numpy().T]
    assert analysis.order_statistics(df, df.columns, ranks, [1_000_000] * 3) == [{r: x[r] for r in rs} for x, rs in zip(data, ranks)]
    assert len(passes) == 4 and len(np.unique(data[1])) == 1_000_000


def test_correlation_merges_batches_and_tasks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (4000, 3))
    x[:, 1] += x[:, 0]
    x[rng.random((4000, 3)) < 0.2] = np.nan
    x[:2000, 2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (7.1, None) for r in x]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, flat DOUBLE, none DOUBLE").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in analysis.correlation(df, df.columns).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert all(r is None for (a, b), r in got.items() if {a, b} & {"flat", "none"})
    assert all(r["r"] is None for r in analysis.correlation(df.limit(0), ["a", "b"]).collect())


def test_describe(frame):
    got = {r["feature"]: r for r in analysis.describe(frame, COLUMNS).collect()}
    for name, x in zip(COLUMNS, arrays(frame)):
        want = [len(x), x.mean(), x.std(ddof=1), x.min(), *np.percentile(x, [25, 50, 75]), x.max()]
        assert list(got[name])[1:] == pytest.approx(want)


def test_describe_without_values(spark):
    empty = spark.createDataFrame([(None,)], "a DOUBLE")
    assert list(analysis.describe(empty, ["a"]).first()) == ["a", 0, *[None] * 7]


def test_correlation(frame):
    whole = frame.where("gaps IS NOT NULL")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in analysis.correlation(whole, COLUMNS).collect()}
    want = np.corrcoef([[r[c] for r in whole.collect()] for c in COLUMNS[:3]])
    assert got[("a", "gaps")] == pytest.approx(want[0, 2]) and got[("a", "a")] == 1.0
    assert got[("a", "flat")] is None


def test_correlation_takes_pairs_and_small_spreads(frame, spark):
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in analysis.correlation(frame, ["a", "gaps"]).collect()}
    rows = [(r["a"], r["gaps"]) for r in frame.collect() if r["gaps"] is not None]
    assert got[("a", "gaps")] == pytest.approx(np.corrcoef(np.array(rows).T)[0, 1])
    tiny = spark.createDataFrame([(1.0 + k * 1e-8, 5e-9 * k + (k % 3) * 1e-10) for k in range(50)], "x DOUBLE, y DOUBLE")
    want = np.corrcoef(np.array([tuple(r) for r in tiny.collect()]).T)[0, 1]
    assert {(r["feature_a"], r["feature_b"]): r["r"] for r in analysis.correlation(tiny, ["x", "y"]).collect()}[("x", "y")] == pytest.approx(want, rel=1e-6)


def test_mutual_information(spark):
    rng = random.Random(2)
    rows = [(x, rng.random(), int(x > 0.5)) for x in (rng.random() for _ in range(2000))]
    df = spark.createDataFrame(rows, "signal DOUBLE, noise DOUBLE, t INT")
    got = {r["feature"]: r["mutual_information"] for r in analysis.mutual_information(df, ["signal", "noise"], "t", 10).collect()}
    assert got["signal"] > 0.9 * math.log(2) and 0 <= got["noise"] < 0.01


def predictions(spark, pairs):
    return spark.createDataFrame([(i, y, g) for i, (y, g) in enumerate(pairs)], "row_id BIGINT, y INT, yhat INT")


def test_report_with_a_class_never_predicted(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 0)]
    got = {r["label"]: r for r in evaluation.class_report(predictions(spark, pairs)).collect()}
    assert (got["2"]["precision"], got["2"]["recall"], got["2"]["f1"], got["2"]["support"]) == (0, 0, 0, 2)
    assert (got["1"]["precision"], got["1"]["recall"]) == (0.5, 1.0)
    assert got["accuracy"]["precision"] == pytest.approx(0.5) and got["accuracy"]["support"] == 6
    assert got["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0) / 3) == got["weighted avg"]["recall"]
    matrix = {r["y"]: r for r in evaluation.confusion_matrix(predictions(spark, pairs), 3).collect()}
    assert list(matrix[2])[1:] == [1, 1, 0]


def test_ensemble_ties_go_to_the_lowest_class(spark):
    rows = [(1, m, 0, [0.2, 0.3, 0.5], g) for m, g in enumerate([2, 1, 2, 1])] + [(2, m, 1, [0.6, 0.2, 0.2], g) for m, g in enumerate([0, 2, 2, 1])]
    df = spark.createDataFrame(rows, "row_id BIGINT, model_id INT, y INT, p ARRAY<DOUBLE>, yhat INT")
    got = {r["row_id"]: r for r in evaluation.ensemble(df, 3).collect()}
    assert got[1]["yhat"] == 1 and got[2]["yhat"] == 2 and got[1]["p"] == pytest.approx([0.2, 0.3, 0.5])


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],)], "scores ARRAY<DOUBLE>")
    got = evaluation.with_prediction(df).first()
    assert got["yhat"] == 1 and got["p1"] == pytest.approx(1 / (1 + math.exp(-1)))


def test_histogram_closes_the_last_bin(spark):
    rows = [(0, [v, 1 - v]) for v in (0.0, 0.1, 0.5, 1.0)] + [(1, [0.3, 0.7])]
    df = spark.createDataFrame(rows, "y INT, p ARRAY<DOUBLE>")
    got = {(r["y"], r["bin"]): r["n"] for r in evaluation.prob_histogram(df, 10).collect()}
    empty = {(y, b): 0 for y in (0, 1) for b in range(1, 11)}
    assert got == empty | {(0, 1): 1, (0, 2): 1, (0, 6): 1, (0, 10): 1, (1, 1): 1}


def test_random_baseline_is_reproducible_and_uniform(spark):
    df = spark.range(6000).selectExpr("id AS row_id", "CAST(id % 3 AS INT) AS y")
    first = sorted((r["row_id"], r["yhat"], tuple(r["p"])) for r in evaluation.random_baseline(df, 3, 7).collect())
    again = sorted((r["row_id"], r["yhat"], tuple(r["p"])) for r in evaluation.random_baseline(df.repartition(5), 3, 7).collect())
    assert first == again
    counts = np.bincount([r[1] for r in first])
    assert len(counts) == 3 and counts.min() > 1800


def test_histogram_of_many_classes_keeps_empty_bins(spark):
    df = spark.range(2400).selectExpr("CAST(id DIV 2 AS INT) AS y", "CAST(id % 2 AS DOUBLE) AS value")
    got = evaluation.prob_histogram(df, 5, F.col("value")).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in got} == {0: 3 * 1200, 1: 2 * 1200}


def test_matrix_has_a_row_for_a_class_that_is_never_true(spark):
    matrix = {r["y"]: list(r)[1:] for r in evaluation.confusion_matrix(predictions(spark, [(0, 1), (0, 0)]), 2).collect()}
    assert matrix == {0: [1, 1], 1: [0, 0]}
