import random

import numpy as np
import pytest

from tidebook.operators import importance, models
from tidebook.operators.evaluation import accuracy, regression_errors


@pytest.fixture(scope="module")
def planted(spark):
    """Class follows a and c together; ``noise`` says nothing."""
    rng = random.Random(3)
    rows = [(a, b, c, rng.random(), int(a + 0.5 * c + 0.1 * rng.gauss(0, 1) > 0.75)) for a, b, c in ((rng.random(), rng.random(), rng.random()) for _ in range(1500))]
    return spark.createDataFrame(rows, "a DOUBLE, `b(1)` DOUBLE, c DOUBLE, noise DOUBLE, t INT").cache()


FEATURES = ["a", "b(1)", "c", "noise"]


def test_forest_importance(planted):
    got = importance.forest_importance(planted, FEATURES, "t", numTrees=10, maxDepth=5).collect()
    assert [r["feature"] for r in got[:2]] == ["a", "c"] and sum(r["importance"] for r in got) == pytest.approx(1)
    assert len(importance.forest_importance(planted, FEATURES, "t", 2, numTrees=3, maxDepth=3).collect()) == 2
    assert importance.FOREST_SETS["params3"]["featureSubsetStrategy"] == "0.3"


def test_shap_values_add_up_to_the_margin(planted):
    model = importance.fit_boosted(planted, FEATURES, "t", maxIter=5, maxDepth=4)
    rows = importance.shap_values(planted, FEATURES, model).collect()
    assert len(rows) == planted.count()
    assert [sum(r["phi"]) + r["base"] for r in rows] == pytest.approx([r["margin"] for r in rows], abs=1e-9)
    ranked = importance.shap_importance(planted, FEATURES, "t", maxIter=5, maxDepth=4).collect()
    assert [r["feature"] for r in ranked[:2]] == ["a", "c"]


def test_shap_matches_all_coalitions():
    """Leaf games against the textbook average over feature orders."""
    from itertools import permutations

    leaves = [importance.Leaf(2.0, (0, 2), (-np.inf, 0.3), (0.5, np.inf), (0.6, 0.25)), importance.Leaf(-1.0, (1,), (0.2,), (0.9,), (0.4,))]
    x = np.array([[0.4, 0.5, 0.9], [0.7, 0.1, 0.1]])

    def value(row, known):
        total = 0.0
        for leaf in leaves:
            v = leaf.value
            for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                v *= float(lo < row[f] <= hi) if f in known else share
            total += v
        return total

    for row, got in zip(x, importance.shap_matrix(x, leaves)):
        want = np.zeros(3)
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += (value(row, set(order[: i + 1])) - value(row, set(order[:i]))) / 6
        assert got == pytest.approx(want)


def test_pca_selection(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(800, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.01 * rng.normal(size=800), base[:, 1], np.full(800, 3.0)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "p DOUBLE, q DOUBLE, r DOUBLE, flat DOUBLE")
    got = importance.pca_selection(df, ["p", "q", "r", "flat"], num_features_to_keep=3)
    assert got.n_components == 2 and sum(got.variance) == pytest.approx(1)
    assert set(got.features) == {"p", "q", "r"} and got.loadings.count() == 6
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    vectors = np.linalg.svd(z, full_matrices=False)[2][:2]
    want = dict(zip("pqr", np.abs(vectors).sum(0)))
    assert {r["feature"]: r["importance"] for r in got.importance.collect()} == pytest.approx(want, abs=1e-6)
    assert importance.pca_selection(df, ["p", "q", "r"], n_components=1).n_components == 1


def planted_sequences(spark, n=1200):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = [[rng.random(), rng.random()] for _ in range(3)]
        rows.append((i, x, int(x[-1][0] > 0.5), 2 * x[0][1] - x[2][0], x[1][1]))
    return spark.createDataFrame(rows, "ord BIGINT, x ARRAY<ARRAY<DOUBLE>>, y INT, u DOUBLE, v DOUBLE").cache()


def test_sequence_classifier_beats_chance(spark):
    seqs = planted_sequences(spark)
    model = models.fit_sequence_classifier(seqs.where("ord < 900"), 3, 2, hidden=(8,), epochs=60)
    assert accuracy(models.predict_classes(model, seqs.where("ord >= 900"))).first()[0] > 0.85


def test_sequence_regressors_beat_the_mean(spark):
    seqs = planted_sequences(spark)
    fitted = models.fit_sequence_regressors(seqs.where("ord < 900"), ["u", "v"])
    errors = {r["target"]: r["mse"] for r in regression_errors(models.predict_values(fitted, seqs.where("ord >= 900")), ["u", "v"]).collect()}
    assert errors["u"] < 0.01 and errors["v"] < 0.01
