from tidebook.operators import importance
from tidebook.operators.dataset import FEATURE_SETS
from tidebook.plans.ranking import fit_sample, rank_by_shap


def test_sample_is_bounded_and_repeatable(spark):
    table = spark.range(5000).selectExpr("'A' AS symbol", "DATE'2024-10-07' AS session", "id AS bar_ix")
    assert fit_sample(table, 5000).count() == 5000
    some = {r["bar_ix"] for r in fit_sample(table, 500).collect()}
    assert 350 < len(some) < 650 and some == {r["bar_ix"] for r in fit_sample(table.repartition(3), 500).collect()}


def test_shap_values_keep_their_keys_and_skip_gaps(spark):
    rows = [(i, float(i % 7), None if i % 10 == 0 else float(i % 3), int(i % 7 > 3)) for i in range(400)]
    table = spark.createDataFrame(rows, "bar_ix BIGINT, a DOUBLE, b DOUBLE, t INT")
    model = importance.fit_boosted(table, ["a", "b"], "t", maxIter=3)
    found = importance.shap_values(table, ["a", "b"], model, ["bar_ix"]).collect()
    assert {r["bar_ix"] for r in found} == {i for i in range(400) if i % 10}
    assert all(abs(r["margin"] - r["base"] - sum(r["phi"])) < 1e-9 for r in found)


def test_mean_shap_covers_rows_outside_the_sample(spark):
    features = FEATURE_SETS["mid_price"]
    table = spark.range(2000).selectExpr("'A' AS symbol", "DATE'2024-10-07' AS session", "id AS bar_ix", "int(id % 7 > 3) AS t", *[f"double((id * {i + 3}) % 7) AS `{c}`" for i, c in enumerate(features)])
    sample = fit_sample(table, 200)
    assert 0 < sample.count() < 400
    model = importance.fit_boosted(sample, features, "t", maxIter=2, maxDepth=2)
    phi = [r["phi"] for r in importance.shap_values(table, features, model).collect()]
    found = {r["feature"]: r["mean_abs_shap"] for r in rank_by_shap(table, "t", ["mid_price"], 200, len(features), rounds=2, depth=2).collect()}
    assert len(phi) == 2000 and len(found) == len(features)
    for i, c in enumerate(features):
        assert abs(found[c] - sum(abs(p[i]) for p in phi) / 2000) < 1e-9
