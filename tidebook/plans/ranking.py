"""Feature ranking for the next bar: one feature table, then forests, SHAP, mutual information and components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.nulls import all_present
from tidebook.operators import analysis, importance
from tidebook.operators.dataset import FEATURE_SETS
from tidebook.operators.labels import next_bar_target
from tidebook.plans.feature_table import features_of
from tidebook.session import written

TARGET = "mean_mid_price_variation_class"
BOTH = ("technical", "order_book")

# Which feature sets are ranked with which forest parameters.
FOREST_RUNS: list[tuple[str, str]] = [
    ("technical", "params0"),
    ("technical", "params1"),
    ("order_book", "params0"),
    ("order_book", "params1"),
    ("trend", "params0"),
    ("oscillators", "params1"),
    ("moving_averages", "params2"),
    ("volatility", "params3"),
    ("other", "params0"),
    ("mid_price", "params1"),
    ("bid_ask_prices", "params2"),
    ("volume", "params3"),
    ("orders", "params0"),
]


def ranking_table(ticks: DataFrame, rate: str, target: str = TARGET) -> DataFrame:
    """Features of every bar with the class of the symbol's next bar; bars without one, or with a missing
    feature, are left out. Written once: every ranking reads it."""
    columns = list(dict.fromkeys(c for s in BOTH for c in FEATURE_SETS[s]))
    table = features_of(ticks, rate)
    named = table.select("symbol", "session", "bar_ix", *[F.col(f"`{c}`") for c in columns], F.col(target))
    return written(next_bar_target(named, target).where(all_present(columns)), "ranking")


def fit_sample(table: DataFrame, most_rows: int) -> DataFrame:
    """At most about ``most_rows`` rows, drawn by a hash of the keys: trees grow with the rows they are fitted to,
    and Spark keeps them on the driver."""
    rows = table.count()
    if rows <= most_rows:
        return table
    spot = F.pmod(F.xxhash64("symbol", "session", "bar_ix"), F.lit(1 << 30))
    return table.where(spot < int(most_rows / rows * (1 << 30)))


def _named(ranking: DataFrame, **labels: str) -> DataFrame:
    return ranking.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


def rank_by_forests(
    table: DataFrame, target: str = TARGET, runs: Sequence[tuple[str, str]] = FOREST_RUNS, most_rows: int = 200_000, num_features: int = 25
) -> DataFrame:
    """(feature_set, params, feature, importance) of every run."""
    rows = fit_sample(table, most_rows)
    found = [
        _named(importance.forest_importance(rows, FEATURE_SETS[s], target, num_features, **importance.FOREST_SETS[p]), feature_set=s, params=p)
        for s, p in runs
    ]
    return reduce(DataFrame.unionByName, found)


def rank_by_shap(
    table: DataFrame, target: str = TARGET, sets: Sequence[str] = BOTH, most_rows: int = 200_000, num_features: int = 25, rounds: int = 100, depth: int = 6
) -> DataFrame:
    """(feature_set, feature, mean_abs_shap) over all rows; the model is fitted on a sample and has at most
    rounds * 2^depth leaves."""
    rows = fit_sample(table, most_rows)
    found = [
        _named(importance.shap_importance(table, FEATURE_SETS[s], target, num_features, fit_rows=rows, maxIter=rounds, maxDepth=depth), feature_set=s)
        for s in sets
    ]
    return reduce(DataFrame.unionByName, found)


def rank_by_information(table: DataFrame, target: str = TARGET, sets: Sequence[str] = BOTH, bins: int = 10) -> DataFrame:
    """(feature_set, feature, mutual_information)."""
    return reduce(DataFrame.unionByName, [_named(analysis.mutual_information(table, FEATURE_SETS[s], target, bins), feature_set=s) for s in sets])


def rank_by_components(table: DataFrame, sets: Sequence[str] = BOTH) -> DataFrame:
    """(feature_set, n_components, feature, importance, component, loading, variance): selection, loadings and shares."""
    found = []
    for s in sets:
        picked = importance.pca_selection(table, FEATURE_SETS[s])
        shares = table.sparkSession.createDataFrame([(f"PC{k + 1}", v) for k, v in enumerate(picked.variance)], "component STRING, variance DOUBLE")
        whole = picked.importance.join(picked.loadings, "feature").join(shares, "component")
        found.append(_named(whole.select(F.lit(picked.n_components).alias("n_components"), "feature", "importance", "component", "loading", "variance"), feature_set=s))
    return reduce(DataFrame.unionByName, found)
