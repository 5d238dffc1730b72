"""Feature ranking: forest importance, SHAP values of boosted trees, principal components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.analysis import top
from tidebook.session import scratch_dir

# Forest parameter sets. An unlimited depth becomes Spark's largest, 30.
FOREST_SETS: dict[str, dict[str, object]] = {
    "params0": {"numTrees": 50, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"},
    "params1": {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"},
    "params2": {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"},
    "params3": {"numTrees": 50, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "0.3"},
}


def assembled(df: DataFrame, features: Sequence[str], target: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, the ``x`` vector of the features, and ``label``. Names with brackets or dots are safe.

    Rows with a missing feature or target are left out: no model here takes them.
    """
    slim = df.select(
        *keys,
        *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)],
        *([F.col(f"`{target}`").cast("double").alias("label")] if target else []),
    )
    whole = slim.dropna(subset=[c for c in slim.columns if c not in keys])
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="x").transform(whole)
    return vectors.select(*keys, "x", *(["label"] if target else []))


def forest_importance(
    df: DataFrame, features: Sequence[str], target: str, num_features: int | None = None, seed: int = 0, **params
) -> DataFrame:
    """Impurity importances of a random-forest regressor on a class label, ranked."""
    forest = RandomForestRegressor(featuresCol="x", labelCol="label", seed=seed, **params)
    weights = forest.fit(assembled(df, features, target)).featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(features, weights)]
    return top(df.sparkSession.createDataFrame(rows, "feature STRING, importance DOUBLE"), "importance", num_features)


@dataclass(frozen=True)
class Leaf:
    """A root-to-leaf path: per feature an interval and the share of training rows that stay on the path."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def _leaves(nodes: Mapping[int, Mapping], weight: float) -> list[Leaf]:
    out: list[Leaf] = []
    stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while stack:
        ident, path = stack.pop()
        node = nodes[ident]
        if node["left"] < 0:
            names = tuple(path)
            lows, highs, shares = zip(*(path[f] for f in names)) if names else ((), (), ())
            out.append(Leaf(weight * node["prediction"], names, lows, highs, shares))
            continue
        f, cut = node["feature"], node["threshold"]
        lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, interval in ((node["left"], (lo, min(hi, cut))), (node["right"], (max(lo, cut), hi))):
            kept = share * nodes[child]["rows"] / node["rows"]
            stack.append((child, {**path, f: (*interval, kept)}))
    return out


def tree_paths(spark: SparkSession, model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of a boosted model, read from its saved node table. Size: trees x 2^depth."""
    path = f"{scratch_dir(spark).rstrip('/')}/gbt-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    trees: dict[int, dict[int, dict]] = {}
    for r in table.collect():
        split = r["split"]
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "prediction": r["prediction"],
            "rows": float(r["rawCount"]),
            "left": r["leftChild"],
            "right": r["rightChild"],
            "feature": split["featureIndex"],
            "threshold": split["leftCategoriesOrThreshold"][0] if split["leftCategoriesOrThreshold"] else np.nan,
        }
    return [leaf for t, nodes in trees.items() for leaf in _leaves(nodes, model.treeWeights[t])]


def expected_margin(leaves: Sequence[Leaf]) -> float:
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


def shap_matrix(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Path-dependent TreeSHAP values of all rows, one column per feature.

    A leaf is a game in which a feature either lets the row pass or contributes its training share. Its
    Shapley values follow from the sizes of coalitions, held as polynomial coefficients over the path.
    """
    phi = np.zeros_like(x, dtype=float)
    for leaf in leaves:
        m = len(leaf.features)
        if not m:
            continue
        values = x[:, list(leaf.features)]
        passes = ((values > np.array(leaf.low)) & (values <= np.array(leaf.high))).astype(float)
        shares = np.array(leaf.share)
        # weight of a coalition of size s among the m - 1 other features
        weights = np.array([1.0 / (m * comb(m - 1, s)) for s in range(m)])
        for j, f in enumerate(leaf.features):
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for i in range(m):
                if i != j:
                    poly[:, 1:] = poly[:, 1:] * shares[i] + poly[:, :-1] * passes[:, [i]]
                    poly[:, 0] *= shares[i]
            phi[:, f] += leaf.value * (passes[:, j] - shares[j]) * (poly @ weights)
    return phi


def fit_boosted(df: DataFrame, features: Sequence[str], target: str, seed: int = 0, **params) -> GBTClassificationModel:
    """Boosted-tree classifier on a two-class label."""
    return GBTClassifier(featuresCol="x", labelCol="label", seed=seed, **params).fit(assembled(df, features, target))


def shap_values(df: DataFrame, features: Sequence[str], model: GBTClassificationModel, keys: Sequence[str] = ()) -> DataFrame:
    """SHAP values in log-odds per row: ``keys``, ``phi`` array, ``base`` and the model's own ``margin``.

    Spark's margin is half the log-odds, hence the factor 2.
    """
    leaves = tree_paths(df.sparkSession, model)
    base = 2.0 * expected_margin(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 0))
            if len(x):
                phi = 2.0 * shap_matrix(x, leaves)
                yield pdf[list(keys)].assign(phi=list(phi), base=base, margin=pdf["margin"])

    scored = model.transform(assembled(df, features, keys=keys)).select(
        *keys, vector_to_array("x").alias("x"), (vector_to_array("rawPrediction")[1] * 2.0).alias("margin")
    )
    key_types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return scored.mapInPandas(explain, f"{key_types}phi ARRAY<DOUBLE>, base DOUBLE, margin DOUBLE")


def shap_importance(
    df: DataFrame, features: Sequence[str], target: str, num_features: int | None = None, seed: int = 0, fit_rows: DataFrame | None = None, **params
) -> DataFrame:
    """Mean absolute SHAP value per feature over all rows, ranked. The model is fitted on ``fit_rows``, else on all rows."""
    model = fit_boosted(df if fit_rows is None else fit_rows, features, target, seed, **params)
    phi = shap_values(df, features, model)
    means = [F.avg(F.abs(F.col("phi")[i])).alias(f"m{i}") for i in range(len(features))]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean_abs_shap")) for i, c in enumerate(features)])
    return top(phi.agg(*means).select(F.inline(cells)), "mean_abs_shap", num_features)


@dataclass(frozen=True)
class PcaSelection:
    """Selected features with their summed absolute loadings, the loadings table and the variance shares."""

    features: list[str]
    importance: DataFrame
    loadings: DataFrame
    variance: list[float]
    n_components: int


def pca_selection(
    df: DataFrame,
    features: Sequence[str],
    n_components: int | None = None,
    variance_threshold: float = 0.95,
    num_features_to_keep: int = 20,
) -> PcaSelection:
    """Rank features by absolute loadings on the leading components of the standardised data.

    All components are fitted once; without ``n_components`` the smallest number that reaches
    ``variance_threshold`` is kept.
    """
    spark = df.sparkSession
    vectors = assembled(df, features)
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(vectors)
    model = PCA(k=len(features), inputCol="z", outputCol="pc").fit(scaler.transform(vectors))
    shares = model.explainedVariance.toArray()
    if n_components is None:
        reached = np.cumsum(shares) >= variance_threshold
        n_components = int(np.argmax(reached)) + 1 if reached.any() else len(features)
    components = model.pc.toArray()[:, :n_components]
    weights = np.abs(components).sum(axis=1)
    order = np.argsort(-weights, kind="stable")[:num_features_to_keep]
    kept = [features[i] for i in order]
    importance = spark.createDataFrame([(features[i], float(weights[i])) for i in order], "feature STRING, importance DOUBLE")
    cells = [(f"PC{k + 1}", features[i], float(components[i, k])) for k in range(n_components) for i in order]
    loadings = spark.createDataFrame(cells, "component STRING, feature STRING, loading DOUBLE")
    return PcaSelection(kept, importance, loadings, [float(s) for s in shares], n_components)
