"""Distributed models on look-back sequences.

Sequences become one flat vector per row; ``pyspark.ml`` trains on the cluster. The classifier is a
feed-forward network over the whole window, the regressors are linear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = "flat_sequence"


def flat(seqs: DataFrame) -> DataFrame:
    """Add the sequence as one vector."""
    return seqs.withColumn(FLAT, array_to_vector(F.flatten("x")))


def fit_sequence_classifier(
    train: DataFrame, look_back: int, num_features: int, hidden: Sequence[int] = (128, 64, 32), epochs: int = 100, seed: int = 0
) -> MultilayerPerceptronClassificationModel:
    """Train on ``(x, y)`` sequences; the number of classes is read from the labels."""
    num_classes = int(train.agg(F.max("y")).first()[0]) + 1
    network = MultilayerPerceptronClassifier(
        featuresCol=FLAT,
        labelCol="label",
        layers=[look_back * num_features, *hidden, max(num_classes, 2)],
        maxIter=epochs,
        seed=seed,
    )
    return network.fit(flat(train).select(FLAT, F.col("y").cast("double").alias("label")))


def predict_classes(model: MultilayerPerceptronClassificationModel, seqs: DataFrame) -> DataFrame:
    """Keys, ``y``, class ``yhat`` and probabilities ``p``."""
    scored = model.transform(flat(seqs))
    keys = [c for c in seqs.columns if c != "x"]
    return scored.select(*keys, F.col("prediction").cast("int").alias("yhat"), vector_to_array("probability").alias("p"))


def fit_sequence_regressors(
    train: DataFrame, targets: Sequence[str], ridge: float = 1e-3
) -> dict[str, LinearRegressionModel]:
    """One linear model per target on flattened sequences."""
    vectors = flat(train)
    return {
        t: LinearRegression(featuresCol=FLAT, labelCol="label", regParam=ridge).fit(
            vectors.select(FLAT, F.col(f"`{t}`").cast("double").alias("label"))
        )
        for t in targets
    }


def predict_values(models: dict[str, LinearRegressionModel], seqs: DataFrame) -> DataFrame:
    """Keys, targets and a ``{target}_hat`` column per model."""
    scored = flat(seqs)
    for t, model in models.items():
        scored = model.setPredictionCol(f"{t}_hat").transform(scored)
    return scored.drop(FLAT, "x")
