"""Evaluation of class and value predictions.

Prediction frame: ``row_id, model_id, y`` and either ``scores`` (logits) or ``p`` (probabilities).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def softmax(scores: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest for range."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)


def argmax(p: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def with_prediction(scored: DataFrame) -> DataFrame:
    """Add ``p``, the class ``yhat``, its probability and the probability of class 1 to a frame of logits."""
    with_p = scored.withColumn("p", softmax(F.col("scores")))
    return with_p.withColumns({"yhat": argmax(F.col("p")), "top_p": F.array_max("p"), "p1": F.col("p")[1]})


def ensemble(predictions: DataFrame, num_classes: int) -> DataFrame:
    """Majority vote over the models of a row (lowest class wins ties) and mean class probabilities.

    One aggregate per row: a vote count and a probability mean for every class.
    """
    votes = [F.count_if(F.col("yhat") == k).alias(f"votes_{k}") for k in range(num_classes)]
    means = [F.avg(F.col("p")[k]).alias(f"mean_p{k}") for k in range(num_classes)]
    pooled = predictions.groupBy("row_id").agg(F.max("y").alias("y"), *votes, *means)
    ballot = F.array(*[F.col(f"votes_{k}") for k in range(num_classes)])
    return pooled.withColumns(
        {"yhat": argmax(ballot), "p": F.array(*[F.col(f"mean_p{k}") for k in range(num_classes)])}
    ).select("row_id", "y", "yhat", "p")


def log_probabilities(predictions: DataFrame) -> DataFrame:
    """Natural logs of ``p``; NULL for a zero probability."""
    return predictions.withColumn("log_p", F.transform("p", lambda v: F.ln(F.nullif(v, F.lit(0.0)))))


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows with ``y = yhat``."""
    return predictions.agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts per true and predicted class."""
    return predictions.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, num_classes: int) -> DataFrame:
    """One row per class, one column per predicted class, zero filled: a class that is never true has its row.

    A true class outside ``range(num_classes)`` keeps its row too.
    """
    spark = predictions.sparkSession
    cells = confusion(predictions).groupBy("y").pivot("yhat", list(range(num_classes))).agg(F.sum("n"))
    every = spark.range(num_classes).select(F.col("id").cast(predictions.schema["y"].dataType).alias("y"))
    whole = cells.join(every, "y", "full")
    return whole.select("y", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"predicted_{k}") for k in range(num_classes)])


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    One pass over the predictions gives the confusion counts; the rest works on at most classes x classes
    rows. Every line of the report is a ratio of two sums, so one small aggregate makes them all.
    """
    none, n = F.lit(0).cast("bigint"), F.col("n")
    hit = F.when(F.col("y") == F.col("yhat"), n).otherwise(none)
    as_true = F.struct(F.col("y").alias("class"), hit.alias("hits"), n.alias("actual"), none.alias("predicted"))
    as_guess = F.struct(F.col("yhat").alias("class"), none.alias("hits"), none.alias("actual"), n.alias("predicted"))
    sides = confusion(predictions).select(F.inline(F.array(as_true, as_guess)))
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "actual", "predicted")])

    zero = F.lit(0.0)
    scored = sums.withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), zero),
            "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("actual")), zero),
        }
    )
    f1 = F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    metrics = ["precision", "recall", "f1"]
    one, weight = F.lit(1.0), F.col("actual").cast("double")

    def line(label: Column, top: dict[str, Column], below: Column) -> Column:
        return F.struct(
            label.cast("string").alias("label"), *[top[m].alias(m) for m in metrics], below.alias("below"), "actual"
        )

    plain = {m: F.col(m) for m in metrics}
    lines = F.array(
        line(F.col("class"), plain, one),
        line(F.lit("accuracy"), {m: F.col("hits").cast("double") for m in metrics}, weight),
        line(F.lit("macro avg"), plain, one),
        line(F.lit("weighted avg"), {m: F.col(m) * weight for m in metrics}, weight),
    )
    tall = scored.withColumn("f1", F.coalesce(f1, zero)).select(F.inline(lines))
    return tall.groupBy("label").agg(
        *[F.try_divide(F.sum(m), F.sum("below")).alias(m) for m in metrics], F.sum("actual").alias("support")
    )


def prob_histogram(predictions: DataFrame, bins: int, value: Column | None = None) -> DataFrame:
    """Counts per true class and equal-width bin over that class's own range; the last bin is closed.

    ``value`` defaults to the probability of the row's true class. Every class has all its bins, empty ones
    with 0. Rows without a value are left out; a class with one value only has it in bin 1.
    """
    scored = predictions.withColumn("value", F.col("p")[F.col("y")] if value is None else value).where("value IS NOT NULL")
    ranges = scored.groupBy("y").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)) + 1
    counts = scored.join(ranges, "y").groupBy("y", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ranges.select("y", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counts, ["y", "bin"], "left").select(
        "y", "bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n")
    )


def uniform(key: Column, seed: int) -> Column:
    """Reproducible number in [0, 1) from a key: the first 32 bits of an MD5. A retried task repeats it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def random_baseline(predictions: DataFrame, num_classes: int, seed: int = 0) -> DataFrame:
    """A uniform random class and random class probabilities for every row, scored against ``y``."""
    draws = [uniform(F.col("row_id"), seed + 1 + k) for k in range(num_classes)]
    return predictions.withColumns(
        {
            "yhat": F.floor(uniform(F.col("row_id"), seed) * num_classes).cast("int"),
            "p": F.array(*draws),
        }
    )


def regression_errors(predictions: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean squared and mean absolute error per target; predictions are in ``{target}_hat``."""
    aggs = []
    for i, t in enumerate(targets):
        gap = F.col(f"`{t}`") - F.col(f"`{t}_hat`")
        aggs += [F.avg(gap * gap).alias(f"mse_{i}"), F.avg(F.abs(gap)).alias(f"mae_{i}")]
    cells = [F.struct(F.lit(t).alias("target"), F.col(f"mse_{i}").alias("mse"), F.col(f"mae_{i}").alias("mae")) for i, t in enumerate(targets)]
    return predictions.agg(*aggs).select(F.inline(F.array(*cells)))


def aligned(predicted: DataFrame, actual: DataFrame, keys: Sequence[str] = ("symbol", "session", "bar_ix")) -> DataFrame:
    """Predicted against actual values of the same bar."""
    return actual.join(predicted, list(keys))
