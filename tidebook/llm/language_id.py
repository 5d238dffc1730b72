"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's n-grams of one to three characters (lower case, what is no letter as a space) are hashed into
``BUCKETS`` features; weights are (1 + log count) * idf, scaled to length 1. Document frequencies count every
training row in one Arrow pass with a small table per task. Weights are fitted by follow-the-regularised-
leader with elastic-net penalties on a bounded sample (at most ``fit_rows`` rows a language, chosen by a hash
of the id), the temperature of the softmax on as bounded a second sample. Only sampled features (at most
BUCKETS numbers a row), frequencies and languages reach the driver; the model goes out as one array.

Rows with crc32(doc_id as text) mod 3 = 1 are held out from all of it; so are rows without id, language or
letters. A text that is NULL or has no letter is "und" with score 0; so is every text if nothing was learned.
Repeated rows each get their row. Only ``doc_id``, ``text`` and, for learning, ``lang`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import pieces, release_worker_cache, text_buffers, text_key, without

BUCKETS = 1 << 15
ORDERS = 3
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(c.isalpha() for c in text)


def letters_table() -> np.ndarray:
    """ASCII as it enters n-grams: letters, and a space for anything else."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def bucket_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets that occur in each text, and how often."""
    joined = "\x00".join(t.lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.flatnonzero(codes == 0) if joined.count("\x00") == len(texts) - 1 else None
    if cuts is None:  # a text holds the separator itself
        for t in texts:
            yield from bucket_counts([t.replace("\x00", " ")])
        return
    ascii_table = letters_table()
    shown = np.where(codes < 128, ascii_table[np.minimum(codes, 127)], codes).astype(np.uint64)
    grams = np.full((len(codes), ORDERS), BUCKETS, np.int64)
    h = np.zeros(len(codes), np.uint64)
    ends = np.append(cuts, len(codes))
    starts = np.insert(cuts + 1, 0, 0)
    for n in range(ORDERS):
        h = h[: len(codes) - n] * np.uint64(0x9FB21C651E98DF25) + shown[n:] + np.uint64(n + 1)
        grams[: len(h), n] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 15)
        for back in range(n):  # n-grams that would run over the end
            at = ends - 1 - back
            grams[at[at >= starts], n] = BUCKETS
    for start, end in zip(starts, ends):
        counts = np.bincount(grams[start:end].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
        seen = np.flatnonzero(counts)
        yield seen, counts[seen]


def weighted(seen: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[seen]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    _, offsets = text_buffers(column)
    for low, high in pieces(offsets, 1 << 19):
        yield low, column.slice(low, high - low).to_pylist()


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                for seen, _ in bucket_counts([t or "" for t in texts]):
                    total[seen] += 1
                total[BUCKETS] += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total[:BUCKETS], int(total[BUCKETS])


def sampled_features(rows: DataFrame, per_language: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, order, buckets, counts) of at most ``per_language`` rows a language with letters."""
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    spot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 3 * per_language / n)))])
    drawn = rows.withColumn("spot", spot).where(F.col("spot") < share[F.col("lang")] * float(1 << 30))
    first = Window.partitionBy("lang").orderBy("spot", "doc_id")
    chosen = drawn.withColumn("order", F.row_number().over(first)).where(F.col("order") <= per_language).select("lang", "order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_runs(batch.column(2)):
                for i, (seen, counts) in enumerate(bucket_counts([t or "" for t in texts])):
                    if has_letter(texts[i] or ""):
                        lists = [pa.array([v.tolist()], pa.list_(pa.int32())) for v in (seen, counts)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(low + i, 1), batch.column(1).slice(low + i, 1), *lists], ["lang", "ord", "seen", "counts"])

    table = chosen.mapInArrow(run, "lang string, ord int, seen array<int>, counts array<int>").toArrow()
    table = table.sort_by([("ord", "ascending"), ("lang", "ascending")])
    # Views of the collected columns: a Python object for each number would stay with the driver long after.
    seen, counts = (pc.list_flatten(table[c]).combine_chunks().to_numpy(zero_copy_only=False) for c in ("seen", "counts"))
    ends = np.cumsum(pc.list_value_length(table["seen"]).to_numpy()).tolist()
    spans = zip([0, *ends[:-1]], ends)
    return [(lang, order, seen[a:b], counts[a:b]) for lang, order, (a, b) in zip(table["lang"].to_pylist(), table["ord"].to_pylist(), spans)]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, rate: float = 0.5, damping: float = 1.0, lasso: float = 1e-3, ridge: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (last row: bias) after passes over (class, buckets, values) by per-coordinate FTRL-proximal steps."""
    z, squares = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        root = (damping + np.sqrt(squares[at])) / rate + ridge
        return np.where(np.abs(z[at]) <= lasso, 0.0, (np.sign(z[at]) * lasso - z[at]) / root)

    for _ in range(epochs):
        for label, seen, values in rows:
            at, x = np.append(seen, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error[None, :]
            grown = squares[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(squares[at])) / rate * w
            squares[at] = grown
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Targets are smoothed by one count in n + 2 rows, so that a separable sample does not ask for certainty.
    """
    classes, smooth = scores.shape[1], 1 / (len(scores) + 2)
    target = np.full(scores.shape, smooth / max(1, classes - 1))
    target[np.arange(len(scores)), labels] = 1 - smooth if classes > 1 else 1

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(docs: DataFrame, fit_rows: int = 400, calibration_rows: int = 150) -> LanguageModel | None:
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    found = sampled_features(usable, fit_rows + calibration_rows)
    languages = sorted({lang for lang, *_ in found})
    if not languages:
        return None
    frequency, n = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    rows = [(languages.index(lang), order, seen, weighted(seen, counts, idf)) for lang, order, seen, counts in found]
    # Where a language has few rows, the last quarter of them calibrates.
    most = {c: max(order for k, order, *_ in rows if k == c) for c in range(len(languages))}
    bound = {c: min(fit_rows, max(1, m * 3 // 4)) for c, m in most.items()}
    fit = [(c, seen, x) for c, order, seen, x in rows if order <= bound[c]]
    rest = [(c, seen, x) for c, order, seen, x in rows if order > bound[c]] or fit
    weights, bias = fit_ftrl(fit, len(languages))
    scores = np.array([x @ weights[seen] + bias for _, seen, x in rest])
    return LanguageModel(languages, idf, weights, bias, best_temperature(scores, np.array([c for c, *_ in rest])))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, text_key, held_out, lang_pred and score (the calibrated probability) of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "text_key", "held_out", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        model = shared.value
        for batch in batches:
            predicted, score = [], []
            for _, texts in text_runs(batch.column(3)):
                for text, (seen, counts) in zip(texts, bucket_counts([t or "" for t in texts])):
                    if model is None or not has_letter(text or ""):
                        predicted.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    p = softmax((weighted(seen, counts, model.idf) @ model.weights[seen] + model.bias) / model.temperature)
                    predicted.append(model.languages[int(p.argmax())])
                    score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(predicted, pa.string()), pa.array(score, pa.float64())], names)

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, text_key bigint, held_out boolean, lang_pred string, score double")


def any_language() -> LanguageModel:
    """Takes every text with a letter for one unnamed language."""
    return LanguageModel(["any"], np.ones(BUCKETS), np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)


def in_a_language(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: letters, and a probability of ``least_score``.

    Where nothing can be learned, because no row has a label, only texts without a letter go. Very long texts are
    judged whole, repeated rows alike; an empty table stays empty; columns may have any name."""
    found = predict(docs, learn(docs) or any_language())
    return without(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_score)))
