"""Descriptive analysis of a feature table: quantiles, summary, correlation, class counts, ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A value's 64 bits are read 16 at a time, from the most significant.
DIGIT = 16
#: Values that share the bits found so far, few enough to tell apart in one more pass.
FEW = 1 << 16
#: Counts a task gathers before it adds equal ones up.
HELD = 1 << 20


def _wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def _melt(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Long form ``(feature_ix, value)`` without NULLs."""
    pairs = ", ".join(f"struct({i} AS feature_ix, CAST(`{c}` AS DOUBLE) AS value)" for i, c in enumerate(columns))
    return df.selectExpr(*keep, f"inline(array({pairs}))").where("value IS NOT NULL")


def _array(values: Sequence[float]) -> str:
    cells = ", ".join(f"double('{'Infinity' if v == math.inf else '-Infinity' if v == -math.inf else repr(v)}')" for v in values)
    return f"array({cells})"


def sizes(df: DataFrame, columns: Sequence[str]) -> list[int]:
    """How many values each column has."""
    wide = _wide(df, columns)
    return list(wide.agg(*[F.count(c).alias(c) for c in wide.columns]).first())


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0.0 is 0.0 and NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    negative = bits >> np.uint64(63) > 0
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def double_of(bits: int) -> float:
    raw = bits & ((1 << 63) - 1) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _present(column: pa.Array) -> np.ndarray:
    return column.drop_null().to_numpy(zero_copy_only=False)


def _digit_counts(wide: DataFrame, open_: Sequence[tuple[int, int]], done: int, width: int) -> DataFrame:
    """``(slot, digit, n)``: for each open (column, leading ``done`` bits), a slot, how many values have which next
    ``width`` bits; digits of all 64 bits are shifted into the signed range.

    One pass over the columns; a task keeps only the digits that occur, and adds them up before the shuffle.
    """
    prefixes = {c: np.array(sorted(p for of, p in open_ if of == c), np.uint64) for c in sorted({c for c, _ in open_})}
    slots = {c: np.array([open_.index((c, int(p))) for p in ps], np.int32) for c, ps in prefixes.items()}

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        slot, digit, n = (np.concatenate(p) for p in zip(*parts))
        by = np.lexsort((digit, slot))
        slot, digit, n = slot[by], digit[by], n[by]
        heads = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (digit[1:] != digit[:-1])))
        return slot[heads], digit[heads], np.add.reduceat(n, heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for i, c in enumerate(prefixes):
                bits = ordered_bits(_present(batch.column(i)))
                at = np.zeros(len(bits), np.int64)
                if done:
                    top = bits >> np.uint64(64 - done)
                    at = np.minimum(np.searchsorted(prefixes[c], top), len(prefixes[c]) - 1)
                    inside = prefixes[c][at] == top
                    bits, at = bits[inside], at[inside]
                if not len(bits):
                    continue
                if width == 64:
                    digit = (bits ^ np.uint64(1 << 63)).view(np.int64)
                else:
                    digit = ((bits >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                parts.append(summed([(slots[c][at], digit, np.ones(len(digit), np.int64))]))
                held += len(parts[-1][0])
            if held > HELD:
                parts = [summed(parts)]
                held = len(parts[0][0])
        if held:
            found = summed(parts)
            for low in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in found], ["slot", "digit", "n"])

    counted = wide.select(*[f"c{c}" for c in prefixes]).mapInArrow(run, "slot INT, digit BIGINT, n BIGINT")
    return counted.groupBy("slot", "digit").agg(F.sum("n").alias("n"))


def order_statistics(df: DataFrame, columns: Sequence[str], ranks: Sequence[Sequence[int]], known_sizes: Sequence[int], few: int = FEW) -> list[dict[int, float]]:
    """Exact values at the given 0-based ranks of each column, NULLs left out, by radix selection.

    Doubles become integers of the same order. Each pass counts, for the leading bits that hold a wanted rank, how
    many values have which next 16 bits; the running count tells in which of them the rank lies. Where all open
    leading bits are shared by at most ``few`` values, the pass takes all bits that are left. After four passes at
    most all 64 bits are known, whatever the values: no sketch, no sort, and no task sees more than 65,536 counts a
    rank. All columns share the passes, and one row per rank reaches the driver. Hand in a written table.
    """
    wide = _wide(df, columns)
    wanted = [(i, r) for i, rs in enumerate(ranks) for r in sorted(set(rs))]
    # Leading bits found, the rank among the values that share them, and how many do.
    lead, rest, share = [0] * len(wanted), [r for _, r in wanted], [known_sizes[c] for c, _ in wanted]
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("digit"))
    done = 0
    while wanted and done < 64:
        width = 64 - done if max(share) <= few else DIGIT
        open_ = sorted({(c, p) for (c, _), p in zip(wanted, lead)})
        targets = [(t, open_.index((c, p)), r) for t, ((c, _), p, r) in enumerate(zip(wanted, lead, rest))]
        table = df.sparkSession.createDataFrame(targets, "t INT, slot INT, place BIGINT")
        running = _digit_counts(wide, open_, done, width).withColumn("upto", upto)
        found = running.join(F.broadcast(table), "slot").where("place < upto AND place >= upto - n")
        for r in found.select("t", "digit", "n", (F.col("upto") - F.col("n")).alias("below")).collect():  # one row per rank
            lead[r["t"]] = lead[r["t"]] << width | (r["digit"] + (1 << 63) if width == 64 else r["digit"])
            rest[r["t"]] -= r["below"]
            share[r["t"]] = r["n"]
        done += width
    out: list[dict[int, float]] = [{} for _ in columns]
    for (c, r), bits in zip(wanted, lead):
        out[c][r] = double_of(bits)
    return out


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], known_sizes: Sequence[int] | None = None) -> list[list[float | None]]:
    """Exact quantiles with linear interpolation between neighbouring ranks, one list per column."""
    known_sizes = known_sizes or sizes(df, columns)
    places = [[(n - 1) * p for p in probs] if n else [] for n in known_sizes]
    ranks = [[r for x in xs for r in (math.floor(x), math.ceil(x))] for xs in places]
    known = order_statistics(df, columns, ranks, known_sizes)
    out: list[list[float | None]] = []
    for i, xs in enumerate(places):
        if not xs:
            out.append([None] * len(probs))
            continue
        ends = [(known[i][math.floor(x)], known[i][math.ceil(x)], x - math.floor(x)) for x in xs]
        out.append([a + (b - a) * f for a, b, f in ends])
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column; at most five passes in all."""
    wide = _wide(df, columns)
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = wide.agg(*[f(c).alias(f"{c}_{name}") for c in wide.columns for name, f in parts.items()]).first()
    moments = [{name: row[f"{c}_{name}"] for name in parts} for c in wide.columns]
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75], [m["n"] for m in moments])
    rows = [(c, m["n"], m["mean"], m["std"], m["min"], *q, m["max"]) for c, m, q in zip(columns, moments, quarters)]
    schema = "feature STRING, count BIGINT, mean DOUBLE, std DOUBLE, min DOUBLE, q25 DOUBLE, q50 DOUBLE, q75 DOUBLE, max DOUBLE"
    return df.sparkSession.createDataFrame(rows, schema)


# A deviation below this share of the mean is what rounding leaves of a constant.
CONSTANT = 1e-13


class _Comoments:
    """Counts, means and centred products of all pairs of columns over the rows that have both.

    ``mean[i, j]`` is the mean of column i and ``square[i, j]`` its centred square where column j has a value too.
    """

    def __init__(self, size: int):
        self.n, self.mean, self.square, self.product = (np.zeros((size, size)) for _ in range(4))

    def add(self, columns: Sequence[pa.Array]) -> None:
        held = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], 1).astype(float)
        x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], 1)
        # Close to the mean, and exactly 0 for a constant column.
        first = x[held.argmax(axis=0), np.arange(x.shape[1])]
        near = (x - first) * held
        shift = near.sum(axis=0) / np.maximum(held.sum(axis=0), 1)
        x = (near - shift) * held
        n = held.T @ held
        some = np.maximum(n, 1)
        mean = x.T @ held / some
        square = np.maximum((x * x).T @ held - n * mean * mean, 0.0)
        self.merge(n, mean + (first + shift)[:, None], square, x.T @ x - n * mean * mean.T)

    def merge(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, product: np.ndarray) -> None:
        whole = np.maximum(self.n + n, 1)
        apart = np.where((self.n > 0) & (n > 0), mean - self.mean, 0.0)
        weight = self.n * n / whole
        self.square += square + apart * apart * weight
        self.product += product + apart * apart.T * weight
        self.mean = np.where(self.n > 0, self.mean + apart * n / whole, mean)
        self.n = self.n + n


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both, as ``(feature_a, feature_b, r)``.

    NULL for a pair without two rows or with a constant column, the diagonal included. One pass: a task turns its
    batches into matrices of counts, means and centred products, and hands on one row per pair; these are put together
    around the pair's mean after one shuffle. Sums are centred, so small spreads around large values keep their
    digits.
    """
    size = len(columns)
    a, b = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Comoments(size)
        for batch in batches:
            if batch.num_rows:
                total.add(batch.columns)
        shown = [a, b, total.n[a, b], total.mean[a, b], total.mean[b, a], total.square[a, b], total.square[b, a], total.product[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if k < 2 else x) for k, x in enumerate(shown)], names)

    names = ["a", "b", "n", "x", "y", "xx", "yy", "xy"]
    parts = _wide(df, columns).mapInArrow(run, "a INT, b INT, " + ", ".join(f"{c} DOUBLE" for c in names[2:])).where("n > 0")
    pair = Window.partitionBy("a", "b")
    centred = parts.withColumns({f"m{c}": F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair) for c in ("x", "y")})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = centred.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        F.first("mx").alias("mx"),
        F.first("my").alias("my"),
        *[F.sum(F.col(c) + F.col("n") * p).alias(c) for c, p in (("xx", dx * dx), ("yy", dy * dy), ("xy", dx * dy))],
    )
    found: dict[tuple[int, int], float | None] = {}
    for r in sums.collect():  # one row per pair of columns
        spread = [math.sqrt(r[c] / r["n"]) > CONSTANT * abs(r[m]) for c, m in (("xx", "mx"), ("yy", "my"))]
        if r["n"] > 1 and all(spread):
            found[r["a"], r["b"]] = 1.0 if r["a"] == r["b"] else max(-1.0, min(1.0, r["xy"] / math.sqrt(r["xx"]) / math.sqrt(r["yy"])))
    rows = [(a, b, found.get((min(i, j), max(i, j)))) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature_a STRING, feature_b STRING, r DOUBLE")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class, most frequent first."""
    counts = df.groupBy(F.col(f"`{target}`").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "class")


def classes(df: DataFrame, target: str) -> DataFrame:
    """Distinct classes."""
    return df.select(F.col(f"`{target}`").alias("class")).distinct()


def top(ranking: DataFrame, score: str, n: int | None = None, label: str = "feature") -> DataFrame:
    """Highest scores first, all of them or the first ``n``."""
    ordered = ranking.orderBy(F.desc(score), label)
    return ordered if n is None else ordered.limit(n)


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Inner edges of equal-count bins: the values at ranks ceil(n*q) (from 1) for q = 1/bins, 2/bins, …"""
    known_sizes = sizes(df, columns)
    ranks = [[max(-(-n * k // bins), 1) - 1 for k in range(1, bins)] if n else [] for n in known_sizes]
    known = order_statistics(df, columns, ranks, known_sizes)
    return [[known[i][r] for r in rs] for i, rs in enumerate(ranks)]


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of each feature with a class, in nats, over equal-count bins of the feature.

    Joint counts come from one pass: rows are unpivoted and counted per (feature, bin, class) before the
    shuffle, so the exchange carries at most features x bins x classes rows per task.
    """
    edges = bin_edges(df, features, bins)
    lookup = ", ".join(_array(sorted(set(es))) for es in edges)
    tall = _melt(df.withColumn("class", F.expr(f"`{target}`")), features, "class")
    bucket = F.expr(f"size(filter(array({lookup})[feature_ix], e -> value > e))")
    joint = tall.withColumn("bin", bucket).groupBy("feature_ix", "bin", "class").agg(F.count(F.lit(1)).alias("n"))
    by_feature = Window.partitionBy("feature_ix")
    shares = joint.withColumns(
        {
            "total": F.sum("n").over(by_feature),
            "in_bin": F.sum("n").over(Window.partitionBy("feature_ix", "bin")),
            "in_class": F.sum("n").over(Window.partitionBy("feature_ix", "class")),
        }
    )
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("in_bin") * F.col("in_class")))
    names = F.array(*[F.lit(c) for c in features])
    scored = shares.groupBy("feature_ix").agg(F.sum(term).alias("mutual_information"))
    return scored.select(names[F.col("feature_ix")].alias("feature"), "mutual_information")
