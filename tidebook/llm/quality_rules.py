"""Quality rules: fixed base rules, and a decision list learned from labelled statistics. DataFrame functions only.

``statistics`` counts over whole texts. ``learn`` grows one rule after another by sequential covering: a
rule is a conjunction of thresholds on statistics, grown by information gain on two thirds of the labelled
rows (told apart by a hash of the id), pruned on the other third, and kept if it is precise enough there.
Rows a rule covers are set aside before the next one. Candidate thresholds are quantiles; each step is one
aggregate into a small histogram (statistic x bin), so only histograms reach the driver and every labelled
row counts. ``verdict`` turns the list into one ordered CASE expression.

NULL and empty texts have zero counts and fail the base rules. Several labels of an id: the worst counts;
NULL labels are ignored. Without labelled rows of both kinds the list is empty and only the base decides.
Conditions of equal gain: the first statistic, its lowest threshold, "above" before "not above". Repeated rows each get
their row, and count as often in learning; very long texts are counted whole; an empty table gives no rows; only
``doc_id`` and ``text`` of documents are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import SPACE_GAP, SPACED_WORD, SPACES, UPPER, Scratch

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct", "n_lines"]
#: Statistics that rules may test, over the counts.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def removed(text: Column, characters: str) -> Column:
    """How many of the characters the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each row. Words are what white space parts; a repeated word lies in a window of
    eight words that the text holds twice or more; a repeated line equals an earlier line and holds a word."""
    text = F.col("text")
    split = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(SPACED_WORD)).alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "text",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = F.sequence(F.lit(1), F.col("n_words") - (REPEAT_WINDOW - 1))
    windows = F.when(F.col("n_words") >= REPEAT_WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice("hashes", i, REPEAT_WINDOW))))
    windowed = hashed.select("*", F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows")).drop("hashes")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    ranked = windowed.select("*", F.when(repeats, ordered).alias("ordered")).drop("windows")
    twins = F.filter("ordered", lambda x, k: (F.get("ordered", k - 1)["w"] == x["w"]) | (F.get("ordered", k + 1)["w"] == x["w"]))
    starts = ranked.select("*", F.array_sort(F.transform(twins, lambda x: x["i"])).alias("starts")).drop("ordered")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + REPEAT_WINDOW).alias("end"), (a["n"] + i + REPEAT_WINDOW - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    text = F.col("text")
    return starts.select(
        "doc_id",
        *[
            x.cast("bigint").alias(name)
            for name, x in {
                "n_words": F.col("n_words"),
                "word_chars": F.length(F.translate(text, SPACES, "")),
                "n_symbols": removed(text, SYMBOLS),
                "n_dup_lines": F.col("n_dup_lines"),
                "n_repeat_words": F.coalesce(covered, F.lit(0)),
                "n_upper": removed(text, UPPER),
                "n_digits": removed(text, "0123456789"),
                "n_marks": removed(text, "!?.,;:"),
                "n_distinct": F.col("n_distinct"),
                "n_lines": F.col("n_lines"),
            }.items()
        ],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature`` above (or not above) ``bound``, the ``step``-th threshold of the feature."""

    feature: str
    above: bool
    bound: float
    step: int

    def on_bins(self) -> Column:
        column = F.col(f"bin_{self.feature}")
        return column > self.step if self.above else column <= self.step

    def on_values(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > self.bound if self.above else value <= self.bound


def both(conditions: list[Column]) -> Column:
    whole = F.lit(True)
    for c in conditions:
        whole = whole & c
    return whole


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that covers the row, from 1; NULL if none does."""
    fired = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(both([c.on_values() for c in rule]), F.lit(i)).otherwise(fired)
    return fired


def thresholds(rows: DataFrame, steps: int = 40) -> dict[str, list[float]]:
    """Middles between neighbouring quantiles, over bad and over good rows; at most 2 * steps + 2 values a feature reach the driver."""
    shares = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    wanted = []
    for name in FEATURES:
        for kind in ("bad", "good"):
            wanted.append(F.percentile_approx(F.when(F.col(kind) > 0, F.col(name)), shares, F.lit(1000)).alias(f"{kind}_{name}"))
    row = rows.agg(*wanted).first()
    seen = {name: sorted({*(row[f"bad_{name}"] or []), *(row[f"good_{name}"] or [])}) for name in FEATURES}
    return {name: [(a + b) / 2 for a, b in zip(values, values[1:])] for name, values in seen.items()}


def bin_of(name: str, bounds: list[float]) -> Column:
    """How many of the bounds lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col(name)))


def best_condition(counts: list, bounds: dict[str, list[float]]) -> tuple[Condition, float] | None:
    """The condition of the largest information gain; counts: rows of (feature, bin, bad, good) of the growing part."""
    found, most = None, 0.0
    for name in FEATURES:
        bins = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["feature"] == name}
        bad, good = sum(b for b, _ in bins.values()), sum(g for _, g in bins.values())
        if not bad:
            continue
        before = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        for step in range(len(bounds[name])):
            b, g = bins.get(step, (0, 0))
            low_bad, low_good = low_bad + b, low_good + g
            for above, p, n in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                if p and n + p < bad + good:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > most + 1e-9:
                        found, most = Condition(name, above, bounds[name][step], step), gain
    return (found, most) if found else None


def learn(stats: DataFrame, labels: DataFrame, most_rules: int = 6, most_conditions: int = 3, precision: float = 0.97, support: int = 5) -> list[list[Condition]]:
    """An ordered list of rules for bad rows (``quality`` 0) among those that pass the base rules."""
    scratch = Scratch(stats.sparkSession)
    worst = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bad = (F.col("quality") == 0).cast("int")
    values = (
        stats.where(~base_failed())
        .join(worst, "doc_id")
        .select("doc_id", bad.alias("bad"), (1 - bad).alias("good"), *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])
    )
    rows = scratch.put("labelled-values", values)
    bounds = thresholds(rows)
    grows = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    names = [n for n in FEATURES if bounds[n]]
    bins = [bin_of(n, bounds[n]).alias(f"bin_{n}") for n in names]
    if not bins:
        return []
    binned = scratch.put("labelled-bins", rows.select("bad", "good", grows.alias("grows"), *bins))
    scratch.drop("labelled-values")

    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        left = binned.where(~both_any(rules))
        rule: list[Condition] = []
        while len(rule) < most_conditions:
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"bin_{n}").alias("bin")) for n in names]))
            inside = left.where(F.col("grows") & both([c.on_bins() for c in rule]))
            counts = inside.select(pairs.alias("x"), "bad", "good").groupBy("x.feature", "x.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
            best = best_condition(counts, bounds)
            if best is None:
                break
            rule.append(best[0])
        if not rule:
            break
        # Pruning: of the rule's beginnings, the most precise on the other third; the shorter of equals.
        ends = [both([c.on_bins() for c in rule[: k + 1]]) for k in range(len(rule))]
        tested = left.where(~F.col("grows")).agg(*[F.sum(F.when(e, F.col(kind))).alias(f"{kind}{k}") for k, e in enumerate(ends) for kind in ("bad", "good")]).first()
        scored = []
        for k in range(len(rule)):
            p, n = tested[f"bad{k}"] or 0, tested[f"good{k}"] or 0
            if p >= support:
                scored.append((round(p / (p + n), 6), -k))
        if not scored or max(scored)[0] < precision:
            break
        rules.append(rule[: 1 - max(scored)[1]])
    scratch.drop("labelled-bins")
    return rules


def both_any(rules: list[list[Condition]]) -> Column:
    covered = F.lit(False)
    for rule in rules:
        covered = covered | both([c.on_bins() for c in rule])
    return covered


def judged(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Counts of each row with ``base_failed``, ``rule`` (which rule fired) and ``kept``."""
    stats = Scratch(docs.sparkSession).put("text-statistics", statistics(docs))
    rules = learn(stats, labels, **settings)
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
