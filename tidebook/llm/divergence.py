"""Source divergence audit: how far the term frequencies of a language's sources lie apart, on run-length columns.

Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z as a-z. A language keeps the V terms that at least
``least_docs`` of its rows hold. A (language, source) group gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)),
N its occurrences of kept terms; a language does so with all its rows. f = floor((p - q)^2 / q).

* ``pair``: for each other source of the language, the sum of f over all kept terms, p the group's and q its.
* ``term``: the kept terms of a group with p above the language's q, by f, the first ``most_terms``.

Method: one Arrow pass counts terms per task, two shuffled sums make one sparse count vector per (language, term).
The vocabulary is ordered by these vectors and dealt out by range, so terms with equal counts lie together. Each
stretch of at most ``BLOCK_ENTRIES`` counts is a block, where every group is a run-length column. For each pair of
columns the run boundaries are intersected and f is multiplied by the length of the common run; blocks add up. A
block has one row per group, so what is brought together is bounded by the groups of a language, whose square is
the size of the result. All arithmetic is on integers.

NULL text, lang and source count as ''. Every occurring group is listed, also without terms; V = 0 gives value 0.
Repeated rows count each. Ties go to the smaller item by UTF-8. An empty table gives no row. A long text is cut
between words into pieces for the pass; a term of any length is one term. Only text, lang and source are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, WordSpans, byte_class, byte_values, sent_if_small, text_buffers

SCALE = 1_000_000_000
#: Counts that a block of the vocabulary holds before it closes, and bytes of text that numpy works on at a time.
BLOCK_ENTRIES = 1 << 18
CUT_BYTES = 1 << 20
#: Distinct (group, term) rows that a task gathers before it hands them on.
HELD = 1 << 19


def letter_class() -> np.ndarray:
    """256 flags: A-Z, a-z and all bytes of characters beyond ASCII."""
    flags = byte_class("alnum")
    flags[ord("0") : ord("9") + 1] = False
    return flags


def cuts(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(first byte, past-the-end byte, first text) of stretches of about ``limit`` bytes that part no word."""
    out, text, n = [], 0, len(offsets) - 1
    while text < n:
        upto = int(np.searchsorted(offsets, offsets[text] + limit, "right")) - 1
        if upto > text:
            out.append((int(offsets[text]), int(offsets[upto]), text))
            text = upto
            continue
        low, end = int(offsets[text]), int(offsets[text + 1])
        while low < end:
            high = min(end, low + limit)
            while high < end and flags[data[high]]:
                gaps = np.flatnonzero(~flags[data[high : min(end, high + limit)]])
                high = high + int(gaps[0]) if len(gaps) else min(end, high + limit)
            out.append((low, high, text))
            low = high
        text += 1
    return out


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words at these bytes, A-Z as a-z."""
    size = end - start
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    chars = data[np.repeat(start - ends + size, size) + np.arange(total)]
    chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars).astype(np.uint8)
    bounds = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.tobytes()), pa.py_buffer(chars.tobytes()))


def summed(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and rows of the group that hold it."""
    flags = letter_class()
    values = byte_values(flags)
    columns = ["lang", "source", "term", "n", "docs"]

    def counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        data, offsets = text_buffers(batch.column(2))
        groups = pa.StructArray.from_arrays([batch.column(0).cast(pa.large_string()), batch.column(1).cast(pa.large_string())], ["lang", "source"])
        keys = pa.Table.from_arrays([groups.field(0), groups.field(1)], ["lang", "source"])
        distinct = keys.group_by(["lang", "source"]).aggregate([])
        where = {pair: i for i, pair in enumerate(zip(distinct["lang"].to_pylist(), distinct["source"].to_pylist()))}
        group_of = np.array([where[pair] for pair in zip(keys["lang"].to_pylist(), keys["source"].to_pylist())], np.int64)
        seen_text, seen = -1, np.zeros(0, np.uint64)
        for low, high, first in cuts(data, offsets, flags, cut_bytes):
            last = int(np.searchsorted(offsets, high, "left"))
            bounds = np.clip(offsets[first : last + 1], low, high)
            spans = WordSpans(data, bounds, flags, values)
            if not len(spans.start):
                continue
            # Terms of each text once, then of each group.
            by = np.lexsort((spans.hash, spans.text))
            text, hashed = spans.text[by], spans.hash[by]
            new = np.ones(len(by), bool)
            new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
            at = np.flatnonzero(new)
            n, text, hashed, at = np.diff(np.append(at, len(by))), text[at], hashed[at], by[at]
            holds = np.ones(len(at), np.int64)
            if first == seen_text:  # the stretch goes on with a long text
                holds[np.isin(hashed, seen)] = 0
                seen = np.union1d(seen, hashed)
            elif last == first + 1 and high < offsets[last]:
                seen_text, seen = first, hashed
            group = group_of[first + text]
            by = np.lexsort((hashed, group))
            new = np.ones(len(by), bool)
            new[1:] = (group[by][1:] != group[by][:-1]) | (hashed[by][1:] != hashed[by][:-1])
            heads = np.flatnonzero(new)
            rows = by[heads]
            take = pa.array(group[rows])
            yield pa.Table.from_arrays(
                [
                    distinct["lang"].combine_chunks().take(take),
                    distinct["source"].combine_chunks().take(take),
                    spelled(spans.data, spans.start[at[rows]], spans.end[at[rows]]),
                    pa.array(np.add.reduceat(n[by], heads)),
                    pa.array(np.add.reduceat(holds[by], heads)),
                ],
                columns,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0
        for batch in batches:
            for part in counted(batch):
                parts.append(part)
                held += len(part)
                if held > 2 * HELD:
                    parts = [summed(parts)]
                    held = len(parts[0])
                    if held > HELD:
                        yield from parts[0].cast(schema).to_batches(max_chunksize=1 << 16)
                        parts, held = [], 0
        if parts:
            yield from summed(parts).cast(schema).to_batches(max_chunksize=1 << 16)

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    found = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(n: Column, total: Column, terms: Column) -> Column:
    """p of a count; the product needs more than 64 bits for counts above 9 * 10^9."""
    wide = "decimal(20,0)"
    return F.lit(1).cast("bigint") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast(wide), (total + terms).cast(wide))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def run_length_columns(vectors: DataFrame, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(lang, block, size, source, starts, lengths, counts): for each block of the ordered vocabulary and each group
    with a term in it, the runs of equal counts above 0; what lies between them is 0."""

    def encoded(lang: str, block: str, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]], size: int) -> pa.RecordBatch:
        at = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        named = pa.chunked_array([p[2] for p in parts]).combine_chunks().dictionary_encode()
        source = named.indices.to_numpy()
        by = np.lexsort((at, source))
        at, n, source = at[by], n[by], source[by]
        new = np.ones(len(at), bool)
        new[1:] = (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1) | (n[1:] != n[:-1])
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(at)))
        bounds = np.searchsorted(source[heads], np.arange(len(named.dictionary) + 1))
        rows = len(named.dictionary)
        nested = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (at[heads], lengths, n[heads])]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * rows, pa.string()), pa.array([block] * rows, pa.string()), pa.array([size] * rows, pa.int64()), named.dictionary.cast(pa.string()), *nested],
            ["lang", "block", "size", "source", "starts", "lengths", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, block, parts, size, held = None, "", [], 0, 0
        for batch in batches:
            langs = batch.column(0)
            values = langs.to_pylist()
            edges = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
            vectors_of = batch.column(2)
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                while low < high:
                    if lang != values[low] or held >= entries:
                        if parts:
                            yield encoded(lang, block, parts, size)
                        # The first term of a block names it.
                        lang, block, parts, size, held = values[low], batch.column(1)[low].as_py(), [], 0, 0
                    sizes = pc.list_value_length(vectors_of.slice(low, high - low)).to_numpy()
                    take = max(1, int(np.searchsorted(np.cumsum(sizes), entries - held, "left")) + 1)
                    upto = min(high, low + take)
                    chosen = vectors_of.slice(low, upto - low)
                    flat = chosen.flatten()
                    at = np.repeat(np.arange(size, size + upto - low), sizes[: upto - low])
                    parts.append((at, flat.field(1).to_numpy(), flat.field(0)))
                    held += len(at)
                    size += upto - low
                    low = upto
        if parts:
            yield encoded(lang, block, parts, size)

    ordered = vectors.select("lang", "term", "counts").repartitionByRange("lang", "counts", "term").sortWithinPartitions("lang", "counts", "term")
    return ordered.mapInArrow(run, "lang string, block string, size bigint, source string, starts array<bigint>, lengths array<bigint>, counts array<bigint>")


def exact_frequency(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / whole) by long division in three steps, exact for whole below 9 * 10^15."""
    p, rest = np.zeros(len(n), np.int64), n.astype(np.int64) + 1
    for _ in range(3):
        rest = rest * 1000
        p = p * 1000 + rest // whole
        rest = rest % whole
    return p + 1


def column_of(size: int, starts: np.ndarray, lengths: np.ndarray, p: np.ndarray, p_zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of the column begins, runs of zeros included, and its p."""
    ends = starts + lengths
    after = np.append(starts[1:], size) > ends
    before = len(starts) == 0 or starts[0] > 0
    begin = np.concatenate([[0] if before else [], np.stack([starts, ends], 1)[np.stack([np.ones(len(starts), bool), after], 1)]]).astype(np.int64)
    value = np.concatenate([[p_zero] if before else [], np.stack([p, np.full(len(p), p_zero)], 1)[np.stack([np.ones(len(starts), bool), after], 1)]]).astype(np.int64)
    return begin, value


def pair_sums(rows: pa.Table) -> pa.Table:
    """(lang, source, item, value) of all pairs of the groups of one block."""
    size = rows["size"][0].as_py()
    names = rows["source"].to_pylist()
    columns = []
    if size:
        for i in range(len(rows)):
            whole = rows["total"][i].as_py() + rows["terms"][i].as_py()
            starts, lengths, counts = (np.array(rows[c][i].as_py() or [], np.int64) for c in ("starts", "lengths", "counts"))
            columns.append(column_of(size, starts, lengths, exact_frequency(counts, whole), int(exact_frequency(np.zeros(1, np.int64), whole)[0])))
    a_of, b_of, value = [], [], []
    for a in range(len(names)):
        for b in range(a):
            forth = back = 0
            if size:
                (begin_a, p_a), (begin_b, p_b) = columns[a], columns[b]
                begin = np.union1d(begin_a, begin_b)
                lengths = np.diff(np.append(begin, size))
                p, q = p_a[np.searchsorted(begin_a, begin, "right") - 1], p_b[np.searchsorted(begin_b, begin, "right") - 1]
                square = (p - q) ** 2
                forth, back = int((square // q * lengths).sum()), int((square // p * lengths).sum())
            a_of += [names[a], names[b]]
            b_of += [names[b], names[a]]
            value += [forth, back]
    return pa.table([pa.array([rows["lang"][0].as_py()] * len(value), pa.string()), pa.array(a_of, pa.string()), pa.array(b_of, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, entries: int = BLOCK_ENTRIES, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank, as the module says."""
    scratch = Scratch(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    per_term = (
        term_counts(read, cut_bytes)
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    )
    vectors = scratch.put("divergence-vectors", per_term.where(F.col("docs") >= least_docs).drop("docs"))
    kept = vectors.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    terms = vectors.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = scratch.put(
        "divergence-groups",
        read.select("lang", "source")
        .distinct()
        .join(kept, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(name) for name, c in {"total": F.col("n"), "terms": F.col("terms"), "lang_total": F.col("lang_total")}.items()]),
    )
    sent = sent_if_small(groups)

    counts = vectors.select("lang", "term", F.col("n").alias("lang_n"), F.explode("counts").alias("c")).select("lang", "term", "lang_n", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    p, q = (frequency(F.col(n), F.col(total), F.col("terms")) for n, total in (("n", "total"), ("lang_n", "lang_total")))
    above = counts.join(sent, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = above.select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)

    runs = scratch.put("divergence-runs", run_length_columns(vectors, entries))
    empty = groups.where("terms = 0").select("lang", F.lit("").alias("block"), F.lit(0).cast("bigint").alias("size")).distinct()
    blocks = runs.select("lang", "block", "size").distinct().union(empty)
    columns = blocks.join(sent, "lang").join(runs.drop("size"), ["lang", "block", "source"], "left")
    sums = columns.groupBy("lang", "block").applyInArrow(pair_sums, "lang string, source string, item string, value bigint")
    by_pair = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))

    shown = [by_pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"), by_term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")]
    return shown[0].union(shown[1])
