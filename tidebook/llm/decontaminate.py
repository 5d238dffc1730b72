"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item, or a whole shorter item. In a window of n
words the k-grams, k = (n + 1) // 2, leave n - k + 1 places; the least k-gram hash is the window's
fingerprint. Two equal windows have equal fingerprints, so a shared span of n words or more is always
found, while neighbouring windows share fingerprints and about one hash in n / 4 words remains.

Training texts are fingerprinted in one Arrow pass. A bitmap of the benchmark's fingerprints (at most
16 MB, whatever the benchmark holds) leaves windows whose fingerprint may occur there; these are extended
to the words of their window and joined to the benchmark's windows on fingerprint and words, so the join
is exact and no text is shuffled. The two sides meet at one row per distinct window: a passage shared by
many items and many documents makes no pairs. Lists of items are made once per distinct set of windows.

NULL and empty texts have no words. Repeated rows each get their row. An item without words has no
window; an item with a NULL id makes words hit but is not listed. Only ``doc_id``, ``text``, ``item_id``
and ``text`` of the inputs are read, so extra columns do not matter. Texts of any length are read whole. An empty
table of documents gives no rows, an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import ALNUM_GAP, Scratch, WordSpans, byte_class, byte_values, lists, lower_az, pieces, text_buffers, text_key, without

WINDOW = 13
MIN_BITS, MAX_BITS = 16, 27
FOUND = "array<struct<start:bigint,n:int,fingerprint:bigint,words:string>>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def fingerprints(words: WordSpans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every window of ``n`` words that lies in one text."""
    k = (n + 1) // 2
    if len(words.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(len(words.hash) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9FB21C651E98DF25) + words.hash[j : j + len(grams)]
    least = sliding_min(np.bitwise_xor(grams, grams >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F), n - k + 1)
    whole = np.flatnonzero(words.text[: len(least)] == words.text[n - 1 :])
    return whole, least[whole].view(np.int64)


def windows_of(table: pa.RecordBatch, lengths: list[int], bitmap: np.ndarray | None) -> pa.RecordBatch:
    """One row per text: key, word count, and its windows whose fingerprint is in ``bitmap`` (or all)."""
    flags = byte_class("alnum")
    values = byte_values(flags)
    data, offsets = text_buffers(table.column(1))
    counts, number = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
    parts: list[list] = [[], [], [], []]
    for low, high in pieces(offsets):
        words = WordSpans(data, offsets[low : high + 1], flags, values)
        counts[low:high] = words.counts
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in lengths:
            at, prints = fingerprints(words, n)
            if bitmap is not None and len(at):
                bucket = prints.view(np.uint64) >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
                hit = (bitmap[bucket >> np.uint64(6)] >> (bucket & np.uint64(63))) & np.uint64(1) > 0
                at, prints = at[hit], prints[hit]
            found.append((at, prints, np.full(len(at), n)))
        at, prints, ns = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(words.text[at], kind="stable") if len(at) else np.zeros(0, np.int64)
        at, prints, ns = at[order], prints[order], ns[order]
        owner = words.text[at] if len(at) else np.zeros(0, np.int64)
        number[low:high] = np.bincount(owner, minlength=high - low)
        text = words.data.tobytes()
        start, end = words.start, words.end
        spelled = [b" ".join([text[start[i] : end[i]] for i in range(a, a + n)]).lower() for a, n in zip(at.tolist(), ns.tolist())]
        parts[0].append(at - words.first[owner])
        parts[1].append(ns)
        parts[2].append(prints)
        parts[3].extend(spelled)
    whole = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts[:3]]
    struct = pa.StructArray.from_arrays(
        [pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int32()), pa.array(whole[2], pa.int64()), pa.array(parts[3], pa.binary()).cast(pa.string())],
        ["start", "n", "fingerprint", "words"],
    )
    found = lists(np.concatenate([[0], np.cumsum(number)]), struct)
    keys = [table.column(i) for i in range(table.num_columns) if i != 1]
    return pa.RecordBatch.from_arrays([*keys, pa.array(counts), found], [*[table.schema.names[i] for i in range(table.num_columns) if i != 1], "n_words", "found"])


def with_windows(df: DataFrame, key_types: str, lengths: list[int], bitmap: np.ndarray | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield windows_of(batch, lengths, bitmap)

    return df.mapInArrow(run, f"{key_types}, n_words bigint, found {FOUND}")


def fingerprint_bitmap(fingerprint_rows: DataFrame, count: int) -> np.ndarray:
    """Bits set for the leading bits of each fingerprint; 2^16 to 2^27 bits, so at most 2^21 rows are collected."""
    bits = min(MAX_BITS, max(MIN_BITS, int(max(1, 16 * count) - 1).bit_length()))
    bucket = F.shiftrightunsigned("fingerprint", 64 - bits)
    words = (
        fingerprint_rows.select(bucket.alias("bucket"))
        .groupBy(F.shiftright("bucket", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bucket & 63 as int)))").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_hit: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, items, items_sha256, contaminated.

    ``n_hit`` counts words inside an occurrence of a benchmark window, ``items`` are the sorted ids (as
    strings) of items with an occurring window. Contaminated: n_hit > 0 and words_per_hit * n_hit >= n_words.
    """
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    sizes = items.select(F.size(F.filter(F.split(lower_az(F.col("text")), ALNUM_GAP), lambda w: w != "")).alias("n"))
    lengths = sorted(r.n for r in sizes.select(F.least("n", F.lit(window)).alias("n")).distinct().collect() if r.n > 0)
    item_type = items.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    # An item's windows have the full length, or the item's own where it is shorter.
    bench = scratch.put(
        "bench-windows",
        with_windows(items, f"item_id {item_type}", lengths, None)
        .select("item_id", F.least("n_words", F.lit(window)).alias("length"), F.explode("found").alias("f"))
        .where("f.n = length")
        .select("item_id", "f.fingerprint", "f.words")
        .distinct(),
    )
    distinct = scratch.put("bench-distinct", bench.select("fingerprint", "words").distinct().withColumn("window", F.monotonically_increasing_id()))
    bitmap = fingerprint_bitmap(distinct, distinct.count())

    read = docs.select("doc_id", F.col("text"), text_key(F.col("text")).alias("text_key"))
    texts = scratch.put(
        "doc-windows", with_windows(read, f"doc_id {doc_type}, text_key bigint", lengths, bitmap).withColumn("row", F.monotonically_increasing_id())
    )
    hits = (
        texts.select("row", F.explode("found").alias("f"))
        .select("row", "f.start", "f.n", "f.fingerprint", "f.words")
        .join(distinct, ["fingerprint", "words"])
        .select("row", "start", (F.col("start") + F.col("n")).alias("end"), "window")
    )
    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    rows = scratch.put(
        "hit-rows",
        hits.withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy("row")
        .agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set("window")).alias("windows"))
        .withColumn("class", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256)),
    )
    classes = (
        rows.groupBy("class")
        .agg(F.any_value("windows").alias("windows"))
        .select("class", F.explode("windows").alias("window"))
        .join(distinct.select("window", "fingerprint", "words"), "window")
        .join(bench, ["fingerprint", "words"])
        .groupBy("class")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    per_row = rows.select("row", "n_hit", "class").join(classes, "class", "left").drop("class")
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        texts.select("row", "doc_id", "text_key", "n_words")
        .join(per_row, "row", "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            n_hit.cast("bigint").alias("n_hit"),
            F.size(listed).cast("bigint").alias("n_items"),
            listed.alias("items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (F.lit(words_per_hit) * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_hit: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; decided by id and text, NULLs included. Very long
    texts are read whole, an empty table stays empty, columns may have any name."""
    return without(docs, contamination(docs, benchmark, window, words_per_hit).where("contaminated"))
