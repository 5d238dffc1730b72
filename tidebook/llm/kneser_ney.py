"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity thresholds.

The model counts word 3-grams. A word is a run without white space, A-Z as a-z, held as a 64-bit hash. Lower orders hold
continuation counts:

    p(w | h) = max(c(hw) - D(c), 0) / c(h) + gamma(h) * p(w | shorter h),  D from the counts of counts 1 to 4.

A text's log-probability is a sum over its words, 2-grams and 3-grams of values that differ from 0 only for those of the
model, so that each is looked up by itself and none has to know whether a longer one was found:

    log p(w | uv) = over(uvw) + [log gamma(uv)] + over(vw) + [log gamma(v)] + log p(w),
    over(hw) = log(p(w | h) / (gamma(h) * p(w | shorter h))), so over(uvw) = log(1 + (c - D) / (freed(uv) * p(w | v))).

The 2-grams of trusted text, with their continuation counts and what p(w | v) needs of their words, are one stored table.
Everything longer is counted, joined and added up in ``passes`` rounds, each over the n-grams whose middle (2-grams: last)
word falls to it by a hash; every text is read in every round. In a round, counts meet by context, then meet p(w | v) by
suffix, which gives the values of the round; then these meet the n-grams of the texts by n-gram, and sums go back to the
texts: four shuffles by bucket, whose rows are arrays of n-grams, sorted, bytes of one place together. Shuffle files go with
the query that wrote them, so disk holds half a round and the table of 2-grams. One bucket stands for ``bucket_bytes`` of
text, so that buckets stay small; there are at most as many rounds as buckets.
Only words that make up more than one ``shard_entries``th of the trusted words, so fewer than ``shard_entries``, are sent to
the tasks and summed there; nothing else of the model passes the driver.

Trusted are texts whose labels all say quality 1 and not toxic. A fifth of them (by a hash of the id) is not
counted and sets the thresholds: per language, the ``quantile`` of their perplexities; languages without
trusted text take the quantile over all. NULL languages form a language. A text without words has NULL perplexity
and is not kept; one that ties with the threshold is kept. Texts of any length are read whole; an empty table gives
no rows. Without trusted text nothing is judged: perplexity NULL, every text kept.
Repeated rows each get their row; only ``doc_id``, ``text`` and ``lang`` of documents are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import SPACES, UPPER, Scratch, WordSpans, mixed, pieces, sent_if_small, text_buffers, text_key

BEGIN, END, OTHER = 1, 2, 0xFFFF
SHARD = 1 << 17
QUANTILE = 0.99
#: Rounds over the n-grams, and over the 2-grams of trusted text: what is on disk at once goes down with them, time up.
PASSES, COUNT_PASSES = 10, 2
#: Bytes of text for one bucket; n-grams and texts that a task deals out together; longest word hashed by eights of bytes.
BUCKET_BYTES = 1 << 24
BLOCK_GRAMS, BLOCK_TEXTS = 1 << 20, 1 << 16
LONG_WORD = 64

ROWS = "bucket int, kind int, block bigint, a binary, b binary, c binary"
VALUES, WANTED, TEXTS, COUNTED, OVER, SUFFIXES = range(6)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a run of texts, and how many each text has."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    lower, inside = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    lower[[ord(c) for c in UPPER]] += 32
    inside[[ord(c) for c in SPACES]] = False
    within = inside[data]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    full = offsets[1:] > offsets[:-1]
    opens, closes = offsets[:-1][full], offsets[1:][full] - 1
    first[opens] = within[opens]
    last[closes] = within[closes]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = lower[data]
    eights = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    codes = mixed((eights[start] & masks[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for done in range(8, LONG_WORD, 8):
        left = np.flatnonzero(size > done)
        codes[left] = mixed(codes[left] * WordSpans.POWER + (eights[start[left] + done] & masks[np.minimum(size[left] - done, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        codes[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    codes[codes <= END] = OTHER
    return codes, np.diff(np.searchsorted(start, offsets))


def framed(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that are not empty, each opened by two begin marks and closed by an end mark: index of the text of each
    unit, the units, and which place of its text (0 and up) each has, at most 2."""
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full] + 3)
    starts = ends - sizes[full] - 3
    units = np.full(int(ends[-1]) if len(ends) else 0, BEGIN, np.uint64)
    place = np.full(len(units), 2, np.int8)
    place[starts], place[starts + 1] = 0, 1
    inner = place == 2
    inner[ends - 1] = False
    units[inner] = codes
    units[ends - 1] = END
    return np.repeat(full, sizes[full] + 3), units, place


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left) * WordSpans.POWER + right)


def triples(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """A 3-gram's hash from those of its two 2-grams."""
    return mixed(context * WordSpans.POWER + suffix)


def falls_to(words: np.ndarray, passes: int) -> np.ndarray:
    return (words >> np.uint64(40)) % np.uint64(passes)


def packed(values: np.ndarray) -> bytes:
    """Eight-byte numbers, the bytes of one place together: sorted or alike ones take little space in a shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(rows: list[bytes | None], kind: type = np.uint64) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(8, -1).T).view(kind).ravel() for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def dealt(kind: int, buckets: int, keys: np.ndarray, *more: np.ndarray, block: int = 0, ordered: bool = False) -> list[tuple]:
    """Rows of arrays, one for each bucket that ``keys`` fall to; numbers of two bytes are not packed."""
    if not ordered:
        by = np.argsort(keys)
        keys, more = keys[by], [m[by] for m in more]
    lows = np.array([-(-(i << 32) // buckets) << 32 for i in range(buckets)], np.uint64)
    at = np.append(np.searchsorted(keys, lows), len(keys))
    put = lambda m: m.tobytes() if m.dtype.itemsize < 8 else packed(m)
    return [(i, kind, block, *([put(m[at[i] : at[i + 1]]) for m in (keys, *more)] + [None] * 2)[:3]) for i in np.flatnonzero(at[1:] > at[:-1]).tolist()]


def arrow_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["bucket", "kind", "block", "a", "b", "c"])


def group_rows(table: pa.Table) -> dict[int, list[tuple]]:
    found: dict[int, list[tuple]] = {}
    for kind, *row in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "block", "a", "b", "c"))):
        found.setdefault(kind, []).append((row[0], kind, *row[1:]))
    return found


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal ``keys``, which are sorted, begin; and how long they are."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(keys)))


def trusted_grams(batches: Iterator[pa.RecordBatch], of) -> Iterator[list[np.ndarray]]:
    """What ``of`` makes of the units, 2-grams and 3-gram places of the texts, in parts of some size."""
    parts, held = [], 0
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for low, high in pieces(offsets, 1 << 19):
            _, units, place = framed(*word_codes(data, offsets[low : high + 1]))
            parts.append(of(units, np.flatnonzero(place == 2)))
            held += len(parts[-1][0])
            if held > BLOCK_GRAMS:
                yield [np.concatenate(c) for c in zip(*parts)]
                parts, held = [], 0
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def suffix_counts(texts: DataFrame, buckets: int, part: int, parts: int) -> DataFrame:
    """(v, w, n, seen, c1 to c4) of the 2-grams that fall to ``part``: how many 3-grams end in them, how often they occur
    there, and how many of those 3-grams occur once, ... four times."""

    def of(units, at):
        suffix = pairs(units[at - 1], units[at])
        mine = suffix % np.uint64(parts) == part
        return [suffix[mine], *[units[at[mine] - i] for i in (2, 1, 0)]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for suffix, u, v, w in trusted_grams(batches, of):
            by = np.argsort(suffix)
            at = np.searchsorted(suffix[by], np.array([-(-(i << 32) // buckets) << 32 for i in range(buckets)], np.uint64))
            at = np.append(at, len(by))
            yield arrow_rows([(i, COUNTED, 0, *[packed(x[by[at[i] : at[i + 1]]]) for x in (u, v, w)]) for i in range(buckets) if at[i + 1] > at[i]])

    def count(table: pa.Table) -> pa.Table:
        u, v, w = (unpacked(table[c].to_pylist()) for c in "abc")
        by = np.lexsort((u, w, v))
        u, v, w = u[by], v[by], w[by]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        c = np.diff(np.append(at, len(u)))
        v, w = v[at], w[at]
        new = np.ones(len(v), bool)
        new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (np.ones(len(c)), c, c == 1, c == 2, c == 3, c == 4)]
        return pa.table([pa.array(x.view(np.int64)) for x in (v[at], w[at], *sums)], ["v", "w", "n", "seen", "c1", "c2", "c3", "c4"])

    return texts.mapInArrow(deal, ROWS).groupBy("bucket").applyInArrow(count, "v bigint, w bigint, n bigint, seen bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint")


def over_contexts(texts: DataFrame, buckets: int, d: list[float], part: int, parts: int) -> DataFrame:
    """For 3-grams whose middle word falls to ``part``: rows OVER (2-gram it ends in, 3-gram, (c - D) / freed(context)), and
    VALUES of log gamma of the contexts."""

    def of(units, at):
        at = at[falls_to(units[at - 1], parts) == part]
        return [pairs(units[at - 2], units[at - 1]), pairs(units[at - 1], units[at])]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for context, suffix in trusted_grams(batches, of):
            yield arrow_rows(dealt(COUNTED, buckets, context, suffix))

    def count(table: pa.Table) -> pa.Table:
        context, suffix = unpacked(table["a"].to_pylist()), unpacked(table["b"].to_pylist())
        by = np.lexsort((suffix, context))
        context, suffix = context[by], suffix[by]
        new = np.ones(len(by), bool)
        new[1:] = (context[1:] != context[:-1]) | (suffix[1:] != suffix[:-1])
        at = np.flatnonzero(new)
        c = np.diff(np.append(at, len(by)))
        context, suffix = context[at], suffix[at]
        less = np.array([0.0, *d])[np.minimum(c, 3)]
        at, runs = grouped(context)
        total, freed = np.add.reduceat(c, at), np.add.reduceat(less, at)
        rows = dealt(OVER, buckets, suffix, triples(context, suffix), (c - less) / np.repeat(freed, runs))
        return pa.Table.from_batches([arrow_rows(rows + dealt(VALUES, buckets, context[at], np.log(freed / total), ordered=True))])

    return texts.mapInArrow(deal, ROWS).groupBy("bucket").applyInArrow(count, ROWS)


def stored_values(stored: DataFrame, kind: int, buckets: int) -> DataFrame:
    """Rows of ``kind`` from a table of (words, value): one word, or two for a 2-gram."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            *words, value = [c.to_numpy() for c in batch.columns]
            words = [w.view(np.uint64) for w in words]
            parts.append((pairs(*words) if len(words) > 1 else words[0], value))
            held += len(value)
            if held > BLOCK_GRAMS:
                yield arrow_rows(dealt(kind, buckets, *[np.concatenate(c) for c in zip(*parts)]))
                parts, held = [], 0
        if held:
            yield arrow_rows(dealt(kind, buckets, *[np.concatenate(c) for c in zip(*parts)]))

    return stored.mapInArrow(deal, ROWS)


def over_suffixes(rows: DataFrame, buckets: int) -> DataFrame:
    """VALUES of the 3-grams: rows OVER meet p(w | v) in rows SUFFIXES."""

    def meet(table: pa.Table) -> pa.Table:
        found = group_rows(table)
        out = found.get(VALUES, [])
        if over := found.get(OVER):
            suffix, gram, value = unpacked([r[3] for r in over]), unpacked([r[4] for r in over]), unpacked([r[5] for r in over], np.float64)
            keys, p = unpacked([r[3] for r in found[SUFFIXES]]), unpacked([r[4] for r in found[SUFFIXES]], np.float64)
            by = np.argsort(keys)
            out = out + dealt(VALUES, buckets, gram, np.log1p(value / p[by][np.searchsorted(keys[by], suffix)]))
        return pa.Table.from_batches([arrow_rows(out)])

    return rows.groupBy("bucket").applyInArrow(meet, ROWS)


def wanted(rows: DataFrame, sent, unknown: float, buckets: int, part: int, parts: int) -> DataFrame:
    """Rows WANTED (n-grams of the texts that fall to ``part``, and the texts they are in) and TEXTS (row, log-probability
    so far, n-grams): words that are ``sent`` (words and values) are summed here, in the first round."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = sent.value
        base = TaskContext.get().partitionId() << 32

        def block(texts: list, keys: list, of: list) -> pa.RecordBatch:
            nonlocal base
            base += 1
            out = dealt(WANTED, buckets, np.concatenate(keys), np.concatenate(of), block=base)
            return arrow_rows([*out, (base % buckets, TEXTS, base, *[packed(np.concatenate(c)) for c in zip(*texts)])])

        texts, keys, of, held, n = [], [], [], 0, 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for low, high in pieces(offsets, 1 << 19):
                while low < high:
                    top = min(high, low + BLOCK_TEXTS - n)
                    codes, sizes = word_codes(data, offsets[low : top + 1])
                    text, units, place = framed(codes, sizes)
                    gram = np.flatnonzero(place > 0)
                    last = falls_to(units, parts) == part
                    two = gram[last[gram]]
                    three = np.flatnonzero(place == 2)
                    three = three[last[three - 1]]
                    pair = np.zeros(len(units), np.uint64)
                    pair[1:] = pairs(units[:-1], units[1:])
                    at = np.minimum(np.searchsorted(words, units[two]), max(len(words) - 1, 0))
                    known = words[at] == units[two] if len(words) else np.zeros(len(two), bool)
                    so_far = np.bincount(text[two[known]], values[at[known]], top - low) if len(words) else np.zeros(top - low)
                    n_grams = np.where(sizes > 0, sizes + 1, 0) if part == 0 else np.zeros(top - low, np.int64)
                    texts.append((own[low:top], so_far + n_grams * unknown, n_grams))
                    cold = two[~known]
                    keys += [units[cold], pair[two], triples(pair[three - 1], pair[three])]
                    of += [(text[x] + n).astype(np.uint16) for x in (cold, two, three)]
                    held += len(cold) + len(two) + len(three)
                    n += top - low
                    if held > BLOCK_GRAMS or n >= BLOCK_TEXTS:
                        yield block(texts, keys, of)
                        texts, keys, of, held, n = [], [], [], 0, 0
                    low = top
        if texts:
            yield block(texts, keys, of)

    return rows.mapInArrow(deal, ROWS)


def looked_up(rows: DataFrame) -> DataFrame:
    """Rows WANTED meet VALUES (those of one n-gram add up): sums per text, for the texts with any. TEXTS stay."""

    def meet(table: pa.Table) -> pa.Table:
        found = group_rows(table)
        keys, values = unpacked([r[3] for r in found.get(VALUES, [])]), unpacked([r[4] for r in found.get(VALUES, [])], np.float64)
        by = np.argsort(keys)
        keys, values = keys[by], values[by]
        at, _ = grouped(keys)
        keys, values = keys[at], (np.add.reduceat(values, at) if len(at) else values)
        out = found.get(TEXTS, [])
        for _, kind, block, a, b, _ in found.get(WANTED, []) if len(keys) else []:
            want, of = unpacked([a]), np.frombuffer(b, np.uint16)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == want)
            sums = np.bincount(of[hit], values[at[hit]])
            some = np.flatnonzero(sums)
            out.append((0, kind, block, some.astype(np.uint16).tobytes(), packed(sums[some]), None))
        return pa.Table.from_batches([arrow_rows(out)])

    return rows.groupBy("bucket").applyInArrow(meet, ROWS)


def text_sums(rows: DataFrame) -> DataFrame:
    """(row, logp, n, times) of the texts."""

    def add(table: pa.Table) -> pa.Table:
        found = group_rows(table)
        (_, _, _, a, b, c), = found[TEXTS]
        row, logp, n = unpacked([a], np.int64), unpacked([b], np.float64), unpacked([c], np.int64)
        for _, _, _, of, sums, _ in found.get(WANTED, []):
            logp[np.frombuffer(of, np.uint16)] += unpacked([sums], np.float64)
        return pa.table([pa.array(x) for x in (row, logp, n)], ["row", "logp", "n"])

    return rows.groupBy("block").applyInArrow(add, "row bigint, logp double, n bigint")


def discounts(counts: list[int | None]) -> list[float]:
    """D1, D2, D3+ from how many n-grams were counted once to four times."""
    n1, n2, n3, n4 = (max(n or 0, 1) for n in counts)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def discounted(n: Column, d: list[float]) -> Column:
    return F.when(n >= 3, F.lit(d[2])).when(n == 2, F.lit(d[1])).when(n == 1, F.lit(d[0])).otherwise(F.lit(0.0))


def times(n: Column, i: int) -> Column:
    return F.count(F.when(n == i, 1))


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are removed when the query that wrote them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def log_probabilities(rows: DataFrame, texts: DataFrame, scratch: Scratch, shard_entries: int, passes: int, bucket_bytes: int) -> DataFrame | None:
    """(row, n, logp, times) of ``rows`` (row, text) under the model of ``texts`` (text); equal rows are summed together.
    None if nothing was counted."""
    buckets = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    passes = min(passes, buckets)
    parts = min(COUNT_PASSES, passes)
    counted = [scratch.put(f"kn-counts-{i}", suffix_counts(texts, buckets, i, parts)) for i in range(parts)]
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.union(more)
    n = F.col("n")
    c = counts.agg(*[times(n, i) for i in range(1, 5)], *[F.sum(f"c{i}") for i in range(1, 5)]).first()
    d2, d3 = discounts(list(c[:4])), discounts(list(c[4:]))
    ends = counts.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))
    opens = counts.groupBy(F.col("v").alias("word")).agg(F.sum("n").alias("total"), F.sum(discounted(n, d2)).alias("freed"))
    words = scratch.put("kn-words", ends.join(opens, "word", "full"))
    found = words.agg(*[times(n, i) for i in range(1, 5)], F.sum("n"), F.count("n"), F.sum("seen")).first()
    total, symbols, seen = found[4:]
    if not total:
        return None
    d1 = discounts(list(found[:4]))
    kept = words.agg(F.sum(discounted(n, d1))).first()[0]
    unknown = kept / total / (symbols + 1)
    p = (n - discounted(n, d1)) / total + unknown
    alone = F.when(n > 0, F.log(p / unknown)).otherwise(F.lit(0.0)) + F.coalesce(F.log(F.col("freed") / F.col("total")), F.lit(0.0))
    words = scratch.put("kn-word-values", words.select("word", p.alias("p"), "total", "freed", alone.alias("value"), (F.coalesce("seen", F.lit(0)) * shard_entries > seen).alias("hot")))
    small = sent_if_small(words)
    first = counts.select("v", "w", (n - discounted(n, d2)).alias("n")).join(small.select(F.col("word").alias("v"), "total", "freed"), "v")
    first = scratch.put("kn-first-words", first)  # one join's shuffle on disk at a time
    scratch.drop("kn-words", *[f"kn-counts-{i}" for i in range(parts)])
    suffixes = scratch.put("kn-suffixes", first.join(small.select(F.col("word").alias("w"), "p"), "w"))
    scratch.drop("kn-first-words")
    shorter = F.col("freed") / F.col("total") * F.col("p")
    longer = F.col("n") / F.col("total") + shorter
    hot = words.where("hot").select("word", "value").toArrow()
    keys, values = hot["word"].to_numpy().view(np.uint64), hot["value"].to_numpy()
    by = np.argsort(keys)
    sent = rows.sparkSession.sparkContext.broadcast((keys[by], values[by]))
    mine = lambda word, i: F.shiftrightunsigned(word, 40) % passes == i
    sums = []
    for i in range(passes):
        over = over_contexts(texts, buckets, d3, i, passes)
        p_suffix = stored_values(suffixes.where(mine("v", i)).select("v", "w", longer), SUFFIXES, buckets)
        three = scratch.put("kn-values", over_suffixes(over.union(p_suffix), buckets))
        two = stored_values(suffixes.where(mine("w", i)).select("v", "w", F.log(longer / shorter)), VALUES, buckets)
        one = stored_values(words.where(~F.col("hot") & mine("word", i)).select("word", "value"), VALUES, buckets)
        asked = wanted(rows, sent, float(np.log(unknown)), buckets, i, passes)
        sums.append(scratch.put(f"kn-sums-{i}", text_sums(looked_up(three.union(two).union(one).union(asked)))))
        scratch.drop("kn-values")
    scratch.drop("kn-word-values", "kn-suffixes")
    whole = sums[0].withColumn("times", F.lit(1))
    for more in sums[1:]:
        whole = whole.union(more.withColumn("times", F.lit(0)))
    return whole.groupBy("row").agg(F.sum("n").alias("n"), F.sum("logp").alias("logp"), F.sum("times").alias("times"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return worst.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(5)) > 0).alias("counts"))


def perplexities(docs: DataFrame, labels: DataFrame, shard_entries: int = SHARD, quantile: float = QUANTILE, passes: int = PASSES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, lang, n_grams, perplexity, threshold, kept."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    trusted = scratch.put("kn-trusted", trusted_ids(labels))
    key = text_key(F.col("text"))
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), key)
    counted = docs.join(sent_if_small(trusted.where("counts").select("doc_id")), "doc_id").select("text")
    with shuffles_go(docs.sparkSession):
        sums = log_probabilities(docs.select(row.alias("row"), "text"), counted, scratch, shard_entries, passes, bucket_bytes)
    if sums is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", key.alias("text_key"), "lang", F.lit(0).cast("bigint").alias("n_grams"), nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(True).alias("kept"))
    rows = docs.select(row.alias("row"), "doc_id", key.alias("text_key"), F.col("lang").cast("string").alias("lang")).join(sums, "row")
    perplexity = F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n")))
    scored = scratch.put("kn-scored", rows.select("doc_id", "text_key", "lang", (F.col("n") / F.col("times")).cast("bigint").alias("n_grams"), perplexity.alias("perplexity")))
    held = scored.join(trusted.where(~F.col("counts")), "doc_id")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    language = F.coalesce("lang", F.lit(""))
    by_language = scratch.put("kn-thresholds", held.groupBy(language.alias("language")).agg(cut.alias("own")))
    general = F.lit(held.agg(cut).first()[0])
    threshold = F.coalesce("own", general)
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull())
    return (
        scored.join(by_language, language == F.col("language"), "left")
        .select("doc_id", "text_key", "lang", "n_grams", "perplexity", threshold.alias("threshold"))
        .withColumn("kept", kept)
    )
