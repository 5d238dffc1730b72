"""Near-duplicate documents by MinHash bands and odd sketches.

A text's set holds its distinct word shingles (all words as one shingle if there are fewer words). One
Arrow pass takes ``BANDS * ROWS`` MinHash samples of each set and folds them into an odd sketch: a bitmap
in which every sample flips one bit. Two sketches' XOR has few bits exactly when few samples differ, so
its population count tells high similarities apart; texts of equal sets are merged first.

Bands of equal samples bring candidates together. Only components are asked for, so links that join what
is already joined need no test, and a bucket never makes all its pairs:

1. Each text takes, of a few common leaders of its buckets (least by as many random orders), the two whose
   sketches are nearest, and the links are confirmed on the full sets. Copies of one text join here.
2. Buckets that then still hold several components are finished exactly: every text outside the bucket's main
   component is compared by sketch with the texts of other components in the bucket, once per pair (in the
   first band they share), and what the sketch cannot rule out is confirmed on the full sets.

Bands miss a pair at the threshold with probability (1 - 0.8^5)^44 = 3e-8, the sketch bound at 6 standard
deviations about as rarely; both fall steeply above the threshold. Texts are shuffled for confirmation only.

Texts without words are linked with nothing. Repeated rows are copies like others. A NULL id is never a
component's name unless all ids of the component are NULL; such rows are kept. Very long texts are compared by all their
shingles; an empty table gives no rows; only ``doc_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, WordSpans, byte_class, byte_values, lists, mixed, pieces, sent_if_small, text_buffers, text_key, without
from tidebook.llm.components import components

BANDS, ROWS = 44, 5
SKETCH_BITS = 1024
LEADERS = 4
#: Nearest leaders that each text is tested against; more change the work, not the result.
NEAREST = 2
#: Texts of a block when a bucket is finished exactly.
BLOCK = 400
SAMPLES = BANDS * ROWS


def constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def most_different_bits(similarity: float) -> int:
    """XOR bits that a pair at ``similarity`` exceeds with negligible probability: 6 standard deviations more
    differing samples than expected, then 4 more bits' deviations (at most sqrt(bits) / 2 each)."""
    differing = SAMPLES * (1 - similarity) + 6 * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing))
    return int(bits + 4 * (bits * (1 - bits / SKETCH_BITS)) ** 0.5)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one shingle, one without words none."""
    flags = byte_class("spaced")
    values = byte_values(flags)
    data, offsets = text_buffers(column)
    sets: list[np.ndarray] = []
    for low, high in pieces(offsets):
        words = WordSpans(data, offsets[low : high + 1], flags, values)
        n = len(words.hash) - width + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for j in range(width if n > 0 else 0):
            grams = mixed(grams * np.uint64(0x9FB21C651E98DF25) + words.hash[j : j + n] + np.uint64(j))
        for i in range(high - low):
            first, count = words.first[i], words.counts[i]
            if count >= width:
                sets.append(np.unique(grams[first : first + count - width + 1]))
            elif count:
                short = np.uint64(count)
                for h in words.hash[first : first + count]:
                    short = mixed(np.array([short]) * np.uint64(0xC2B2AE3D27D4EB4F) + h)[0]
                sets.append(np.array([short], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def min_hashes(hashes: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(short), 512):
        part = short[low : low + 512, None] * factor[None, :] + shift[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signatures(column: pa.Array, width: int) -> list[pa.Array]:
    """n_shingles, two sums over the set, band keys and odd sketch of each text."""
    sets = shingle_sets(column, width)
    factor = (constants(SAMPLES, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = (constants(SAMPLES, 2) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    others = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64)
    least = np.array([min_hashes(s, factor, shift) for s in sets], np.uint64).reshape(len(sets), SAMPLES)
    samples = least + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))[None, :]
    keys = np.repeat(constants(BANDS, 3)[None, :], len(sets), axis=0)
    banded = samples.reshape(len(sets), BANDS, ROWS)
    for j in range(ROWS):
        keys = mixed(keys * np.uint64(0x9FB21C651E98DF25) + banded[:, :, j])
    bit = mixed(samples + np.uint64(4)) >> np.uint64(54)
    flat = (np.arange(len(sets), dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    flips = np.bincount(flat, minlength=len(sets) * SKETCH_BITS) & 1
    sketch = np.packbits(flips.astype(np.uint8)).view(np.int64)
    full = sizes > 0
    counts = lambda n: np.concatenate([[0], np.cumsum(np.where(full, n, 0))])
    return [
        pa.array(sizes),
        pa.array(sums.view(np.int64)),
        pa.array(others.view(np.int64)),
        lists(counts(BANDS), pa.array(keys[full].ravel().view(np.int64))),
        lists(counts(SKETCH_BITS // 64), pa.array(sketch.reshape(len(sets), -1)[full].ravel())),
    ]


def signed(docs: DataFrame, width: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "n_shingles", "sum1", "sum2", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *signatures(part.column(2), width)], names)

    schema = f"doc_id {id_type}, text_key bigint, n_shingles bigint, sum1 bigint, sum2 bigint, bands array<bigint>, sketch array<bigint>"
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, schema)


def different_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def node_texts(asked: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, text) of the distinct nodes ``asked``, stored; texts of other documents are not shuffled if few are asked for."""
    places = classes.select("node", F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_text"))
    needed = scratch.put(f"{label}-needed", places.join(asked, "node"))
    same_text = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_text"))
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    wanted = keyed.join(sent_if_small(needed.select("at_id", "at_text")), same_text, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return scratch.put(f"{label}-texts", wanted.join(needed, same_text).select("node", "text"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * common >= percent * joint shingles, on the full sets."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = node_texts(asked, classes, docs, scratch, label)
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                firsts = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else last)]
                opened = dict(zip(firsts, shingle_sets(part.column(2).take(pa.array(firsts, pa.int64())), width)))
                keep = np.zeros(len(a), bool)
                for i, other in enumerate(shingle_sets(part.column(3), width)):
                    last_set = opened.get(i, last_set)
                    joined = np.sort(np.concatenate([last_set, other]))
                    common = int((joined[1:] == joined[:-1]).sum())
                    keep[i] = 100 * common >= percent * (len(joined) - common) and len(joined) > 0
                last = a[-1]
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    links = scratch.put(label, with_both.mapInArrow(run, "a bigint, b bigint"))
    scratch.drop(f"{label}-texts", f"{label}-needed")
    return links


def leader_orders() -> list[Column]:
    """The least node by its number and by some random orders, the same ones in every bucket."""
    return [F.min("node")] + [F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(1, LEADERS)]


def leader_pairs(nodes: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """(a, b): for each node b the leaders a of its buckets whose sketches are nearest, within the bound."""
    by_key = members.groupBy("key").agg(F.array(*leader_orders()).alias("leaders"))
    leaders = members.join(by_key, "key").select("node", F.explode(F.array_distinct("leaders")).alias("leader")).where("node <> leader").distinct()
    sketches = nodes.select("node", "sketch")
    both = leaders.join(sketches, "node").join(sketches.select(F.col("node").alias("leader"), F.col("sketch").alias("other")), "leader")
    near = both.select("node", "leader", different_bits(F.col("sketch"), F.col("other")).alias("bits")).where(F.col("bits") <= limit)
    # A node has a few leaders for each of its bands at most.
    nearest = near.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("bits", "leader"))), 1, NEAREST).alias("best"))
    pairs = nearest.select(F.explode("best.leader").alias("a"), F.col("node").alias("b"))
    # Two leaders may have chosen each other.
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their root and the bucket's ``main`` (largest) one."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = per_root.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("components"))
    return rooted.join(several.where("components > 1").select("key", "main"), "key")


def block_links(table: pa.Table, width: int, percent: int, limit: int) -> pa.Table:
    """Links between the two blocks of one group: each text outside the main component against the texts of other
    components, in the first band they share, by sketch and then on the full sets."""
    column = lambda name: table.column(name).combine_chunks()
    outside = column("outside").to_numpy(zero_copy_only=False)
    node, root, main = (column(c).to_numpy() for c in ("node", "root", "main"))
    band = column("band")[0].as_py()
    bands, sketch = (column(c).flatten().to_numpy().reshape(table.num_rows, -1) for c in ("bands", "sketch"))
    rest, left = np.flatnonzero(outside), np.flatnonzero(~outside)
    tried: list[tuple[int, np.ndarray]] = []
    for i in rest:
        some = left[(root[left] != root[i]) & ((root[left] == main[i]) | (node[left] < node[i]))]
        some = some[np.bitwise_count((sketch[some] ^ sketch[i]).view(np.uint64)).sum(axis=1) <= limit]
        some = some[(bands[some, :band] != bands[i, :band]).all(axis=1)]
        if len(some):
            tried.append((i, some))
    needed = np.unique(np.concatenate([[i] for i, _ in tried] + [some for _, some in tried])) if tried else np.zeros(0, np.int64)
    sets = dict(zip(needed.tolist(), shingle_sets(column("text").take(pa.array(needed, pa.int64())), width)))
    found: list[tuple[int, int]] = []
    for i, some in tried:
        own = sets[i]
        flat = np.concatenate([sets[j] for j in some.tolist()])
        sizes = np.array([len(sets[j]) for j in some.tolist()])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        linked = some[100 * common >= percent * (len(own) + sizes - common)]
        found += [(int(node[j]), int(node[i])) for j in linked.tolist()]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def rest_links(nodes: DataFrame, opened: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, limit: int, scratch: Scratch) -> DataFrame:
    """All links between different components of a bucket, in groups of at most about two BLOCKs of texts."""
    texts = node_texts(opened.select("node").distinct(), classes, docs, scratch, "near-rest")
    outside = F.col("root") != F.col("main")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = opened.groupBy("key").agg(blocks(F.count("*")).alias("lefts"), blocks(F.sum(outside.cast("int"))).alias("rights"))
    rows = opened.join(sizes, "key").join(nodes.select("node", "bands", "sketch"), "node").join(texts, "node")
    spot = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "band", "node", "root", "main", "bands", "sketch", "text"]
    left = rows.select(*columns, F.lit(False).alias("outside"), F.pmod(spot, F.col("lefts")).cast("int").alias("left"), every("rights").alias("right"))
    right = rows.where(outside).select(*columns, F.lit(True).alias("outside"), every("lefts").alias("left"), F.pmod(spot, F.col("rights")).cast("int").alias("right"))

    def compare(table: pa.Table) -> pa.Table:
        return block_links(table, width, percent, limit)

    return scratch.put("near-more", left.unionByName(right).groupBy("key", "left", "right").applyInArrow(compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id (the least id of its component), kept."""
    scratch = Scratch(docs.sparkSession)
    limit = most_different_bits(percent / 100)
    sets = scratch.put("near-sets", signed(docs.select("doc_id", "text"), width).withColumn("node", F.monotonically_increasing_id()))
    same = ["n_shingles", "sum1", "sum2"]
    # Texts of one set are one node, named after one of its rows.
    classes = scratch.put(
        "near-classes",
        sets.where("n_shingles > 0")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key", "node")).alias("at"))
        .select(*same, "least_id", "at.doc_id", "at.text_key", "at.node"),
    )
    signed_nodes = sets.select("node", "bands", "sketch").join(sent_if_small(classes.select("node")), "node", "left_semi")
    banded = signed_nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = scratch.put("near-shared", banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"))
    members = scratch.put("near-members", banded.join(sent_if_small(shared), "key", "left_semi").select("band", "key", "node"))
    bucket_nodes = scratch.put("near-bucket-nodes", members.select("node").distinct())
    nodes = scratch.put("near-candidates", sets.select("node", "bands", "sketch").join(sent_if_small(bucket_nodes), "node", "left_semi"))

    tested = scratch.put("near-first", leader_pairs(nodes, members, limit))
    links = confirmed(tested, classes, docs, width, percent, scratch, "near-links")
    roots = components(links, scratch, "near-roots")
    opened = scratch.put("near-opened", open_members(members, roots))
    more = rest_links(nodes, opened, classes, docs, width, percent, limit, scratch)
    roots = components(links.union(more), scratch, "near-components")

    rooted = classes.join(roots, "node", "left").select(*same, "least_id", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select(*same, "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        sets.select("doc_id", "text_key", *same)
        .join(named, same, "left")
        .select("doc_id", "text_key", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; decided by id and text. NULL and empty texts stay, an empty
    table stays empty, columns may have any name."""
    return without(docs, near_duplicates(docs, width, percent).where(~F.col("kept")))
