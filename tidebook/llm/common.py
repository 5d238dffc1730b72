"""Helpers shared by the corpus operators: scratch tables, words of a text, word hashes in numpy.

Texts are cut into words at byte level. UTF-8 bytes of 0x80 and above only occur inside characters
beyond ASCII, so a word class that is closed over those characters is a set of bytes.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidebook.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Word patterns: letters, digits and everything beyond ASCII; or whatever is not white space.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Bytes of text that numpy works on at a time; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 20


class Scratch:
    """Tables written once to the folder all executors share, and removed when no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, label: str, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def put_to_send(self, label: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``put``, marked for broadcast if it has at most ``rows`` (``MOST_SENT_ROWS``) narrow rows, which are counted as
        they are written: no job of its own counts them."""
        counted = Observation()
        stored = self.put(label, df.observe(counted, F.count(F.lit(1)).alias("rows")))
        return F.broadcast(stored) if counted.get.get("rows", 0) <= (MOST_SENT_ROWS if rows is None else rows) else stored

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Keys sent to all tasks instead of shuffling texts: at most this many rows of a few numbers, some tens of MB.
MOST_SENT_ROWS = 1_000_000


def sent_if_small(stored: DataFrame, rows: int = MOST_SENT_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most ``rows``; else as it is (a shuffle join)."""
    return F.broadcast(stored) if stored.limit(rows + 1).count() <= rows else stored


def lower_az(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; NULL becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """A hash that tells texts of one id apart; NULL and empty differ."""
    return F.xxhash64(text, text.isNull())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose (doc_id, text_key) is not in ``gone``. A row travels as one struct, so
    its columns may have any name."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_key(F.col("text")).alias("own_key"))
    named = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    left = rows.join(named, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def worker_cache() -> dict:
    """Objects that stay in a Python worker between tasks. Functions travel by value, so modules don't."""
    return sys.__dict__.setdefault("_tidebook_worker_cache", {})


def release_worker_cache() -> None:
    """Let go of what other operators keep in this Python worker: Spark hands idle workers on to the next job."""
    worker_cache().clear()


def byte_class(word: str) -> np.ndarray:
    """256 flags: does the byte belong to a word; ``word`` is "alnum" (after lower-casing) or "spaced"."""
    flags = np.ones(256, dtype=bool)
    if word == "alnum":
        flags[:128] = False
        for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
            flags[ord(low) : ord(high) + 1] = True
    else:
        flags[[ord(c) for c in SPACES]] = False
    return flags


def byte_values(flags: np.ndarray) -> np.ndarray:
    """A fixed 64-bit value for each byte, 0 between words, the same for A-Z and a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[~flags] = 0
    return values


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the published splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL is the empty text."""
    return binary_buffers(column.cast(pa.large_string()))


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; NULL is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


class WordSpans:
    """Words of a run of texts: first and past-the-end byte, text index, and a 64-bit hash of each. A word that goes on
    over one of ``cuts`` (places inside the run) becomes two."""

    POWER = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, values: np.ndarray, cuts: np.ndarray | None = None):
        self.data = data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets = offsets - offsets[0]
        inside = flags[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        if cuts is not None:
            before[cuts] = False
            after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        if len(self.start):
            bounds = np.append(self.start, len(data))
            place = np.arange(self.start[0], len(data)) - np.repeat(self.start, np.diff(bounds))
            powers = np.cumprod(np.full(int(place.max()) + 1, self.POWER))
            sums = np.add.reduceat(values[data[self.start[0] :]] * powers[place], self.start - self.start[0])
            self.hash = mixed(sums ^ (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
