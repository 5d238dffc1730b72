"""Long ordered series without a window over a whole series.

A series (one symbol, one split) may hold a large share of all rows, so nothing here partitions by
series alone. Rows carry a dense position ``ord`` from 0; they are cut into chunks of fixed length, and
the rows a chunk needs from its neighbour are sent along as a halo. Totals move between chunks on a
small table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536


def with_halo(df: DataFrame, ord_col: str, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk`` and ``own``; the last ``halo`` rows of a chunk also open the next one, not owned.

    A chunk is at least as long as the halo, whatever ``chunk_rows`` says.
    """
    chunk_rows = max(chunk_rows, halo)
    home = F.floor(F.col(ord_col) / chunk_rows).cast("bigint")
    near_end = F.col(ord_col) % chunk_rows >= chunk_rows - halo
    chunks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)) if halo else F.array(home)
    return df.withColumns({"home": home, "chunk": F.explode(chunks)}).withColumn("own", F.col("chunk") == F.col("home")).drop("home")


def in_chunk(keys: Sequence[str], ord_col: str) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy(ord_col)


def chunk_of(ord_col: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(ord_col) / chunk_rows).cast("bigint")


def attach_series(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-series ``stats`` to a chunked frame on (keys, chunk), so that a hot series stays spread.

    ``df`` is read twice; hand in a written table.
    """
    wide = df.select(*keys, "chunk").distinct().join(stats, list(keys))
    return df.join(wide, [*keys, "chunk"])


def running_totals(df: DataFrame, keys: Sequence[str], ord_col: str, columns: Sequence[str]) -> DataFrame:
    """Replace each column of a chunked frame by its running total over the rows before the current one.

    Chunk totals are accumulated on one row per chunk; inside a chunk the window adds the rows so far.
    ``df`` is read twice; hand in a written table.
    """
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "chunk").agg(*[F.sum(c).alias(f"{c}_total") for c in columns])
    opening = totals.select(
        *keys, "chunk", *[F.coalesce(F.sum(f"{c}_total").over(earlier), F.lit(0.0)).alias(f"{c}_open") for c in columns]
    )
    before = in_chunk(keys, ord_col).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(opening, [*keys, "chunk"])
    sums = {c: F.col(f"{c}_open") + F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in columns}
    return joined.withColumns(sums).drop(*[f"{c}_open" for c in columns])
