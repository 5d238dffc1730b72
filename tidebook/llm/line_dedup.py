"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if an earlier line equals it or, from ``min_chars`` characters on, is one edit away
(one character put in, taken out or exchanged). Earlier means a smaller (doc_id, hash of the text, line
number); the earlier line counts whether or not it is dropped itself. Lines without a visible character
always stay. Rows equal in id and text count as one document and stay equal.

The neighbourhood of a line is the line itself and the line less one character. Two lines of equal length
are one exchange apart if they agree after losing the character at the same place; lines of lengths n and
n + 1 are one insertion apart if the shorter equals the longer less one. Keys are therefore (variant,
place) for the first and (variant) for the second relation, and all lines that share a key are really
within the bound: the earliest line of a key is the only partner that matters, so no group makes pairs.
A variant's key is the XOR of hashes of (character, place), so prefix and suffix XORs give all keys of a
line in time linear in its length, for lines of any length. Hash keys only propose; the edit they name is
verified on the texts.

Before variants are made, an exact filter drops lines without a possible partner. Cut a line into equal
parts: an edit touches one, so two lines within one edit agree, in the same length class, on what is left
without some part. All lines are filtered by halves, what remains by sixteenths.

NULL text has no lines (and stays NULL); an empty table gives an empty table; any column but ``doc_id``
and ``text`` is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import SPACED_WORD, Scratch, text_key

MIN_CHARS = 30
#: Parts of the second filter.
PARTS = 16


def part_key(line: Column, part: Column, longer: Column, parts: int) -> Column:
    """A hash of the line without one of its parts: as the shorter or equal line of a pair (``longer`` 0, m = n
    characters are cut) or as the longer one (1, m = n - 1)."""
    m = F.length(line) - longer
    start, end = (F.floor(m * i / parts).cast("int") for i in (part, part + 1))
    return F.xxhash64(part, m, F.left(line, start), F.lit("|"), F.right(line, m - end))


def all_parts(parts: int) -> list[tuple[int, int]]:
    return [(part, longer) for longer in (0, 1) for part in range(parts)]


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per distinct visible line: a number, its first place, and half keys (NULL for short lines)."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    keys = [part_key(F.col("line"), F.lit(part), F.lit(longer), 2) for part, longer in all_parts(2)]
    halves = F.when(F.length("line") >= min_chars, F.array(*keys))
    keyed = lines.where(F.col("line").rlike(SPACED_WORD)).select(
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit("second"), "line").alias("h2"),
        *[F.get(halves, F.lit(i)).alias(f"half{i}") for i in range(4)],
        F.struct("doc_id", "text_key", "line_no").alias("place"),
    )
    firsts = keyed.groupBy("h1", "h2", *[f"half{i}" for i in range(4)]).agg(F.min("place").alias("place"))
    return firsts.drop("h1", "h2").withColumn("line", F.monotonically_increasing_id())


def candidate_lines(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Long lines that share a half with another line, numbered in order of their first place."""
    halves = distinct.where("half0 IS NOT NULL").select("line", F.explode(F.array("half0", "half1", "half2", "half3")).alias("half"))
    shared = scratch.put_to_send("line-halves", halves.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half"))
    found = scratch.put_to_send("line-sharing", halves.join(shared, "half", "left_semi").select("line").distinct())
    chosen = distinct.select("line", "place").join(found, "line", "left_semi")
    return chosen.orderBy("place", "line").withColumn("id", F.monotonically_increasing_id())


def cut_keys(lines: DataFrame, parts: int) -> DataFrame:
    """(id, part): all part keys of each line, by one expression: code that the driver compiles doesn't grow with ``parts``."""
    places = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(longer).alias("longer")) for part, longer in all_parts(parts)])
    cut = lines.select("id", "line", F.explode(places).alias("at"))
    return cut.select("id", part_key(F.col("line"), F.col("at.part"), F.col("at.longer"), parts).alias("part"))


def line_texts(docs: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """Id and text of the candidate lines, read from the documents of their first places."""
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    wanted = candidates.select("id", F.col("place.doc_id").alias("at_id"), F.col("place.text_key").alias("at_text"), F.col("place.line_no").alias("at_line"))
    same_text = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_text"))
    places = scratch.put_to_send("line-places", wanted.select("at_id", "at_text").distinct())
    lines = texts.join(places, same_text, "left_semi").select(
        "doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.join(wanted, same_text & (F.col("line_no") == F.col("at_line"))).select("id", "line").dropDuplicates(["id"])


def neighbourhood(lines: DataFrame) -> DataFrame:
    """Keys of the line (kind "whole") and of the line less each character (kind "less", with its place)."""
    chars = lines.select("id", F.posexplode(F.split("line", "")).alias("at", "c"))
    upto = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here, moved = [], []
    for seed in ("a", "b"):
        here.append(F.xxhash64(F.lit(seed), "c", "at"))
        moved.append(F.xxhash64(F.lit(seed), "c", F.col("at") - 1))
    hashed = chars.select("id", "at", *[x.alias(f"here{i}") for i, x in enumerate(here)], *[x.alias(f"moved{i}") for i, x in enumerate(moved)])
    whole = hashed.groupBy("id").agg(F.bit_xor("here0").alias("k0"), F.bit_xor("here1").alias("k1"))
    # Prefix XORs run upwards; a suffix XOR is the total without what stands up to and including this place.
    total = Window.partitionBy("id")
    keys = []
    for i in (0, 1):
        prefix = F.coalesce(F.bit_xor(f"here{i}").over(upto), F.lit(0))
        moved_before = F.coalesce(F.bit_xor(f"moved{i}").over(upto), F.lit(0))
        suffix = F.bit_xor(f"moved{i}").over(total).bitwiseXOR(moved_before).bitwiseXOR(F.col(f"moved{i}"))
        keys.append(prefix.bitwiseXOR(suffix).alias(f"k{i}"))
    less = hashed.select("id", F.col("at").alias("place"), *keys)
    return less.select("k0", "k1", "place", "id").unionByName(whole.select("k0", "k1", F.lit(-1).alias("place"), "id"))


def proposed(variants: DataFrame) -> DataFrame:
    """(id, earlier, kind, place): each line with the earliest line of each key it shares. The character at ``place`` is
    exchanged, or is missing in the line (kind "shorter") or in the earlier one ("longer")."""
    exchanged = variants.where("place >= 0").groupBy("k0", "k1", "place").agg(F.min("id").alias("earlier"), F.count("*").alias("n")).where("n > 1")
    by_place = variants.where("place >= 0").join(exchanged.drop("n"), ["k0", "k1", "place"]).select("id", "earlier", F.lit("exchange").alias("kind"), "place")
    is_whole = F.col("place") < 0
    both = (
        variants.groupBy("k0", "k1")
        .agg(F.min(F.when(is_whole, F.col("id"))).alias("whole"), F.min(F.when(~is_whole, F.struct("id", "place"))).alias("less"))
        .where("whole IS NOT NULL AND less IS NOT NULL")
    )
    shorter = both.select(F.col("whole").alias("id"), F.col("less.id").alias("earlier"), F.lit("shorter").alias("kind"), "less.place")
    longer = variants.where("place >= 0").join(both.drop("less"), ["k0", "k1"]).select("id", F.col("whole").alias("earlier"), F.lit("longer").alias("kind"), "place")
    return by_place.union(shorter).union(longer).where("earlier < id").groupBy("id", "earlier", "kind").agg(F.min("place").alias("place"))


def one_edit() -> Column:
    """Whether ``line`` and ``earlier_line`` are the edit apart that their keys propose; linear in their length."""

    def less(line: str) -> Column:
        return F.concat(F.left(line, F.col("place")), F.substr(line, F.col("place") + 2))

    exchange = (F.col("kind") == "exchange") & (F.length("line") == F.length("earlier_line")) & (less("line") == less("earlier_line"))
    shorter = (F.col("kind") == "shorter") & (F.col("line") == less("earlier_line"))
    return exchange | shorter | ((F.col("kind") == "longer") & (less("line") == F.col("earlier_line")))


def near_repeats(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbers of distinct lines that have an earlier line one edit away."""
    candidates = scratch.put("line-candidates", candidate_lines(distinct, scratch))
    halved = scratch.put("line-halved", line_texts(docs, candidates, scratch))
    parts = cut_keys(halved, PARTS)
    close = parts.groupBy("part").agg(F.count("*").alias("lines")).where("lines > 1").select("part")
    lines = scratch.put("line-texts", halved.join(parts.join(close, "part", "left_semi").select("id").distinct(), "id", "left_semi"))
    pairs = proposed(scratch.put("line-variants", neighbourhood(lines)))
    verified = (
        pairs.join(lines, "id")
        .join(lines.select(F.col("id").alias("earlier"), F.col("line").alias("earlier_line")), "earlier")
        .where(one_edit())
        .select("id")
        .distinct()
    )
    return candidates.join(verified, "id", "left_semi").select("line", F.lit(True).alias("near"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per (doc_id, text_key) that keeps or loses first lines: ``kept`` line numbers and ``n_near`` dropped."""
    scratch = Scratch(docs.sparkSession)
    distinct = scratch.put("lines", distinct_lines(docs, min_chars))
    near = scratch.put_to_send("lines-near", near_repeats(docs, distinct, scratch))
    marked = distinct.join(near, "line", "left").select("place.*", F.coalesce("near", F.lit(False)).alias("near"))
    return marked.groupBy(F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_text")).agg(
        F.collect_list(F.when(~F.col("near"), F.col("line_no"))).alias("kept"), F.sum(F.col("near").cast("bigint")).alias("n_near")
    )


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, plus ``deduped`` (the text of the lines that stay), ``n_lines`` (visible
    lines), ``n_kept`` and ``n_near`` (first occurrences dropped because of an earlier line one edit away).
    Columns of ``docs`` with these names are replaced."""
    results = ["deduped", "n_lines", "n_kept", "n_near"]
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.struct("*").alias("row"))
    joined = rows.join(
        kept_lines(docs.select("doc_id", "text"), min_chars), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_text")), "left"
    )
    split = joined.select("row", F.split("row.text", "\n").alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"), "n_near")
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("i"), line.rlike(SPACED_WORD).alias("visible")))
    marked = split.withColumns({"blank": F.transform(F.filter(numbered, lambda x: ~x["visible"]), lambda x: x["i"]), "size": F.size("lines")})
    places = F.array_sort(F.concat("kept", "blank"))
    done = marked.select(
        "row",
        F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n").alias("deduped"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.col("size") - F.size("blank")).cast("bigint").alias("n_lines"),
        F.size("kept").cast("bigint").alias("n_kept"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in results], *results)
