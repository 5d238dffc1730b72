"""Chat formatting by quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of ">" it opens with. Paragraphs are runs of non-blank lines of one
level; a line like "On ... wrote:" right before a deeper line is an attribution and is left out. Passages are
paragraphs and their pieces: the lines, for a quote of some lines, and the sentences, which outlast new line breaks.
Quoted passages are normalised (lower case, single spaces) and hashed, and joined to the conversation's own passages
on (conversation, hash). The earliest message that holds a passage unquoted is its original; one row per key on that
side keeps a passage quoted by everybody from making pairs. A quoted paragraph is linked to the original of the whole
if there is an earlier one, else to the latest of the earlier originals of its pieces.

A message replies to the latest message among the originals of its paragraphs of the lowest quoted level
that were found in earlier turns; without one it opens a thread. Threads follow each other by their first
turn, and messages by turn within a thread, so every message comes after what it replies to. Positions come
from a range-partitioned order and one offset per partition: no conversation meets in one task.

NULL text stays NULL. Messages with a NULL conversation or turn are not linked; they share the NULL
conversation and come first. Rows repeated with the same conversation and turn are ordered by role and text.
Passages shorter than ``least_chars`` are removed as quotes but not linked. Texts of any length are read whole, an
empty table gives no rows, and columns other than the four are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, sent_if_small

OPENING = r"^[ \t]*(?:>[ \t]*)+"
ATTRIBUTION = r"^(?:On .+ wrote|Am .+ schrieb.*|Le .+ a écrit|El .+ escribió) ?:[ \t\r]*$"
BLANK = r"\n[ \t\r\n]*\n"
LEAST_CHARS = 8


def tagged_lines(text: Column) -> Column:
    """(level, body) of each line."""

    def tag(line: Column) -> Column:
        opening = F.regexp_extract(line, OPENING, 0)
        return F.struct(F.length(F.regexp_replace(opening, "[^>]", "")).alias("level"), F.substr(line, F.length(opening) + 1).alias("body"))

    return F.transform(F.split(text, "\n"), tag)


def at_level(level: Column) -> Column:
    """The lines of one level, what lies between them blank, without attributions."""
    lines = F.col("lines")

    def shown(line: Column, i: Column) -> Column:
        deeper = F.coalesce(F.get(lines, i + 1)["level"] > line["level"], F.lit(False))
        stays = (line["level"] == level) & ~(deeper & line["body"].rlike(ATTRIBUTION))
        return F.when(stays, line["body"]).otherwise("")

    return F.array_join(F.transform(lines, shown), "\n")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def paragraphs(text: Column) -> Column:
    """(whole, pieces) of each paragraph that is not blank: normalised, and its normalised lines and sentences."""

    def passages(paragraph: Column) -> Column:
        lines = F.transform(F.split(paragraph, "\n"), normal)
        sentences = F.split(F.regexp_replace(normal(paragraph), "([.!?]) ", "$1\n"), "\n")
        return F.struct(normal(paragraph).alias("whole"), F.array_union(lines, sentences).alias("pieces"))

    return F.filter(F.transform(F.split(text, BLANK), passages), lambda p: p["whole"] != "")


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``own`` (text without quotes) and ``quotes``: (level, whole, pieces) of quoted paragraphs."""
    lines = messages.select("*", F.when(F.col("text").rlike("(?m)" + OPENING), tagged_lines(F.col("text"))).alias("lines"))
    levels = F.filter(F.array_distinct(F.transform("lines", lambda x: x["level"])), lambda x: x > 0)
    quoted = F.flatten(F.transform(levels, lambda level: F.transform(paragraphs(at_level(level)), lambda p: F.struct(level.alias("level"), p["whole"].alias("whole"), p["pieces"].alias("pieces")))))
    own = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.regexp_replace(at_level(F.lit(0)), r"(^[ \t\r\n]+)|([ \t\r\n]+$)", ""))
    none = F.array().cast("array<struct<level:int,whole:string,pieces:array<string>>>")
    return lines.select("row", "conv_id", "turn", "role", "text", own.alias("own"), F.coalesce(quoted, none).alias("quotes"))


def own_passages(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(paragraphs(text), lambda p: F.array_union(F.array(p["whole"]), p["pieces"]))))


def hashed(passage: Column) -> Column:
    return F.unhex(F.sha2(passage, 256))


def numbered(df: DataFrame, scratch: Scratch, order: list[Column]) -> DataFrame:
    """``df`` with ``index``, its place in the given order over all rows, from 0."""
    spread = scratch.put("ordered", df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id()))
    part = F.shiftright("spot", 33)
    sizes = spread.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row per partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    return spread.join(offsets, part == F.col("part")).withColumn("index", F.col("before") + F.col("spot") - F.shiftleft(part, 33)).drop("spot", "part", "before")


def thread_roots(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, root) of every message with a parent, by pointer doubling over (conv_id, turn, parent)."""
    now, step = scratch.put("roots-0", replies.select("conv_id", "turn", F.col("parent").alias("root"))), 0
    while True:
        above = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        step += 1
        after = scratch.put(f"roots-{step}", now.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        scratch.drop(f"roots-{step - 1}")
        now = after.drop("moved")
        if not moved:
            return now


def reply_ordered(conversations: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per message: conv_id, position (from 0), turn, role, text (without quotes), reply_to (turn or NULL),
    thread (first turn of its thread), n_quoted and n_linked (quoted paragraphs, and those whose original was found)."""
    scratch = Scratch(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("row", F.monotonically_increasing_id())
    messages = scratch.put("quote-messages", parsed(rows))
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    paragraph = known.select("row", "conv_id", "turn", F.posexplode("quotes").alias("paragraph", "q"))
    passages = paragraph.select("row", "conv_id", "turn", "paragraph", "q.level", "q.whole", F.explode(F.array_union(F.array("q.whole"), "q.pieces")).alias("passage"))
    stored = passages.where(F.length("passage") >= least_chars).select(
        "row", "conv_id", "turn", "paragraph", "level", (F.col("passage") == F.col("whole")).alias("is_whole"), hashed(F.col("passage")).alias("hash")
    )
    quotes = scratch.put("quote-passages", stored)
    wanted = scratch.put("quote-wanted", quotes.select("conv_id", "hash").distinct())
    own = known.select("conv_id", "turn", F.explode(own_passages(F.col("own"))).alias("passage")).where(F.length("passage") >= least_chars)
    originals = (
        own.select("conv_id", "turn", hashed(F.col("passage")).alias("hash"))
        .join(sent_if_small(wanted), ["conv_id", "hash"], "left_semi")
        .groupBy("conv_id", "hash")
        .agg(F.min("turn").alias("original"))
    )
    found = quotes.join(originals, ["conv_id", "hash"]).where("original < turn")
    # The whole paragraph's original comes before those of its pieces.
    linked = found.groupBy("row", "paragraph", "conv_id", "turn", "level").agg(F.max(F.struct("is_whole", "original"))["original"].alias("original"))
    per_row = scratch.put("quote-links", linked.groupBy("row", "conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "original"))["original"].alias("parent"), F.count("*").alias("n_linked")))
    parents = per_row.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    roots = thread_roots(parents, scratch)

    joined = messages.join(per_row.select("row", "n_linked"), "row", "left").join(parents.join(roots, ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    placed = joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.col("parent").alias("reply_to"),
        F.coalesce("root", "turn").alias("thread"),
        F.size("quotes").cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
    index = numbered(placed, scratch, [F.col(c) for c in ("conv_id", "thread", "turn", "role", "text")])
    first = scratch.put("quote-first", index.groupBy(F.col("conv_id").alias("of")).agg(F.min("index").alias("first")))
    return index.join(sent_if_small(first), F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", (F.col("index") - F.col("first")).alias("position"), "turn", "role", "text", "reply_to", "thread", "n_quoted", "n_linked"
    )
