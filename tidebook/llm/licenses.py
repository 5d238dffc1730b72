"""License scans: set-similarity join of text blocks with license templates. DataFrame functions only.

Blocks are overlapping runs over the words of the whole text, sized by the template: for a wording of n words, the
runs of 2n words that start at every nth word, line breaks ignored. So each stretch of up to n + 1 words lies in one
run, wrapped or not, and words strewn over a long text don't meet in one. A run is taken as the set of its words; a
template is found in a run that holds at least ``share`` of its distinct words. Words are ordered by global run
frequency, rarest first. With d distinct words in the template and a = ceil(share * d) needed, one of its first
d - a + 1 words must occur (prefix filter), the run must hold a words of the templates' vocabulary (length filter),
and from the place of the first common word enough words must be left on both sides (positional filter). What
passes is counted exactly, so every run that meets the threshold is found.

Only vocabulary words are kept from a text, with their places: others cannot add to an overlap. A run is made at its
first vocabulary word and only if enough of them follow inside it, so the work grows with the words, however long the
text. The join's small side has a few rows per template. Frequencies reach the driver for vocabulary words only.

Besides, ``PHRASES`` are looked for as consecutive words of the whole text, line breaks included; a phrase that can
overlap itself is counted without overlaps (none of the given ones can).
NULL and empty texts hold nothing: no words, no labels, score 0. A text of any length is read whole. An empty table
gives no rows. All templates that a run meets give their labels: equal shares don't compete. Repeated rows each get
their row; only ``doc_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import ALNUM_GAP, Scratch, lower_az

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: (label, wording) of the templates that blocks are compared with.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
SHARE = 0.8


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, ALNUM_GAP), lambda w: w != "")


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def phrase_columns(spelled: Column, n_words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels. ``spelled``: words with a space before and after each."""
    count, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in phrases.items():
        words = phrase.split()
        wanted = "".join(f" {w} " for w in words)
        there = F.contains(spelled, F.lit(wanted))
        count = count + F.when(there, (F.length(spelled) - F.length(F.replace(spelled, F.lit(wanted), F.lit("")))) / len(wanted)).otherwise(0)
        before = F.substring_index(spelled, wanted, 1)
        behind = F.substring_index(spelled, wanted, -1)
        firsts.append(F.when(there, words_in(before)))
        lasts.append(F.when(there, n_words - words_in(behind) - len(words)))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": count.cast("bigint"),
        "first_word": F.array_min(F.array(*firsts)).cast("bigint"),
        "last_word": F.array_max(F.array(*lasts)).cast("bigint"),
        "base": F.array_distinct(F.array_compact(F.array(*labels))),
    }


def words_in(spelled: Column) -> Column:
    """Words of a piece of a spelled text: each has a space before and after."""
    return ((F.length(spelled) - F.length(F.replace(spelled, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def runs(hits: Column, span: int, least: int) -> Column:
    """(span, run, words) of the runs of 2 * ``span`` words, from every ``span``th word on, with at least ``least``
    vocabulary words. ``hits``: place and word of a text's vocabulary words, by place."""

    def opened(hit: Column, j: Column) -> Column:
        """The runs that ``hit`` is the first vocabulary word of."""
        latest = F.floor(hit["at"] / span)

        def holds(run: Column) -> Column:
            fresh = (j == 0) | (F.get(hits, j - 1)["at"] < run * span)
            return (run >= 0) & fresh & (F.get(hits, j + (least - 1))["at"] < (run + 2) * span)

        def block(run: Column) -> Column:
            inside = F.filter(F.slice(hits, j + 1, 2 * span), lambda other: other["at"] < (run + 2) * span)
            return F.struct(F.lit(span).alias("span"), run.alias("run"), F.array_distinct(F.transform(inside, lambda other: other["word"])).alias("words"))

        close = F.get(hits, j + (least - 1))["at"] < hit["at"] + 2 * span
        return F.when(close, F.transform(F.filter(F.array(latest - 1, latest), holds), block))

    made = F.flatten(F.array_compact(F.transform(hits, opened)))
    return F.filter(made, lambda block: F.size(block["words"]) >= least)


def scanned(docs: DataFrame, vocabulary: list[str], least: dict[int, int], phrases: dict[str, str]) -> DataFrame:
    """Phrase results of each text and its runs of each span that hold at least ``least[span]`` vocabulary words."""
    listed = docs.select("doc_id", word_list(lower_az(F.col("text"))).alias("words"))
    hits = F.array_compact(F.transform("words", lambda word, i: F.when(word.isin(vocabulary), F.struct(i.alias("at"), word.alias("word")))))
    spelled = listed.select(
        "doc_id", hits.alias("hits"), F.size("words").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("spelled")
    )
    columns = phrase_columns(F.col("spelled"), F.col("n_words"), phrases)
    blocks = F.concat(*[runs(F.col("hits"), span, needed) for span, needed in sorted(least.items())])
    return spelled.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), blocks.alias("blocks"), *[c.alias(n) for n, c in columns.items()])


def needed_words(wording: str, share: float) -> int:
    return math.ceil(share * len(set(wording.split())) - 1e-9)


def template_prefixes(templates: Sequence[tuple[str, str]], order: dict[str, int], share: float) -> list[tuple]:
    """(word, span, template, place, size, needed) of each template's first words in global order."""
    rows = []
    for number, (_, wording) in enumerate(templates):
        words = sorted(set(wording.split()), key=order.__getitem__)
        needed = needed_words(wording, share)
        rows += [(word, len(wording.split()), number, place, len(words), needed) for place, word in enumerate(words[: len(words) - needed + 1])]
    return rows


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: dict[str, str] = PHRASES, share: float = SHARE
) -> DataFrame:
    """One row per row of ``docs``: phrase results, ``labels`` of phrases and templates, ``n_blocks``: runs that meet a
    template of their span, and ``score``: the largest share of a template found in a run, 1 with a phrase, else 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    vocabulary = sorted({w for _, wording in templates for w in wording.split()})
    least: dict[int, int] = {}
    for _, wording in templates:
        span = len(wording.split())
        least[span] = min(least.get(span, span), needed_words(wording, share))
    texts = scratch.put("license-texts", scanned(docs, vocabulary, least, phrases).withColumn("row", F.monotonically_increasing_id()))
    blocks = texts.select("row", F.explode("blocks").alias("block")).select("row", "block.*")
    counted = {r.word: r.n for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    ranked = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    order = {w: i for i, w in enumerate(ranked)}
    prefixes = spark.createDataFrame(template_prefixes(templates, order, share), "word string, span int, template int, place int, size int, needed int")

    # The words of a run in global order, with their places; runs without a word that opens some template are left out.
    opening = strings(sorted({r[0] for r in template_prefixes(templates, order, share)}))
    in_order = F.filter(strings(ranked), lambda w: F.array_contains(F.col("words"), w))
    opened = blocks.where(F.arrays_overlap("words", opening)).select("row", "span", "run", in_order.alias("words"))
    places = opened.select("row", "span", "run", "words", F.posexplode("words").alias("at", "word"))
    left = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("words") - F.col("at") - 1)
    candidates = places.join(prefixes, ["word", "span"]).where((F.size("words") >= F.col("needed")) & (left >= F.col("needed")))
    wordings = F.array(*[strings(sorted(set(wording.split()))) for _, wording in templates])
    common = F.size(F.array_intersect("words", F.get(wordings, F.col("template"))))
    found = (
        candidates.dropDuplicates(["row", "span", "run", "template"])
        .withColumn("common", common)
        .where("common >= needed")
        .select("row", "span", "run", F.get(strings([label for label, _ in templates]), F.col("template")).alias("label"), (F.col("common") / F.col("size")).alias("share"))
    )
    per_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count_distinct("span", "run").alias("n_blocks"))
    nothing = F.array().cast("array<string>")
    both = F.sort_array(F.array_union("base", F.coalesce("more", nothing)))
    return texts.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
