"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. ``run`` writes what a stage
returns to the shared scratch folder and hands on what it reads back, so stages recover on their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece
from tidebook.llm.common import Scratch, table
from tidebook.llm.queries import tokenizer_file

#: Trained models, edit distances and connected components are not SQL; the tests hold each stage against
#: a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    return language_id.in_a_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document goes if it had lines and all of them occur in earlier documents. Of the other
    columns only ``n_chars`` changes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []))
    deduped = line_dedup.without_repeats(packed).where("n_lines = 0 OR n_kept > 0")
    new = {c: F.col("others")[c] if c in others else F.col("deduped" if c == "text" else c) for c in docs.columns}
    if "n_chars" in new:
        new["n_chars"] = F.length("deduped").cast(docs.schema["n_chars"].dataType)
    return deduped.select(*[value.alias(c) for c, value in new.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return near_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lie in benchmark windows go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) and the text decoded from them."""
    model = sentencepiece.load(tokenizer_file("piece_bpe_32k.model"))
    encoded = sentencepiece.encode(docs.select("doc_id", "text"), model).drop("text")
    return sentencepiece.decode(encoded, model).select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.put(f"stage-{name}", stage(spark, docs, sf_dir))
    return docs
