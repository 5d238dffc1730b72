"""The pipeline's stages: columns, order, and decisions checked on each stage's own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import expected as windows
from test_line_dedup import expected as deduped
from test_near_dedup import expected as groups

from tidebook.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"


def test_stages_decide_on_their_own_input(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 90")
    names = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(1000, "12 34", "en", "s", 5), (1001, None, None, None, None)], docs.schema)
    docs = scratch.put("start", docs.union(extra))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.put(f"after-{name}", stage(spark, docs, FOLDER))
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            assert set(before) - set(rows) >= {1000, 1001} and len(rows) >= 88
        elif name == "lines":
            wanted = {d: t for d, (t, n, kept, _) in deduped(sorted(before.items())).items() if n == 0 or kept}
            assert {d: r.text for d, r in rows.items()} == wanted and all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "near_duplicates":
            assert set(map(str, rows)) == {d for d, _, _, kept in groups(sorted(before.items()), 5) if kept}
        elif name == "benchmark":
            assert set(rows) == {d for d, t in before.items() if not windows(t, items)[4]}
        else:
            assert {d: r.decoded for d, r in rows.items()} == before and docs.columns == ["doc_id", "n_tokens", "ids", "decoded"]
            break
        assert docs.columns == names


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids", "decoded"]


CLASHING = ["rejected_id", "rejected_key", "rest_id", "rest_key", "bad_id", "bad_text", "own_id", "own_key", "gone_id", "gone_key", "row", "whole"]
CLASHING += ["n_kept", "n_lines", "n_near", "deduped", "kept", "score", "lang_pred", "text_key", "node", "items", "contaminated", "component_id"]


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [("the cat sat on the mat and looked out", "en"), ("le chat noir est sur la table et regarde", "fr")] * 8
    rows = [(i, f"{t} number {chr(97 + i) * 4}", lang) for i, (t, lang) in enumerate(texts)]
    rows += [(100, long, "en"), (101, None, None), (102, "", "en"), (None, "the cat is nobody's and has no number", "en"), (103, "12 34", None)]
    rows += [rows[0], rows[0]]
    spark.createDataFrame([(1, "some benchmark words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    clashing = plain.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, plain, str(tmp_path))
        assert kept.columns == plain.columns
        wide = scratch.put(f"wide-{name}", stage(spark, clashing, str(tmp_path)))
        assert wide.columns == clashing.columns
        assert all(r[c] == f"own {c}" for r in wide.collect() for c in CLASHING)
        plain = scratch.put(f"plain-{name}", kept)
        assert sorted(map(str, wide.select(plain.columns).collect())) == sorted(map(str, plain.collect())), name
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
        clashing = wide
    assert {r.doc_id for r in plain.collect()} >= {100, None}


def test_language_stage_keeps_an_unlabelled_corpus(spark):
    rows = [(1, "clean text", None), (2, "encore un texte", None), (3, "12 34", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, FOLDER).collect()} == {1, 2}
