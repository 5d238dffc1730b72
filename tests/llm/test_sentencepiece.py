"""Ids and texts against the library itself."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import sentencepiece
from tidebook.llm.queries import QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load(tokenizer_file("piece_bpe_32k.model"))


def test_the_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = [1, *library.encode(texts[r.doc_id]), 2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_texts_nulls_and_extra_columns(spark, library, model):
    random.seed(5)
    alphabet = "ab e  \n\tthn.,!'\"()▁éß中國😀\x00\r-_=/<>s0123ABCThe"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 70))) for _ in range(500)]
    texts += ["", " ", "   x", "</s>", "<0x0A>", "a" * 3000, "x y " * 20_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*texts, None])], "id int, text string, decoded string")
    rows = {r.id: r for r in sentencepiece.decode(sentencepiece.encode(df, model), model).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = np.frombuffer(rows[i].ids, "<u4").tolist()
        assert ids == [1, *library.encode(text), 2]
        assert rows[i].decoded == library.decode(ids)
    assert np.frombuffer(rows[len(texts)].ids, "<u4").tolist() == [1, 2] and rows[len(texts)].decoded == ""


def test_decoding_any_ids(library, model):
    decoder = sentencepiece.Decoder(model)
    random.seed(6)
    for _ in range(500):
        ids = [random.choice([random.randrange(32_000), random.randrange(300)]) for _ in range(random.randint(0, 8))]
        assert decoder.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_a_batch_is_decoded_in_bounded_runs(library, model):
    """Not a whole batch of texts at once: its memory would grow with the rows that Spark sends together."""
    texts = [f"Text {i}, é😀 中{' word' * 2000}" for i in range(300)]
    ids = [np.array([1, *library.encode(t), 2], "<u4") for t in texts]
    ids.insert(7, np.array([model.names.index("<0xC3>"), model.names.index("<0x41>")], "<u4"))

    def decoded(*values):
        batch = pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["ids"])
        rows = SimpleNamespace(schema=T.StructType([]), mapInArrow=lambda run, _: list(run(iter([batch.slice(1)]))))
        rows.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
        return [part.column("decoded").to_pylist() for part in sentencepiece.decode(rows, model)]

    parts = decoded(*[r.tobytes() for r in ids], None)
    assert max(map(len, parts)) < 200
    assert sum(parts, []) == [library.decode(r.tolist()) for r in ids[1:]] + [""]
    assert decoded(b"", None, None) == [["", ""]] and decoded(None) == []
    with pytest.raises(ValueError):
        decoded(b"", b"12345", b"123")


def test_an_empty_table(spark, model):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sentencepiece.decode(sentencepiece.encode(empty, model), model).where(F.lit(True)).count() == 0
