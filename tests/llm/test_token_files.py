"""Token files against the library, and code lengths against plain Huffman coding."""

import heapq
import random
import zlib

import numpy as np
import pytest

from tidebook.llm import token_files
from tidebook.llm.common import Scratch
from tidebook.llm.queries import QUERIES, tokenizer_file

FILE = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(FILE))


def check(rows, docs, library):
    start = 0
    assert len(rows) == len(docs)
    for r, (_, text) in zip(rows, docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_the_query_equals_the_library(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    check(sorted(QUERIES["op9_token_files"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id), docs, library)


def test_odd_texts_nulls_and_repeated_rows(spark, library):
    random.seed(8)
    alphabet = "abTHE .,'\n\t\x1c éÉßİΣσ中19#$ÄÖ́"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|>", "<|ENDOFTEXT|> x", "It's I'LL we've 3's .'s", "word.,word ,word.", "", None, "ab " * 200_000]
    docs = sorted([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], key=lambda d: d[0])
    frame = spark.createDataFrame(random.sample(docs, len(docs)), "doc_id bigint, text string").selectExpr("*", "1 AS file", "2 AS ids")
    blocks, codes = token_files.write(frame, tokenizer_file(FILE), Scratch(spark))
    rows = token_files.read(blocks, codes).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32").collect()
    check(sorted(rows, key=lambda r: r.start), docs, library)


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    flat, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])]


def test_a_word_is_encoded_once_whatever_signs_close_it(library):
    encoder = token_files.WordEncoder(library.to_str())
    texts = [f"{a}{sign} {b}{sign}" for a, b in (("alpha", "beta"), ("Beta", "x9")) for sign in ("", ".", ",", "&&&", '."')]
    assert encoded(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.table.count == 3 + 4


def test_signs_at_the_ends_of_words_and_texts(library):
    random.seed(10)
    alphabet = ["a", "B", "s", "'s", "9", "é", "ñ", "€", "…", ".", "'", "&", "_", "<", ">", "=", "^", "\u0338", "\u0301", "\x00", "\x1c", " ", "\n", "\u00a0"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 12))) for _ in range(6000)]
    encoder = token_files.WordEncoder(library.to_str())
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        assert encoded(encoder, some) == [library.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("hot", [7, None])
def test_rows_of_one_id_are_spread(spark, library, hot):
    docs = [(hot, f"text {i} of " + "one id " * (i % 9)) for i in range(1500)] + [(9, "the last")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS spread")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks, codes = token_files.write(frame, tokenizer_file(FILE), Scratch(spark))
        most = blocks.selectExpr("file", "size(doc_ids) AS n").groupBy("file").sum("n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(most) >= 4 and max(r[1] for r in most) < 800
    rows = sorted(token_files.read(blocks, codes).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS crc").collect(), key=lambda r: r.start)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert rows[-1].doc_id == 9
    wanted = [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in docs]
    assert sorted((r.n_tokens, r.crc) for r in rows) == sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in wanted)


def test_an_empty_table(spark):
    blocks, codes = token_files.write(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_file(FILE), Scratch(spark))
    assert token_files.read(blocks, codes).count() == 0


def test_lengths_are_best_and_limited():
    random.seed(9)
    for _ in range(60):
        counts = np.array([random.randint(1, 10 ** random.randint(1, 6)) for _ in range(random.randint(2, 200))])
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (token_files.code_lengths(counts, 40) * counts).sum() == cost
        tight = token_files.code_lengths(counts, int(len(counts) - 1).bit_length())
        assert sum(2.0 ** -x for x in tight) <= 1 and tight.max() <= int(len(counts) - 1).bit_length()
        book = token_files.CodeBook(np.arange(len(counts)) * 2, token_files.code_lengths(counts, 12))
        ids = np.array(random.choices(range(len(counts)), k=700)) * 2
        assert (token_files.open_block(token_files.pack_block(np.array([300, 400]), ids, book), book)[1] == ids).all()
