"""Runs of a text against a plain search over all periods, trees and range minima by themselves, odd input."""

import random
import re
import zlib

import numpy as np
import pytest

from tidebook.llm import periodic
from tidebook.llm.queries import QUERIES, with_planted_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(s, least):
    """(start, end, period) by comparing each word with the one a period later, least period first."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            begin = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            if i > begin and i + q - begin >= max(least, 2 * q):
                found.setdefault((begin, i + q), q)
            i += i == begin
    return sorted([(a, b, q) for (a, b), q in found.items()], key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    dropped = {i for a, b, q in runs for i in range(a + q, b)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_symbols(least):
    rng = random.Random(least)
    for _ in range(250):
        n = rng.randint(1, 70)
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 9)
            s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert [tuple(r) for r in periodic.runs_of(np.array(s), least).tolist()] == plain_runs(s, least)


def test_range_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 777)
    low = rng.integers(0, 777, 3000)
    high = np.minimum(776, low + rng.integers(0, 300, 3000))
    assert periodic.RangeMin(values).of(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


def test_extensions_and_ranks():
    s = [2, 1, 2, 1, 2, 3, 1, 2, 1, 0]
    trees = periodic.Extensions(s, 4)
    suffixes = [s[i:] for i in range(len(s))]
    assert sorted(range(len(s)), key=lambda i: suffixes[i]) == np.argsort(trees.rank).tolist()
    pairs = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]
    common = [next(k for k, (x, y) in enumerate(zip(suffixes[a] + [-1], suffixes[b] + [-2])) if x != y) for a, b in pairs]
    assert trees.common(*np.array(pairs).T).tolist() == common


def texts():
    rng = random.Random(3)
    vocabulary = ["a", "b", "é", "long-word", "ß😀"]
    out = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a b c d e f a b c d e f", "x a b c d e f a b c d e y"]
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 80))
        if rng.random() < 0.6:
            at, p = rng.randrange(len(words)), rng.randint(1, 20)
            words[at:at] = (words[at : at + p] * rng.randint(1, 6))[: rng.randint(1, 100)]
        out.append(rng.choice([" ", "\n", "\x0b\r"]).join(words))
    line = "the same line of nine words comes back here"
    out += [f"{line}\nother words {line}", "\n".join([line] * 7), *[out[-1]] * 3, " ".join(f"w{i}" for i in range(400))]
    return out


@pytest.mark.parametrize("tree_words", [1, 60, 1 << 14])
def test_texts_against_the_plain_search(spark, tree_words):
    rows = list(enumerate(texts())) + [(None, "b a " * 20), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "'x' AS collapsed", "3 AS text_key")
    found = periodic.periodic_runs(frame).collect()
    assert len(found) == len(rows)
    shown = sorted((r.doc_id or -1, r.n_words, [(x.start, x.start + x.length, x.period) for x in r.runs], r.collapsed) for r in found)
    wanted = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words, 12)
        wanted.append((doc_id or -1, len(words), runs, plain_collapse(words, runs)))
    assert shown == sorted(wanted)


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(50_000)] + ["p", "q", "r"] * 50_000
    frame = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 3_000_000)], "doc_id int, text string")
    one, two = sorted(periodic.periodic_runs(frame).collect())
    assert [tuple(r) for r in one.runs] == [(50_000, 150_000, 3)] and one.collapsed == " ".join(words[:50_003])
    assert two.n_words == 1 and not two.runs


def test_the_rule_that_plants_runs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (7, None)]
    for r in with_planted_runs(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        if r.doc_id is None or r.text is None:
            assert (r.doc_id, r.text) in rows
            continue
        words, h = [f"w{j}" for j in range(r.doc_id % 37)], zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert r.text.split() == words


def test_query_without_runs_and_without_rows(spark, tmp_path):
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "a b c")], schema).write.parquet(f"{tmp_path}/one/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    (row,) = QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/one").collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (0, None, None, None, None)
    assert QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/none").count() == 0
