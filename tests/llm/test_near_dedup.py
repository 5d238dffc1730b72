"""Components of near copies against all pairs of full sets."""

import random
import re

import pytest

from tidebook.llm import near_dedup
from tidebook.llm.common import Scratch
from tidebook.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def expected(docs, width, percent=80):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i))), least.get(find(i)) == d) for i, ((d, _), s) in enumerate(zip(docs, sets)))


@pytest.mark.parametrize("width, sent", [(2, True), (5, True), (2, False)])
def test_families_strays_and_copies(spark, monkeypatch, width, sent):
    if not sent:  # as with more keys than are sent to the tasks: shuffle joins throughout
        monkeypatch.setattr(near_dedup, "sent_if_small", lambda stored: stored)
    random.seed(width)
    docs = []
    for _ in range(4):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([12, 80, 300]))]
        for _ in range(30):
            words = list(base)
            for _ in range(random.randint(0, len(words) // (4 * width) + 1)):
                words[random.randrange(len(words))] = f"w{random.randrange(400)}"
            docs.append(" ".join(words))
    docs += docs[:5] + [docs[0].upper(), "one", "One", "one two", "", " \n", None, None, "\x1c", "x " * 30_000]
    docs = [(i * 7 % 1000, t) for i, t in enumerate(docs)] + [(3, docs[1]), (None, docs[2]), (None, "all alone here")]
    random.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS bands")
    rows = near_dedup.near_duplicates(frame, width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == expected(docs, width)
    kept = near_dedup.one_of_each(frame, width)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in rows)


def test_an_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
