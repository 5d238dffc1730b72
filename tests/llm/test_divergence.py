"""Source divergence against a plain count of everything, in blocks and pieces of several sizes, and odd input."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidebook.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least_docs=3, most_terms=200):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for i, (text, lang, source) in enumerate(rows):
        group = (lang or "", source or "")
        groups.add(group)
        for term in TERM.findall((text or "").translate(LOWER)):
            docs[group[0], term].add(i)
            counts[group][term] += 1
    out = set()
    for lang, source in groups:
        kept = [t for (of, t), held in docs.items() if of == lang and len(held) >= least_docs]
        sources = [s for of, s in groups if of == lang]

        def p_of(chosen):
            n = {t: sum(counts[lang, s][t] for s in chosen) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        p, whole = p_of([source]), p_of(sources)
        pairs = {other: sum((p[t] - q[t]) ** 2 // q[t] for t in kept) for other in sources if other != source for q in [p_of([other])]}
        terms = {t: (p[t] - whole[t]) ** 2 // whole[t] for t in kept if counts[lang, source][t] and p[t] > whole[t]}
        for part, values, most in (("pair", pairs, None), ("term", terms, most_terms)):
            for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def corpus():
    rng = random.Random(5)
    words = ["the", "The", "éa", "zz", "b2c", "a_b", "Ñandú", *[f"w{chr(97 + i)}x" for i in range(25)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    rows += [(None, "en", "mute"), ("", "xx", "s1"), ("12 34", "xx", "s2"), ("once only", "yy", "s1")]
    rows += [rows[0]] * 3 + [(" ".join(["long"] * 300 + ["Tail" * 40]), "en", s) for s in ("s1", "s2", "s2")]
    return rows


@pytest.mark.parametrize(("entries", "cut_bytes"), [(1, 64), (7, 200), (1 << 18, 1 << 20)])
def test_against_plain_counts(spark, entries, cut_bytes):
    rows = corpus()
    frame = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS total", "3 AS counts", "4 AS doc_id")
    found = [tuple(r) for r in divergence.divergence(frame, entries=entries, cut_bytes=cut_bytes).collect()]
    assert len(found) == len(set(found)) and set(found) == expected(rows)


def test_only_the_first_terms_are_listed(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.divergence(frame, most_terms=4, least_docs=2).collect()} == expected(rows, 2, 4)


def test_empty_table(spark):
    empty = divergence.divergence(spark.createDataFrame([], "text string, lang string, source string"))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0


def test_frequencies_beyond_64_bits(spark):
    whole = 8 * 10**15
    n = np.array([0, 10**10, whole - 2], np.int64)
    assert divergence.exact_frequency(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // whole for x in n]
    rows = spark.createDataFrame([(int(x), whole - 7, 7) for x in n], "n bigint, total bigint, terms bigint")
    shown = rows.select(divergence.frequency(rows.n, rows.total, rows.terms)).collect()
    assert [r[0] for r in shown] == divergence.exact_frequency(n, whole).tolist()


def test_runs_of_a_column():
    begin, p = divergence.column_of(10, np.array([2, 4, 8]), np.array([2, 1, 2]), np.array([5, 6, 7]), 1)
    assert begin.tolist() == [0, 2, 4, 5, 8] and p.tolist() == [1, 5, 6, 1, 7]
    begin, p = divergence.column_of(3, np.array([], np.int64), np.array([], np.int64), np.array([], np.int64), 9)
    assert begin.tolist() == [0] and p.tolist() == [9]
