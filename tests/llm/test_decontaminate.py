"""Windows found by winnowing against a plain search of every window."""

import hashlib
import random
import re

from tidebook.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        x = words(text)
        n = min(13, len(x))
        for p in range(len(x) - n + 1 if n else 0):
            for q in range(len(w) - n + 1):
                if w[q : q + n] == x[p : p + n]:
                    hit |= set(range(q, q + n))
                    if item is not None:
                        found.add(str(item))
    listed = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_every_window_is_found(spark):
    random.seed(3)
    vocabulary = ["the", "of", "Ärger", "x1", "a", "be", "to", "it", "In", "über", "zoo", "q"]
    say = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ".", "\n", " -- "]) for _ in range(n))
    items = [(i, say(random.choice([1, 2, 5, 9, 12, 13, 14, 30]))) for i in range(20)]
    items += [(100, items[-1][1]), (100, items[-1][1]), (101, ""), (102, None), (103, "..."), (None, say(15))]
    docs = []
    for i in range(60):
        text = say(random.randint(0, 60))
        if i % 3 == 0:
            text += " " + (random.choice(items)[1] or "").upper() + " " + say(5)
        docs.append((i, text))
    long = say(3000) + " " + items[5][1]
    docs += [(60, None), (61, ""), (62, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (63, long), (64, items[7][1] * 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS row", "3 AS window")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS words", "2 AS f")
    rows = decontaminate.contamination(frame, bench).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == sorted((str(d), *expected(t, items)) for d, t in docs)
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in docs if not expected(t, items)[4])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "some words here")], "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    row = decontaminate.contamination(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
