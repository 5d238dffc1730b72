"""Lines within one edit against an all-pairs comparison."""

import random

from tidebook.llm import line_dedup
from tidebook.llm.common import Scratch

LONG = "the quick brown fox jumps over the lazy dog and sleeps"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def expected(docs):
    places = {}
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\n\x0b\f\r"):
                places.setdefault(line, (doc_id, i))
                places[line] = min(places[line], (doc_id, i))
    lost = {a for a in places if len(a) >= 30 and any(len(b) >= 30 and a != b and places[b] < places[a] and within_one(a, b) for b in places)}
    out = {}
    for doc_id, text in docs:
        if text is not None:
            lines = text.split("\n")
            stay = [x for i, x in enumerate(lines) if not x.strip(" \t\n\x0b\f\r") or (places[x] == (doc_id, i) and x not in lost)]
            near = sum(x in lost and places[x] == (doc_id, i) for i, x in enumerate(lines) if x in places)
            out[doc_id] = ("\n".join(stay), sum(x in places for x in lines), sum(x in places for x in stay), near)
        else:
            out[doc_id] = (None, 0, 0, 0)
    return out


def test_edits_repeats_and_blanks(spark):
    random.seed(4)
    base = ["".join(random.choice("abc é") for _ in range(random.randint(28, 60))) for _ in range(12)]
    base += ["z" * 40, "page number one of this long report", "😀" * 31]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(random.randint(0, 6)):
            line = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                at = random.randrange(len(line))
                edit = random.random()
                line[at : at + 1] = [] if edit < 0.3 else [random.choice("abcé"), *line[at : at + 1]] if edit < 0.6 else [random.choice("abcdé")]
            lines.append("".join(line))
        docs.append((i, "\n".join([*lines, random.choice(["", " ", "short", "\t"])])))
    docs += [(70, None), (71, ""), (72, "\n\n"), (73, docs[1][1]), (74, "x" * 5000 + "\n" + "x" * 5001)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'c' AS kept", "1 AS line", "2 AS lines", "3 AS n_lines", "4 AS row")
    rows = line_dedup.without_repeats(frame).collect()
    assert {r.doc_id: (r.deduped, r.n_lines, r.n_kept, r.n_near) for r in rows} == expected(docs) and len(rows) == len(docs)
    assert all(r.kept == "c" and r.line == 1 and r.row == 4 for r in rows)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    rows = [(1, "a line\nmore"), (1, "a line\nmore"), (None, "a line"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((str(r.doc_id), str(r.text), r.deduped or "") for r in line_dedup.without_repeats(frame).collect())
    # NULL ids come first, so they keep the line; equal rows stay equal.
    assert found == [("1", "a line\nmore", "more"), ("1", "a line\nmore", "more"), ("None", "None", ""), ("None", "a line", "a line")]
    assert line_dedup.without_repeats(frame.limit(0)).count() == 0


def test_near_equal_lines_of_millions_of_characters(spark):
    line = "".join(chr(97 + (i * i // 7) % 26) for i in range(2500)) * 1800
    rows = [(1, line), (2, line[:2_000_000] + line[2_000_001:])]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r.doc_id: (r.n_kept, r.n_near) for r in line_dedup.without_repeats(frame).drop("text", "deduped").collect()}
    assert found == {1: (1, 0), 2: (0, 1)}


def test_tables_are_counted_as_they_are_written(spark):
    """Each count of its own is two stages more that the driver plans and broadcasts; large tables still aren't sent."""
    docs = spark.createDataFrame([(1, LONG), (2, LONG.replace("quick", "quack")), (3, LONG + "!")], "doc_id bigint, text string")
    spark.sparkContext.setJobGroup("kept lines", "counts its jobs")
    rows = line_dedup.kept_lines(docs).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kept lines"))
    spark.sparkContext.setJobGroup("other", "other")
    assert sum(r.n_near for r in rows) == 2 and jobs <= 44
    scratch = Scratch(spark)
    for n, most, sent in ((5, 5, True), (6, 5, False), (0, 5, True)):
        stored = scratch.put_to_send("numbers", spark.range(n), most)
        assert ("broadcast" in stored._jdf.queryExecution().analyzed().toString().lower()) == sent and stored.count() == n


def test_code_of_part_keys_does_not_grow_with_the_parts(spark):
    lines = spark.createDataFrame([(1, LONG)], "id bigint, line string")
    sizes = []
    for parts in (2, line_dedup.PARTS):
        keys = line_dedup.cut_keys(lines, parts)
        assert len({r.part for r in keys.collect()}) == 2 * parts
        sizes.append(len(keys._jdf.queryExecution().executedPlan().toString()))
    assert sizes[1] < 2 * sizes[0]
