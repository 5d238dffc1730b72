"""Quote parsing, linking and reply order, by hand and against the registered SQL."""

import duckdb
import pandas as pd
import pytest

from tidebook.llm import quotes
from tidebook.llm.queries import ORACLES

MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nAnd how do I reverse it?"),
    (1, 1, "assistant", "> how do I   SORT a list?\n\nUse sorted.\n\n> And how do I reverse it?\nUse reversed."),
    (1, 2, "user", "An unrelated question."),
    (1, 3, "assistant", "On Monday A wrote:\n> > And how do I reverse it?\n> Use reversed.\nOr slice it."),
    (1, 4, "user", "> An unrelated question.\nNever mind."),
    (1, 5, "user", "> Or slice it.\n>> Use reversed.\nThanks."),
    (2, 0, "user", "> quoted from nowhere at all\n> and more"),
    (2, 1, "user", ">>> short\n\nplain"),
    (2, 2, "user", ""),
    (2, 3, "user", None),
    (3, 0, "user", "same text in here"),
    (3, 0, "user", "same text in here"),
    (3, 1, "user", "> same text in here\n> same text in here"),
    (3, 2, "user", "> same text in here\n\n> same text in here"),
    # One line of two; a sentence with new line breaks; a piece that a later whole paragraph also holds; nothing known.
    (4, 0, "user", "What is a monad?\nAnd why should I care about it, really? Tell me more."),
    (4, 1, "assistant", "> What is a monad?\nA monoid."),
    (4, 2, "user", "> And why should I care\n> about it, really?\nBecause."),
    (4, 3, "user", "What is a monad?\nno"),
    (4, 4, "user", "> What is a monad?\n> A monoid.\n\n> never said by anyone"),
    (4, 5, "user", "> A monoid.\n>\n> Because.\nWell."),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_threads_follow_replies(spark):
    rows = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(frame(spark, MESSAGES[:6])).collect()}
    assert {t: rows[1, t].reply_to for t in range(6)} == {0: None, 1: 0, 2: None, 3: 1, 4: 2, 5: 3}
    assert [t for _, t in sorted(rows, key=lambda k: rows[k].position)] == [0, 1, 3, 5, 2, 4]
    assert rows[1, 1].text == "Use sorted.\n\n\nUse reversed."
    assert rows[1, 3].text == "Or slice it." and rows[1, 3].n_quoted == 2 and rows[1, 3].n_linked == 2


def test_partial_quotes_are_linked(spark):
    rows = {r.turn: r for r in quotes.reply_ordered(frame(spark, [m for m in MESSAGES if m[0] == 4])).collect()}
    assert {t: r.reply_to for t, r in rows.items()} == {0: None, 1: 0, 2: 0, 3: None, 4: 1, 5: 2}
    assert rows[4].n_quoted == 2 and rows[4].n_linked == 1 and rows[2].text == "Because."


def test_a_very_long_quote(spark):
    long = "\n".join(f"line number {i} of a long message." for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "\n".join("> " + line for line in long.split("\n")[5:]) + "\nyes")]
    found = {r.turn: r for r in quotes.reply_ordered(frame(spark, rows)).collect()}
    assert found[1].reply_to == 0 and found[1].text == "yes" and found[1].n_quoted == found[1].n_linked == 1


@pytest.mark.parametrize("sent", [True, False])
def test_against_sql(spark, monkeypatch, sent):
    if not sent:  # as with more passages or conversations than are sent to the tasks
        monkeypatch.setattr(quotes, "sent_if_small", lambda stored: stored)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(MESSAGES, columns=["conv_id", "turn", "role", "text"]))
    cursor = con.execute(ORACLES["op1_quotation_linking"])
    names = [d[0] for d in cursor.description]
    expected = sorted((str({n: v for n, v in zip(names, row) if n != "text" or v}) for row in cursor.fetchall()))
    got = quotes.reply_ordered(frame(spark, MESSAGES)).select(*names).collect()
    assert sorted(str({n: v for n, v in r.asDict().items() if n != "text" or v}) for r in got) == expected


def test_nulls_empty_tables_and_extra_columns(spark):
    rows = [(None, 0, "user", "hello there"), (None, None, None, None), (5, None, "user", "> hello there"), (5, 1, "user", "x" * 100_000)]
    df = frame(spark, rows).selectExpr("*", "1 AS position", "'a' AS row", "2 AS index")
    found = quotes.reply_ordered(df)
    assert found.count() == 4 and found.where("reply_to IS NOT NULL").count() == 0
    assert quotes.reply_ordered(frame(spark, [])).count() == 0
