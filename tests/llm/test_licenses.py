"""License phrases and template blocks against the registered SQL on odd texts."""

import duckdb
import pandas as pd

from tidebook.llm import licenses
from tidebook.llm.queries import ORACLES

TEXTS = [
    "Released under the MIT License.",
    "under\nthe MIT\n\nlicense, and CC-BY-NC cc by nc CC by nc 4.0",
    "Apache License, Version 2.0\nLicensed under the Apache License version 2",
    "this work is licensed under the gnu general public license",
    "version 3 gnu public general the under licensed is work this licence",
    "under the mit licenses; under the mitlicense",
    "the of and to " * 500,
    "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "é under the mit license é",
    "",
    None,
    "..\n--",
    "cc by nc",
    # The usual header: wrapped, with signs at the line starts.
    "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and\n# associated documentation files",
    # The same words strewn over one long line name no license.
    " ".join(f"{w} " + "filler " * 400 for w in "this work is licensed under a creative commons attribution 4 0 international license".split()),
    "filler " * 13 + "this source code form is subject to the terms of the mozilla public license v 2 0" + " filler" * 7,
    "redistribution and use in\nsource and binary forms, with or without\nmodification, are permitted " * 2,
    "released under the mit license " * 40,
]


def test_against_sql(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    cursor = con.execute(ORACLES["op5_license_scan"])
    names = [d[0] for d in cursor.description]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS words", "2 AS row", "3 AS block")
    got = licenses.license_scan(frame).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(cursor.fetchall())
    found = {r.doc_id: r for r in licenses.license_scan(frame).collect()}
    assert found[1].n_base == 4 and found[1].base_labels == "cc-by-nc,mit" and found[1].first_word == 0
    assert found[3].labels == "gpl-3" and found[8].score == 1.0 and found[10].n_words == 0
    assert found[13].labels == "mit" and found[13].score == 1.0
    assert found[14].labels == "" and found[14].score == 0.0 and found[15].labels == "mpl-2"


def test_a_template_is_found_wherever_it_starts(spark):
    label, wording = licenses.TEMPLATES[1]
    words = wording.split()
    texts = ["x " * before + sep.join(words) + " y" * 30 for before in range(2 * len(words) + 1) for sep in (" ", "\n")]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(rows) == len(texts) and all(r.labels == label and r.score == 1.0 for r in rows)


def test_a_very_long_text(spark):
    label, wording = licenses.TEMPLATES[-1]
    text = "the terms of this and that work " * 150_000 + wording + " is it" * 100_000
    (row,) = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row.labels == label and row.n_words == len(text.split()) and row.n_base == 0


def test_repeated_rows_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[0])], "doc_id bigint, text string")
    assert licenses.license_scan(frame).where("labels = 'mit'").count() == 3
    assert licenses.license_scan(frame.limit(0)).count() == 0
