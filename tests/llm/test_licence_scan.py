import hashlib
import os
import sys
import textwrap

import pytest

from ledgerlark.llm import licence_scan as c

sys.path.insert(0, os.path.dirname(__file__))
from licence_texts import TEXTS  # noqa: E402

MIT_HEAD = "The MIT License (MIT)\nCopyright (c) 1999-2024 Some One\nAll rights reserved.\n\n"


def test_spellings_case_punctuation_and_copyright_lines_fold():
    a = "Licensed under the Licence.\nCopyright 2020 A B\nIn favour of NON-commercial use"
    b = "licensed UNDER the license, in favor of noncommercial use"
    assert c.canonical(a) == c.canonical(b) == "licensed under the license in favor of noncommercial use"
    assert c.canonical("the above copyright notice and this") == "the above copyright notice and this"


def test_whole_texts_and_notices(spark):
    known = {c.digest("one two licence"): "X-1"}
    rows = [(1, "ONE, two: License!\n(c) 2001 me"), (2, "one two license three"), (3, "text\nReleased under the MIT License.\nmore\nLicensed under the Apache License, Version 2.0."), (4, None), (5, ""), (5, "Licensed under CC BY-NC 4.0.")]
    out = {(r["doc_id"], r["n_notices"]): r for r in c.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"), texts=known).collect()}
    assert out[1, 0]["licence"] == "X-1" and out[2, 0]["licence"] is None and out[4, 0]["licence"] is None
    assert out[3, 2]["notices"] == "Apache-2.0,MIT" and out[5, 1]["notices"] == "CC-BY-NC-4.0"
    assert out[4, 0]["text_digest"] == out[5, 0]["text_digest"] == c.digest("")


def test_column_equals_plain_python(odd, odd_rows, none):
    want = sorted(c.digest(r[1]) for r in odd_rows)
    assert sorted(r["text_digest"] for r in c.licence_scan(odd).collect()) == want
    assert c.licence_scan(none).count() == 0


def test_table_has_common_licences():
    assert {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "ISC"} <= set(c.text_digests().values())


#: One case for each spelling rule, spelt out by hand.
SPELT = {
    "the Licence and Licences": "the license and licenses", "a Sublicence here": "a sublicense here", "licenced": "licensed", "Authorised": "authorized", "organisation": "organization",
    "recognised": "recognized", "favour": "favor", "behaviour": "behavior", "merchantibility": "merchantability", "acknowledgement": "acknowledgment", "fulfilment of": "fulfillment of",
    "judgement": "judgment", "Non-Commercial use": "noncommercial use", "to sub-license it": "to sublicense it", "see http://x": "see https x", "copyright holder's fault": "copyright holders fault",
}


@pytest.mark.parametrize("seen", SPELT)
def test_each_spelling_rule(seen):
    assert c.canonical(seen) == SPELT[seen] and len(SPELT) == len(c.SPELLINGS)


def test_a_notice_on_the_line_of_the_terms_goes_alone():
    for notice in ("Copyright (c) 2020 Foo, Inc. ", "(c) 1999-2024 A B. ", "Copyright by A. All rights reserved. "):
        assert c.canonical(notice + "Permission is hereby granted, free") == "permission is hereby granted free"
    assert c.canonical("Copyright 2020 Foo. Licensed under the MIT License.") == "licensed under the mit license"
    assert c.canonical("Copyright (c) 2020 Foo") == ""


def planted():
    """Every text as it is, on one line behind its notice, wrapped in capitals, and changed by a word."""
    rows = []
    for name, text in TEXTS.items():
        flat = " ".join(text.split())
        british = text.replace(" license", " licence").replace("acknowledgment", "acknowledgement")
        for shape in (text, "Copyright (c) 2019 Jane Doe, Inc. " + flat, "(C) 2001-2024 Some Body\nAll rights reserved.\n\n" + textwrap.fill(flat, 60).upper(), "> " + british.replace("\n", "\n> ")):
            if shape == text or shape[0] == ">" or "Copyright (" not in text:  # a notice inside is told by its line
                rows.append((len(rows), shape, name))
        rows.append((len(rows), text + " except on Sundays", None))
    return rows


def test_planted_licences_are_found(spark):
    rows = planted()
    out = {r["doc_id"]: r for r in c.licence_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {i: out[i]["licence"] for i, _, _ in rows} == {i: name for i, _, name in rows} and len(TEXTS) == 13


def test_sql_finds_the_planted_licences_too(spark, tmp_path):
    import duckdb

    rows = planted()
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r[:2]) for r in rows])
    got = con.sql(c.oracle()).fetchall()
    want = c.licence_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_texts_of_a_folder(tmp_path):
    (tmp_path / "X-9.txt").write_text("Any Licence text.\nCopyright 2020 me")
    assert c.read_texts(str(tmp_path)) == {hashlib.sha256(b"any license text").hexdigest(): "X-9"}
