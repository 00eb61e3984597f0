"""Steps that grew faster than their input, or left their SQL on odd inputs."""

from pyspark.sql import functions as F

from ledgerlark.operators import bm25, cleaning, evidence, index, windows
from ledgerlark.plans import catalogue
from ledgerlark.sources import html, instance, parts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compact_tables_join_nothing(spark):
    pages = spark.createDataFrame([("f", "<table><tr><td>A</td><td>FY 2023</td></tr><tr><td>x</td><td>1</td></tr></table>")], "file string, html string")
    out = html.compact_tables(html.cells(pages))
    assert "Join" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("f", 0, 1, "x", "FY 2023", 1, 1.0)]


def test_compact_tables_pick_account_and_periods(spark):
    rows = [["", "n", "FY 2021", "FY 2023", "FY 2022", "text"], ["a", "z", "1", "3", "2", "x"], ["b", "", "(4)", "n/a", "$5K", "y"], ["", "", "7", "8", "9", "10"]]
    cells = [("f", 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t] + [("g", 1, 0, 0, "only a header")]
    got = html.compact_tables(spark.createDataFrame(cells, "file string, table int, row int, col int, text string")).orderBy("row", "period_rank").collect()
    assert [(r["row"], r["account"], r["header"], r["value"]) for r in got] == [(1, "a", "FY 2023", 3.0), (1, "a", "FY 2022", 2.0), (2, "b", "FY 2023", None), (2, "b", "FY 2022", 5000.0), (3, None, "FY 2023", 8.0), (3, None, "FY 2022", 9.0)]


def test_null_intervals_open_no_cover(spark):
    rows = [(1, 1, 3), (1, 2, 5), (1, 7, 8), (1, None, None), (1, 9, None), (2, None, None), (2, 4, 6), (3, None, None)]
    got = windows.covered(spark.createDataFrame(rows, "k int, a int, b int"), ["k"], "a", "b").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 5), (1, 7, 8), (1, 9, None), (2, 4, 6), (3, None, None)], key=str)


def test_tail_words_of_odd_texts(spark, tmp_path):
    nine = [f"w{i}" for i in range(9)]
    want = {None: (None, None), "": ("", 1), " ": (" ", 1), "a\x0bb c": ("a\x0bb c", 2), "a\x0b" * 12: ("a\x0b" * 12, 1), "\u3000" + " ".join(nine) + "\u3000": (" ".join(nine[1:]), 9), " ".join(nine) + "\n": (" ".join([*nine[2:], ""]), 10)}
    spark.createDataFrame(list(enumerate(want)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["tail"], r["n_words"]) for r in catalogue.QUERIES["tail_words"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_terms_are_counted_in_their_row(spark, tmp_path):
    rows = [(1, "pear fig pear"), (2, "fig"), (2, "nut"), (2, "nut lime"), (3, None), (4, "the a")]
    docs = spark.createDataFrame(rows, "rid long, text string")
    assert "Exchange" not in plan(bm25.counted(docs))
    built = bm25.build_index(docs, f"file://{tmp_path}/index")
    want = {tuple(r) for r in bm25.postings(docs).select("term", "rid", "tf", "length").collect()}
    got = [tuple(r) for r in built.postings.select("term", "rid", "tf", "length").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not (tmp_path / "index" / "counts").exists()


def test_citations_stay_where_they_are(spark):
    cited = spark.createDataFrame([("a", " x "), ("b", "y")], "rid string, quote string")
    packed = spark.createDataFrame([("a",), ("a",)], "rid string")
    df = evidence.guarded_citations(cited, packed)
    assert "SortMergeJoin" not in plan(df) and [tuple(r) for r in df.collect()] == [("a", "x")]


def test_instances_are_parsed_once_and_stay(spark):
    ns = 'xmlns="http://www.xbrl.org/2003/instance" xmlns:ll="urn:ll"'
    unit = lambda name, measure: f'<unit id="{name}"><measure>{measure}</measure></unit>'
    fact = lambda context, unit, value: f'<ll:F contextRef="{context}" unitRef="{unit}">{value}</ll:F>'
    context = '<context id="c"><entity><identifier scheme="s">E</identifier></entity></context>'
    xml = f'<xbrl {ns}>{context}{unit("u", "A")}{unit("v", "B")}{fact("c", "v", 1)}{fact("c", "u", 2)}{fact("x", "u", 3)}{fact("c", "x", 4)}<ll:F contextRef="c">5</ll:F></xbrl>'
    out = instance.facts_in_context(spark.createDataFrame([(1, xml), (1, xml.replace("A", "C")), (2, None), (3, "<x")], "filing_id long, xml string"))
    assert "Exchange" not in plan(out)
    got = sorted(tuple(r) for r in out.select("filing_id", "qname", "value_raw", "entity", "measure", "doc_order").collect())
    assert got == [(1, "ll:F", "1", "E", "B", 0), (1, "ll:F", "1", "E", "B", 0), (1, "ll:F", "2", "E", "A", 1), (1, "ll:F", "2", "E", "C", 1)]


def test_files_are_parsed_a_bounded_number_at_a_time(spark):
    def parse(text):
        held.append(text)
        return [{"n": len(held)}] * 2

    held = []  # one copy a task
    out = parts.in_parts(spark.range(300).selectExpr("id", "cast(id as string) as t").coalesce(1), "id", "t", parse, most=7, n="int")
    assert [r["n"] for r in out.orderBy("file", "position").collect()] == [i // 2 + 1 for i in range(600)]
    pages = spark.createDataFrame([("f", "<p>one two</p><p>three</p>"), ("g", None)], "file string, html string")
    text = html.text_rows(pages)
    assert "MapInArrow" in plan(text) and [r["text"] for r in text.orderBy("position").collect()] == ["one two", "three"]


def test_document_metadata_sort_after_the_exchange(spark):
    facts = spark.createDataFrame([("f", "dei:TradingSymbol", "b", 2), ("f", "dei:TradingSymbol", "a", 1), ("g", "dei:Other", "x", 1)], "filing_id string, qname string, value_raw string, doc_order int")
    df = index.document_metadata(facts)
    assert "Sort" not in plan(df).partition("Exchange")[2]
    assert [(r["filing_id"], r["ticker"]) for r in df.collect()] == [("f", "A")]


def test_sentences_are_cut_once(spark):
    rows = spark.createDataFrame([("f", 1, "NOTE 1 LEASES\nWe paid 5. We paid 5."), ("f", 2, "More 6.")], "file string, position int, text string")
    df = cleaning.clean_rows(rows)
    assert "long_cut" not in plan(df)
    assert [(r["position"], r["heading"], r["text"]) for r in df.orderBy("position", "part").collect()] == [(1, "NOTE 1 LEASES", "NOTE 1 LEASES"), (1, "NOTE 1 LEASES", "We paid 5."), (2, "NOTE 1 LEASES", "More 6.")]
