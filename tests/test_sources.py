"""Files, HTML, linkbases, sinks, schemas, streams, engine and entry points."""

import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark import schemas
from ledgerlark.plans import engine
from ledgerlark.sources import files, html, linkbase, sinks
from ledgerlark.streaming import append_to, arrivals, distinct_texts, text_stream

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("t", T.StringType())])

PAGE = """<html><head><title>x</title></head><body><script>var a="<p>no</p>";</script>
<h1>PART I</h1><p><b>Item 1A. Risk Factors</b></p><p>Body &amp; text</p><p>Body &amp; text</p><div id="s2">Page 7</div><h2>Item 7</h2><p>Later text<br>next line</p>
<table><tr><th>Account</th><th>2022</th><th>2023</th><th>Q1 2021</th></tr><tr><td>Revenue</td><td>(1,000)</td><td>2,000</td><td>5</td></tr><tr><td>Cost</td><td>10</td><td>20</td><td>30</td></tr></table></body></html>"""


def test_json_tolerances(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text('{"a": 1, "t": "x"}\n\nnot json\n{"a": 2}\n')
    assert files.json_rows(spark, str(tmp_path), SCHEMA, strict=False).count() == 2
    assert files.json_rows_audited(spark, str(tmp_path), SCHEMA).cache().where("_parse_error is not null").count() == 1
    with pytest.raises(Exception):
        files.json_rows(spark, str(tmp_path), SCHEMA).collect()
    with pytest.raises(ValueError):
        files.table(spark, "x.bin")


def test_listing_and_main_document(spark, tmp_path):
    for f, n in (("US_ABC_2023_10-K_0000000001-23-000002.html", 10), ("filing-details.html", 99), ("small.htm", 5)):
        (tmp_path / f).write_text("x" * n)
    got = files.listing(spark, str(tmp_path))
    assert got.where("ticker = 'ABC'").first()["accno"] == "0000000001-23-000002"
    assert files.main_documents(got).first()["size"] == 10


def test_companies_and_cik(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ticker,source,market,form_types,years\nA,EDGAR,US,10-K|10-Q,2022|2023\nB,OTHER,US,10-K,2022\n")
    assert files.companies(spark, str(tmp_path / "c.csv")).count() == 4
    row = spark.createDataFrame([("0000000009-23-000001", None, "T"), ("0000000007-23-000001", "CENTRAL INDEX KEY: 55", "T"), ("0000000009-23-000001", None, "Z")], "acc string, head string, tick string")
    cik = files.issuer_cik(F.col("acc"), F.col("head"), {"T": "12"}, F.col("tick"), ["0000000009"])
    assert [r["c"] for r in row.select(cik.alias("c")).collect()] == ["0000000012", "0000000055", None]


def test_html_rows(spark):
    out = html.text_rows(spark.createDataFrame([("f", PAGE), ("g", None)], "file string, html string")).orderBy("position").collect()
    by = {r["text"]: r for r in out}
    assert "var a" not in " ".join(by) and [r["text"] for r in out].count("Body & text") == 1
    assert by["Body & text"]["part"] == "PART I" and by["Body & text"]["item"] == "Item 1A. Risk Factors"
    assert by["Later text"]["heading"] == "Item 7" and by["Later text"]["page"] == 7 and by["Later text"]["anchor"] == "s2"


def test_html_tables(spark):
    cells = html.cells(spark.createDataFrame([("f", PAGE)], "file string, html string"))
    got = {(r["account"], r["header"]): r["value"] for r in html.compact_tables(cells).collect()}
    assert got == {("Revenue", "2023"): 2000.0, ("Revenue", "2022"): -1000.0, ("Cost", "2023"): 20.0, ("Cost", "2022"): 10.0}
    unit, cur = html.unit_of(F.lit("(in millions of US$)"))
    assert cells.select(html.shown_header(F.lit("2023"), unit, cur).alias("h")).first()["h"] == "2023 (USD, millions)"


LINKS = """<linkbase xmlns:x="http://www.w3.org/1999/xlink"><labelLink x:type="extended">
<loc x:type="locator" x:href="a.xsd#us-gaap_Assets" x:label="l1"/><label x:type="resource" x:label="r1" x:role="http://r/label" xml:lang="en-US">Total assets</label><arc x:type="arc" x:from="l1" x:to="r1" x:arcrole="c-label"/></labelLink>
<calc x:type="extended"><loc x:type="locator" x:href="a.xsd#us-gaap_Assets" x:label="p"/><loc x:type="locator" x:href="a.xsd#us-gaap_Cash" x:label="c"/><arc x:type="arc" x:from="p" x:to="c" x:arcrole="summation" order="1" weight="1.0"/></calc></linkbase>"""


def test_linkbase(spark):
    parsed = linkbase.items(spark.createDataFrame([("f", LINKS), ("g", "<broken"), ("h", None)], "file string, xml string"))
    assert [tuple(r) for r in linkbase.labels(parsed).collect()] == [("f", "us-gaap:Assets", "http://r/label", "en-US", "Total assets")]
    assert [tuple(r)[1:] for r in linkbase.arcs(parsed, ["summation"]).collect()] == [("us-gaap:Assets", "us-gaap:Cash", "summation", 1.0, 1.0)]


def test_schemas(spark):
    df = spark.createDataFrame([("f", "a:B", "1.5", "10-K", "2023"), ("f", "nocolon", "x", "10-K", "y"), ("g", "c:D", "2", "ODD", None), ("h", "e:F", "3", None, "nan")], "file string, concept string, numeric_value string, form string, fy string")
    got = schemas.validated(df, "fact").cache()
    assert sorted(p for r in got.collect() for p in r["problems"]) == ["pattern:qname", "type:fy", "type:value_num", "value:form"]
    assert schemas.accepted(got).count() == 2 and schemas.accepted(got, strict=True).count() == 1 and schemas.quarantined(got).count() == 2
    assert {(r["file"], r["status"]) for r in schemas.file_status(got).collect()} == {("f", "fail"), ("g", "fail"), ("h", "ok")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], float("nan"))], "a int, b array<int>, c double")
    sinks.write(df, str(tmp_path), "x", ("parquet", "csv", "json"))
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 1 and spark.read.csv(f"{tmp_path}/x.csv", header=True).first()["b"] == "[1,2]"
    assert "c" not in spark.read.json(f"{tmp_path}/x.json").columns
    sinks.write(df.union(df), str(tmp_path), "x")
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 1  # existing output stays
    for _ in range(2):
        sinks.save_filing(spark, str(tmp_path / "s"), {"facts": df.select("a")}, "f1")
    sinks.save_filing(spark, str(tmp_path / "s"), {"facts": df.select("a", F.lit("n").alias("extra"))}, "f2")
    assert sinks.load_store(spark, str(tmp_path / "s"), "facts").count() == 2
    assert "| 1 |" in sinks.markdown(df.select("a"))
    with pytest.raises(ValueError):
        sinks.save_filing(spark, str(tmp_path), {"zz": df}, "f")


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = [{"file": "f", "text": t, "ts": f"2024-01-01T00:0{i}:00Z", "event_type": "e"} for i, t in enumerate("aab")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = text_stream(spark, str(tmp_path / "in"), "file string, text string, ts timestamp, event_type string")
    append_to(distinct_texts(stream, "file", "text", "ts"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    append_to(arrivals(stream, "ts", "1 minute", "1 minute"), str(tmp_path / "w"), str(tmp_path / "ck2")).awaitTermination(60)


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "US_ABC_2023_10-K_0000000001-23-000002.html").write_text(PAGE)
    done = engine.run_stages(spark, ["listing", "chunks"], str(tmp_path / "in"), str(tmp_path / "out"))
    assert done["listing"] == 1 and done["chunks"] > 1
    chunks = spark.read.parquet(f"{tmp_path}/out/chunks.parquet")
    encode = lambda ts: np.array([[t.lower().count("risk") + 0.1, t.lower().count("text") + 0.1] for t in ts])
    engine.embed(chunks, encode, str(tmp_path / "ix"))
    vectors = spark.read.parquet(f"{tmp_path}/ix/vectors")
    reply = lambda p: {"text": p[:10], "citations": [{"rid": "nope", "quote": "x"}] + [{"rid": r["rid"], "quote": "q " * 300} for r in chunks.limit(1).collect()]}
    full = engine.QueryRequest("risk factors text", "abc", "10-K", 2023, encode=encode, score=lambda ps: np.array([len(d) for _, d in ps], float), answer=reply, context_tokens=5000)
    got = engine.run_query(chunks, vectors, full)
    assert got.records.count() > 0 and got.evidence.count() > 0 and all(len(c["quote"]) <= 240 and c["rid"] != "nope" for c in got.answer["citations"])
    assert engine.run_query(chunks, None, engine.QueryRequest("risk", "zzz")).records.count() == 0
    assert engine.run_query(chunks, None, engine.QueryRequest("risk", "zzz", strict=False)).records.count() > 0
    with pytest.raises(ValueError):
        engine.run_query(chunks, None, engine.QueryRequest(" "))
    with pytest.raises(ValueError):
        engine.run_stages(spark, ["nope"], "", "")


def test_cli_lists_queries(capsys):
    from ledgerlark.cli import main

    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out


def test_entry_works_without_the_optional_part(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "ledgerlark"), tmp_path / "ledgerlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    # a dependency that is missing is no absent part
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_dependency\n")
    bad = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert bad.returncode and "no_such_dependency" in bad.stderr


def test_replies_are_salvaged_and_checked():
    assert engine.salvaged('Sure: {"answer": "x", "confidence": 0.5} done') == {"answer": "x", "confidence": 0.5}
    for bad in ("no json", "{broken", "[1]", "", None):
        assert engine.salvaged(bad) == {"answer": "", "citations": []}
    got = engine.checked('{"answer": "", "citations": [{"rid": "a", "quote": " q "}, {"rid": "b", "quote": "q"}, {"rid": "a"}, 7]}', {"a"})
    assert got == {"answer": engine.NOTHING, "citations": [{"rid": "a", "quote": "q"}]}


def test_no_evidence_no_model_call(spark):
    chunks = spark.createDataFrame([("r", "text", "AB", "10-K", 2023)], "rid string, content string, ticker string, form string, fy int")
    got = engine.run_query(chunks, None, engine.QueryRequest("zzz", answer=lambda p: 1 / 0))
    assert got.answer == {"answer": engine.NOTHING, "citations": []} and got.evidence is None


def test_broken_linkbases_give_what_stands_before():
    from ledgerlark.sources.linkbase import parse_linkbase

    head = '<l xmlns:xlink="http://www.w3.org/1999/xlink"><x xlink:type="extended"><loc xlink:type="locator" xlink:label="a" xlink:href="s.xsd#p_A"/>'
    lab = '<lab xlink:type="resource" xlink:label="b" xlink:role="r" xml:lang="en">R&D &amp; more</lab>'
    whole = parse_linkbase(head + lab + "</x></l>")
    assert [x["kind"] for x in whole] == ["locator", "resource"] and whole[1]["text"] == "R&D & more"
    assert [x["concept"] for x in parse_linkbase(head + "<broken")] == ["p:A"]
    assert parse_linkbase(None) == parse_linkbase("") == parse_linkbase("no xml") == []


def test_index_reader_checks_sizes(spark, tmp_path):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "rid int, vector array<double>")
    sinks.write_index(v, v.select("rid"), str(tmp_path / "ix"))
    assert [x.count() for x in sinks.read_index(spark, str(tmp_path / "ix"))] == [3, 3]
    v.select("rid").limit(2).write.mode("overwrite").parquet(str(tmp_path / "ix" / "meta"))
    with pytest.raises(ValueError, match="3 vectors, 2 metadata"):
        sinks.read_index(spark, str(tmp_path / "ix"))


def test_unfinished_output_is_written_again(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    sinks.write(df, str(tmp_path), "x")
    (tmp_path / "x.parquet" / "_SUCCESS").unlink()
    sinks.write(df.union(df), str(tmp_path), "x")
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 2


def test_stages_one_by_one(spark, tmp_path):
    src, out = tmp_path / "in" / "ABC" / "2023", str(tmp_path / "out")
    src.mkdir(parents=True)
    (src / "US_ABC_2023_10-K_0000000001-23-000002.html").write_text(PAGE)
    (src / "facts.jsonl").write_text('{"concept": "ll:A", "numeric_value": "5"}\n\n{"concept": "NoColon"}\n')
    (src / "calculation.jsonl").write_text('{"parent": "a", "child": "b", "weight": "1"}\n')
    encode = lambda ts: np.ones((len(ts), 2))
    done = engine.run_stages(spark, ["listing", "postprocess", "parse", "clean", "index", "chunk", "embed"], str(tmp_path / "in"), out, encode=encode)
    assert done["postprocess"] == 1 and done["parse"] > 1 and done["clean"] > 0 and done["chunk"] == done["embed"] > 0 and done["index"] == 2
    status = {r["model"]: (r["status"], r["n_rows"]) for r in spark.read.parquet(f"{out}/status.parquet").collect()}
    assert status == {"fact": ("fail", 2), "calculation_edge": ("ok", 1)}
    with pytest.raises(ValueError, match="encoder"):
        engine.run_stages(spark, ["embed"], str(tmp_path), out)


def test_cli_flags_reach_the_request():
    from ledgerlark.cli import parser, request

    a = parser().parse_args("query risk --chunks c --index i --bm25-topk 5 --dense-topk 6 --ce-candidates 7 --ce-weight 0.1 --rrf-k 9 --w-bm25 1 --w-dense 3 --max-context-tokens 99 --encoder json:dumps --loose".split())
    r = request(a)
    assert (r.bm25_topk, r.dense_topk, r.candidates, r.ce_weight, r.k, r.w_bm25, r.w_dense, r.context_tokens, r.strict) == (5, 6, 7, 0.1, 9.0, 1.0, 3.0, 99, False) and r.encode is json.dumps
    assert parser().parse_args(["embed", "--out", "o"]).command == "embed"
