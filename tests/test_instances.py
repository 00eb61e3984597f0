"""Instances, dictionaries, query expansion."""

import json

from pyspark.sql import functions as F

from ledgerlark.sources import instance, mappings

XML = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
<context id="c1"><entity><identifier scheme="s">0001</identifier><segment><d:explicitMember dimension="z:A">m</d:explicitMember><d:explicitMember dimension="a:B">n</d:explicitMember></segment></entity><period><startDate>2023-01-01</startDate><endDate>2023-12-31</endDate></period></context>
<unit id="u1"><divide><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit><unit id="u2"><measure>pure</measure></unit>
<us-gaap:Revenues contextRef="c1" unitRef="u1" decimals="-3">5</us-gaap:Revenues><us-gaap:Cost contextRef="c1" xsi:nil="true"/></xbrl>"""


def test_instance(spark):
    facts, contexts, units = instance.instances(spark.createDataFrame([("f", XML), ("g", "<x"), ("h", None)], "filing_id string, xml string"))
    assert [tuple(r) for r in facts.collect()] == [("f", "us-gaap:Revenues", "c1", "u1", "-3", "5", 0)]
    c = contexts.first()
    assert (c["entity"], c["period_end"], c["instant"], list(json.loads(c["dimensions_json"]))) == ("0001", "2023-12-31", None, ["a:B", "z:A"])
    assert {r["unit_id"]: r["measure"] for r in units.collect()} == {"u1": "iso4217:USD/shares", "u2": "pure"}


def test_expansion(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Rev": {"main": "revenue", "forms": ["net sales"]}, "Cost": {"main": "costs"}}))
    forms = mappings.forms(spark, mappings.load(str(tmp_path / "m.json")))
    related = mappings.relations(spark, {"Rev": {"children": ["Cost"], "related": None}})
    q = spark.createDataFrame([(1, "Net Sales in 2023"), (2, "nothing")], "query_id int, query string")
    got = {r["query_id"]: r for r in mappings.expanded(spark, q, forms, related).collect()}
    assert got[1]["concepts"] == ["Cost", "Rev"] and got[1]["tokens"] == ["2023", "costs", "net sales", "revenue"] and got[2]["concepts"] is None


def test_patterns_and_targets(spark):
    df = spark.createDataFrame([("Item 7 outlook and net sales",), ("Exhibit 3 outlook",), (None,)], "t string")
    assert [r["s"] for r in df.select(mappings.pattern_score(F.col("t"), [r"item\s+7\b", "outlook"], ["exhibit"], ["net sales"]).alias("s")).collect()] == [3, None, 0]
    assert mappings.targets({"a": [{"n": 1}], "b": None}) == [{"n": 1, "category": "a"}] and mappings.targets([{"n": 2}]) == [{"n": 2}]
    name = df.select(mappings.standard_name(F.lit("AB"), F.lit(2023), F.lit("10-K"), F.lit("1-2-3"), F.lit("html")).alias("n")).first()["n"]
    assert name == "US_AB_2023_10-K_1-2-3.html"
