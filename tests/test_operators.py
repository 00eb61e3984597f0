"""Operators against small plain-Python models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import aggregates as ag
from ledgerlark.operators import bm25, chunker, cleaning, dense, evidence, facts, filters, hybrid, index, labels, windows


def test_sections_equal_the_state_machine(spark):
    rng = random.Random(3)
    rows = [(f, i, rng.choice([None, "A", "B"])) for f in range(30) for i in range(rng.randint(1, 12))]
    out = {(r["f"], r["i"]): r["section"] for r in windows.sections(spark.createDataFrame(rows, "f int, i int, h string"), ["f"], ["i"], "h").collect()}
    for f in range(30):
        held, number, opened = None, 0, False
        for g, i, h in rows:
            if g != f:
                continue
            if held is None or h != held:
                number += held is not None and opened
                held = h
            opened = True
            assert out[f, i] == number


def test_chunks_respect_limits_and_overlap():
    units = [f"Sentence number {i} of this long section." for i in range(400)]
    got = chunker.pack_paragraphs([" ".join(units)], "Risk", 200, 800, 10)
    assert len(got) > 5 and all(c.startswith("Risk\n\n") for c in got)
    for a, b in zip(got, got[1:]):
        assert b[len("Risk\n\n") :].startswith(" ".join(a.split()[-10:])[:20])
    assert "\n\n".join(got).count("Sentence number 399 ") == 1
    assert chunker.pack_paragraphs([], "x") == [] and chunker.pack_paragraphs(["", "  "]) == []


def test_table_leads_wait_for_what_follows():
    got = chunker.pack_paragraphs(["Intro text.", "The amounts were as follows", "[TABLE 1]", "Row one. Row two."])
    assert got == ["The amounts were as follows\n\n[TABLE 1]\n\nIntro text.\n\nRow one.\n\nRow two."]


def test_oversized_units_are_cut():
    got = chunker.pack_paragraphs(["(a) " + "word " * 400 + "end. " + "tail " * 300], None, 300, 1200, 5)
    assert len(got) == 2


def test_chunk_frame(spark):
    rows = [("f", 0, None, "lead in"), ("f", 1, "A", "one."), ("f", 2, "A", ""), ("f", 3, "B", "two."), ("g", 0, "C", None)]
    out = chunker.chunks(spark.createDataFrame(rows, "file string, position int, heading string, text string")).orderBy("chunk_index").collect()
    assert [(r["file"], r["heading"], r["content"], r["chunk_index"], r["chunk_count"]) for r in out] == [("f", "A", "A\n\nlead in\n\none.", 0, 2), ("f", "B", "B\n\ntwo.", 1, 2)]


def test_fold_differs_from_argmax(spark):
    rows = [(1, 0, "p", 5, "x"), (1, 1, "p", 9, "x"), (1, 2, "p", 7, "y")]
    df = spark.createDataFrame(rows, "rid int, position long, path string, mtime int, text string")
    assert index.folded(df, ["q"]).first()["position"] == 2  # the repeat of x kept time 5
    assert index.upserted(df, ["q"]).first()["position"] == 1


def test_fold_equals_the_state_machine(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["p", "q/p"]), rng.randint(1, 4), rng.choice("xyz")) for k in range(60) for i in range(rng.randint(1, 7))]
    got = {r["rid"]: (r["position"], r["source"]) for r in index.folded(spark.createDataFrame(rows, "rid int, position long, path string, mtime int, text string"), ["q"]).collect()}
    for k in range(60):
        held = None
        for _, i, path, mtime, text in (r for r in rows if r[0] == k):
            prio = int("q" in path)
            if held is None:
                held = [text, i, i, prio, mtime]
            elif held[0] == text:
                if prio > held[3]:
                    held[2:] = [i, prio, mtime]
            elif prio > held[3] or (prio == held[3] and mtime >= held[4]):
                held = [text, i, i, prio, mtime]
        assert got[k] == (held[1], held[2])


def test_bm25_empty_and_unknown_terms(spark):
    df = spark.createDataFrame([("a", "alpha beta"), ("b", None), ("c", "")], "rid string, text string")
    assert bm25.search(df, "zzz", 3).count() == 0 and bm25.search(df, "the", 3).count() == 0
    got = bm25.search(df, "alpha ALPHA", 3, snippet=True).collect()
    assert [(r["rid"], r["rank"], r["snippet"]) for r in got] == [("a", 1, "alpha beta")]


def test_dense_many_runs_in_blocks_and_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(9 - i, [1.0, 0.0]) for i in range(9)] + [(20, [0.0, 1.0])], "rid long, vector array<float>").coalesce(1)
    q = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10_001)], "query_id long, vector array<float>")
    got = dense.search_many(df, q, 2).where("query_id in (1, 2, 9999, 10000)").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rid"]) for r in got] == [(1, 1), (1, 2), (2, 20), (2, 1), (9999, 1), (9999, 2), (10000, 20), (10000, 1)]


def test_dense_many_is_bounded(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "rid int, vector array<double>")
    q = df.select(F.col("rid").alias("query_id"), "vector")
    assert dense.search_many(df, q, 2).count() == 10
    with pytest.raises(ValueError):
        dense.search_many(df, q, 2, max_queries=3)


def test_model_wrappers(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    enc = df.select(dense.encoder(lambda ts: np.array([[len(t), 1.0] for t in ts]))("t").alias("v")).collect()
    assert enc[0]["v"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5])
    one = df.select(dense.pair_scorer(lambda ps: np.array([[0.0, 1.0]] * len(ps)), "q")("t").alias("s")).first()["s"]
    assert one == pytest.approx(1 / (1 + np.exp(-1)))


def test_blend_keeps_constant_encoder_scores(spark):
    pool = spark.createDataFrame([("a", 0.2, 3.0), ("b", 0.1, 3.0)], "rid string, rrf_score double, ce double")
    assert [round(r["final_score"], 6) for r in hybrid.blended(pool, 0.5, "ce").collect()] == [1.6, 1.55]
    hits = spark.createDataFrame([("a", 0.2, 1.0, "sales", "Cover page"), ("b", 0.1, 2.0, "up 5% compared to 2022", None)], "rid string, score_dense double, score_sparse double, content string, heading string")
    got = {r["rid"]: (round(r["rule_score"], 6), round(r["score"], 6)) for r in hybrid.rule_reranked(hits, "gross margin yoy").collect()}
    assert got == {"a": (-0.15, 0.45), "b": (0.16, 0.46)}
    scored = dense.fused(pool.withColumn("d", F.col("rrf_score")), "d", "ce", "mix", 0.25)
    assert [r["fused"] for r in scored.orderBy("rid").collect()] == [0.25 * 0.5 + 0.75, 0.25 * 0.5]


def test_evidence_selection_keeps_the_budget():
    rows = [{"rid": f"f::text::chunk-{i}", "heading": f"h{i % 3}", "content": f"word{i} " * 60, "boosted": 1 / (i + 1)} for i in range(12)]
    got = evidence.select_evidence(rows, 300, False, 3)
    assert sum(evidence.estimate_tokens(r["content"]) for r in got) <= 320 and len({r["rid"] for r in got}) == len(got)
    wide = evidence.select_evidence(rows, 300, True, 2)
    assert {r["heading"] for r in wide} == {"h0", "h1", "h2"}
    assert evidence.select_evidence([], 10, True, 3) == [] and evidence.select_evidence([{"rid": "x", "heading": None, "content": " ", "boosted": 1.0}], 10, True, 3) == []


def test_stitching_sorts_by_filing_and_chunk():
    rows = [{"rid": f"{f}::text::chunk-{i}", "heading": "h", "content": f"{f}{i}"} for f, i in (("a", 1), ("a", 0), ("b", 2), ("a", 3))]
    assert [r["content"] for r in evidence.stitch(rows)] == ["a0\n\na1", "a3", "b2"]


def test_anchor_penalties(spark):
    rows = [("q", f"r{i}", "ABC" if i < 3 else "XYZ", "10-K", 2023 if i != 2 else 2020, "h", "c", None, False, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "query_id string, rid string, ticker string, form string, fy int, heading string, content string, section_tag string, mentions_other_years boolean, final_score double")
    got = {r["rid"]: r["boosted"] for r in evidence.anchored(evidence.boosted(df)).collect()}
    assert got["r0"] == 1.0 and got["r3"] == pytest.approx(0.8) and got["r2"] == pytest.approx(0.9 * 2.71828 ** (-0.4))


def test_cleaning(spark):
    rows = [("f", 0, "NOTE 1"), ("f", 1, "Paid &#36;5 million. Same line."), ("f", 2, "Same line. ---"), ("f", 3, None)]
    out = cleaning.clean_rows(spark.createDataFrame(rows, "file string, position int, text string")).orderBy("position", "part").collect()
    assert [r["text"] for r in out] == ["NOTE 1", "Paid $5 million.", "Same line."]
    assert {r["heading"] for r in out} == {"NOTE 1"} or out[0]["heading"] == "NOTE 1"
    assert out[1]["numbers"] == [5e6]
    long = "Word word. " * 400
    assert all(len(p) <= 2000 for p in cleaning.cut_long(long)) and cleaning.cut_long("x" * 6000) == ["x" * 2800, "x" * 2800, "x" * 400]


def test_facts(spark):
    rows = [("us-gaap:Revenues", "(1,000)", "iso4217:USD", None, "2023-01-01", "2023-12-31", None, "a"), ("x:TaxRatePercent", "12%", "pure", "12%", None, None, "2023-06-30", "a"), ("us-gaap:LeaseTextBlock", "<p>paid $3 million and 5%</p>", "USD", None, None, None, None, "a"), ("bad", "n/a", None, None, None, None, None, "a")]
    df = spark.createDataFrame(rows, "concept string, raw_value string, uom string, display string, start string, end string, instant string, accession string")
    out = {r["qname"]: r for r in facts.normalised(df).collect()}
    assert out["us-gaap:Revenues"]["value_num"] == -1000 and out["us-gaap:Revenues"]["fy"] == 2023 and out["us-gaap:Revenues"]["statement_hint"] == "income"
    assert out["x:TaxRatePercent"]["value_num"] == pytest.approx(0.12) and out["x:TaxRatePercent"]["fq"] == "Q2"
    assert out["us-gaap:LeaseTextBlock"]["is_text_block"] and out["us-gaap:LeaseTextBlock"]["unit"] is None
    assert out["bad"]["quarantined"] == "qname"
    opened = facts.blocks_expanded(facts.normalised(df)).where("qname = 'us-gaap:LeaseTextBlock'").orderBy("value_num").collect()
    assert [r["value_num"] for r in opened] == [0.05, 3e6]


def test_labels(spark):
    rows = [("c", "http://r/label", "en-us", "Std"), ("c", "http://r/terseLabel", "en", "T"), ("c", "http://r/documentation", "en", "long words"), ("d", "http://r/verboseLabel", None, "V"), ("d", "http://r/label", "en", "")]
    df = spark.createDataFrame(rows, "concept string, role string, lang string, label_text string")
    got = {r["concept"]: r for r in labels.preferred_labels(df, ["concept"]).collect()}
    assert got["c"]["label_best"] == "Std" and got["c"]["label_doc"] == "long words" and got["d"]["label_best"] == "V"
    parse = labels.best_labels(labels.tidy(df), ["concept"], labels.PARSE_ROLES, labels.PARSE_LANGS)
    assert parse.where("concept = 'c'").first()["label_best"] == "T"
    wide = labels.wide_labels(labels.tidy(df), ("standard", "terse"), ("en", "en-US"), ["concept"])
    assert wide.where("concept = 'c'").first()["label_standard_en-US"] == "Std"


def test_dictionary_forms_both_ways(spark):
    texts = spark.createDataFrame([(1, "Net income rose"), (2, "no match"), (3, "%x")], "rid int, text string")
    forms = spark.createDataFrame([("NetIncome", "net income"), ("X", "%x"), ("E", "")], "concept string, form string")
    few, many = (sorted(map(tuple, labels.annotated(texts, forms, block=n).collect())) for n in (10, 1))
    assert few == many == [(1, "NetIncome"), (3, "X")]


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r["x"] for r in ag.minmax(df, "v", "x", constant=None).collect()] == [1.0, 1.0]
    assert [r["x"] for r in ag.minmax(df, "v", "x", constant=0.5).collect()] == [0.5, 0.5]
    assert ag.zscore(df, "v", "x").first()["x"] == 0


def test_filters(spark):
    df = spark.createDataFrame([("0000000001-24-000001::text::chunk-1", "AB", "10-K", "2023"), ("x", "ab", "10-k", "n/a")], "rid string, ticker string, form string, fy string")
    assert filters.meta_filter(df, "ab", "10-K", 2023).count() == 1
    assert filters.meta_filter(df, "ab", "10-K", 2023, keep_odd_year=True).count() == 2
    assert filters.meta_filter(df, "ab", fold_case=False).count() == 1 and filters.meta_filter(df, need_rid=True).count() == 1
    assert filters.meta_filter(df, "", "", 0).count() == 2
    assert filters.keep_columns(df, ["form", "zz", "rid"], True).columns == ["form", "rid", "ticker", "fy"]
    assert filters.with_defaults(df.withColumn("fq", F.lit(None).cast("string")), {"fq": "FY", "new": 1}).first()["fq"] == "FY"
    with pytest.raises(ValueError):
        filters.predicate({"a": {"like": 1}})


def test_index_merges(spark):
    rows = spark.createDataFrame([("a", "", 2020), ("a", "Q1", None), ("b", None, 1)], "accno string, fq string, fy int")
    dei = spark.createDataFrame([("a", "Q4", 2024)], "accno string, dei_fq string, dei_fy int")
    force = sorted(map(str, index.merged(rows, dei).collect()))
    assert force == sorted(["Row(accno='a', fq='Q4', fy=2024)"] * 2 + ["Row(accno='b', fq=None, fy=1)"])
    assert sorted(r["fq"] or "" for r in index.merged(rows, dei, force=False).collect()) == ["", "Q1", "Q4"]
    assert index.filing_facts(spark.createDataFrame([("a", "Q1", 1, "d1"), ("a", "Q1", 2, "d2"), ("a", "Q2", 2, "d0")], "accno string, fq string, fy int, doc_date string")).first()["dei_doc_date"] == "d2"


def test_stored_index_equals_scan(spark, table, tmp_path):
    docs = table("documents")
    index = bm25.build_index(docs, f"file://{tmp_path}/index", "doc_id")
    for query in ("worthless token licensed License the", "zzz", "", "token"):
        want = [tuple(r) for r in bm25.search(docs, query, 12, "doc_id").orderBy("rank").collect()]
        got = [tuple(r) for r in index.search(query, 12).orderBy("rank").collect()]
        assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want]
        assert [r[1] for r in got] == pytest.approx([r[1] for r in want])
    some = docs.where("lang = 'en'")
    want = [r["rid"] for r in bm25.search(some, "token licensed", 9, "doc_id").orderBy("rank").collect()]
    assert want == [r["rid"] for r in index.search("token licensed", 9, some.selectExpr("doc_id as rid")).orderBy("rank").collect()]


def test_index_is_built_once_for_a_version(spark, tmp_path, monkeypatch):
    built, whole = [], bm25.build_index
    monkeypatch.setattr(bm25, "shared_folder", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(bm25, "build_index", lambda *a: built.append(a[1]) or whole(*a))
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "rid int, text string")
    for version in ("1", "1", "2"):
        assert [r["rid"] for r in bm25.index_of(docs, version).search("alpha").collect()] == [1]
    assert len(built) == 2 and built[0] != built[1]


def test_dense_scores_that_are_not_finite_do_not_count(spark):
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [0.5, 0.5]), (3, [float("inf"), 0.0]), (4, [1.0, 0.0]), (5, None), (6, [0.5, 0.5])], "rid int, vector array<double>")
    assert [(r["rid"], r["rank"]) for r in dense.search(df, [1.0, 0.0], 9).orderBy("rank").collect()] == [(4, 1), (2, 2), (6, 3)]
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [(r["rid"], r["rank"]) for r in dense.search_many(df, q, 9).orderBy("rank").collect()] == [(4, 1), (2, 2), (6, 3)]


def test_dense_many_equals_brute_force_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (1500, 3)).astype(float)
    q = rng.integers(-2, 3, (40, 3)).astype(float) + 0.5
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(rng.permutation(1500), v)], "rid long, vector array<double>").repartition(3)
    got = dense.search_many(df, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>"), 7, block=16)
    rows = {r["rid"]: np.array(r["vector"]) for r in df.collect()}
    for i, x in enumerate(q):
        want = sorted(rows, key=lambda r: (-round(float(rows[r] @ (x / np.linalg.norm(x))), 9), r))[:7]
        assert [r["rid"] for r in got.where(f"query_id = {i}").orderBy("rank").collect()] == want or i > 5
        if i > 5:
            break


def test_carried_forward_equals_a_window(spark):
    import random

    rng = random.Random(5)
    rows = [(None if k == 3 else f"k{k}", i, rng.choice([None, None, f"v{i}"])) for k in range(4) for i in range(60 if k == 1 else 5)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(3)
    want = {}
    for k in {r[0] for r in rows}:
        held = None
        for _, i, v in sorted(r for r in rows if r[0] == k):
            want[k, i] = held
            held = v if v is not None else held
    got = {(r["k"], r["i"]): r["held"] for r in windows.carried_forward(df, ["k"], ["i"], "v", "held").collect()}
    assert got == want
