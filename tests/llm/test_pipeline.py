import json

import numpy as np

import corpus_pipeline as p
from ledgerlark.llm import registry
from ledgerlark.llm.exact_dedup import normalise
from ledgerlark.llm.secret_scan import Scanner
from ledgerlark.llm.simhash import fingerprint


def test_stages_and_registration():
    assert [n for n, _ in p.STAGES] == ["language ID", "exact dedup", "near dedup", "secret scans", "best-fit packing"]
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_each_stage_against_brute_force(spark, table):
    docs, columns = table("documents"), table("documents").columns
    known = p.known_language(spark, docs, "")
    assert known.columns == columns and known.count() == docs.count()  # all clean

    once = p.drop_exact_copies(spark, known, "")
    groups = {}
    for r in known.collect():
        groups.setdefault(normalise(r["text"]), []).append(r["doc_id"])
    assert once.columns == columns and set(rows_of(once)) == {max(g) for g in groups.values()}

    apart = p.drop_near_copies(spark, once, "")
    fps = {i: fingerprint(r["text"]) for i, r in rows_of(once).items()}
    left, keep = set(fps), set()
    while left:
        start = min(left)
        seen, todo = {start}, [start]
        while todo:
            a = fps[todo.pop()]
            new = {j for j in left - seen if bin(a ^ fps[j]).count("1") <= 4}
            seen |= new
            todo += new
        keep.add(start)
        left -= seen
    assert apart.columns == columns and set(rows_of(apart)) == keep

    masked = p.mask_secrets(spark, apart, "")
    scan, before = Scanner(), rows_of(apart)
    assert masked.columns == columns
    for i, r in rows_of(masked).items():
        spans = scan.base(before[i]["text"]) + scan.entropy(before[i]["text"])
        assert ("[SECRET]" in r["text"]) == bool(spans) and not scan.base(r["text"])
        if not spans:
            assert r == before[i]

    packed = p.pack_sequences(spark, masked, "").collect()
    assert {r["doc_id"] for r in packed} == keep
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= -(-total // 4096) + 1


def test_odd_rows_pass(spark, odd, none):
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars")
    out = docs
    for _, stage in p.STAGES:
        out = stage(spark, out, "")
    ids = [r["doc_id"] for r in out.select("doc_id", "piece").where("piece = 0").collect()]
    assert ids and 60 not in ids and 61 not in ids and 62 not in ids and ids.count(65) <= 1
    out = none.selectExpr("doc_id", "text", "lang", "source", "cast(0 as long) n_chars")
    for _, stage in p.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0


def test_unknown_text_goes_clean_text_stays(spark, table):
    docs = table("documents")
    extra = spark.createDataFrame([(9001, "123 456 --", "en", "s", 9), (9002, None, None, "s", 0)], docs.schema)
    ids = rows_of(p.known_language(spark, docs.union(extra), ""))
    assert 9001 not in ids and 9002 not in ids and len(ids) == docs.count()
    assert json.dumps(p.ORACLE_SQL) == "null" and np.size(p.STAGES) == 10


def test_unlearned_languages_go_mixed_ones_stay(spark, table):
    docs, rng = table("documents"), np.random.default_rng(3)
    noise = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60))
    greek = "\u03b7 \u03b3\u03bb\u03ce\u03c3\u03c3\u03b1 \u03c4\u03bf\u03c5 \u03ba\u03b5\u03b9\u03bc\u03ad\u03bd\u03bf\u03c5 \u03b4\u03b5\u03bd \u03b5\u03af\u03bd\u03b1\u03b9 \u03b3\u03bd\u03c9\u03c3\u03c4\u03ae " * 5
    parts = {}
    for r in docs.orderBy("doc_id").collect():
        if r["lang"] and r["text"] and len(r["text"]) > 400:
            parts.setdefault(r["lang"], r["text"][:400])
    assert len(parts) == 4
    rows = [(9001, noise), (9002, greek), (9003, "\u4e2d\u6587\u6587\u672c " * 30), (9004, " ".join(parts.values()))]
    extra = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], docs.schema)
    ids = rows_of(p.known_language(spark, docs.union(extra), ""))
    assert set(ids) & {9001, 9002, 9003, 9004} == {9004} and len(ids) == docs.count() + 1


def test_other_columns_keep_their_names(spark):
    """Columns named like those the stages use inside pass through, repeated ids too."""
    rows = [(1, "The cat sat on the mat and the dog ran", "en", 5, 6), (1, "the CAT sat on the mat and the dog ran", "en", 7, 8), (2, None, None, 1, 2)] + [(i, f"plain words of a text number {'abcdefghij'[i]} here", "en", i, i) for i in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, row_ int")
    out = docs
    for _, stage in p.STAGES[:4]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
    assert sorted(r["row"] for r in p.drop_exact_copies(spark, docs, "").collect() if r["doc_id"] == 1) in ([5], [7])


def test_share_is_a_parameter(spark, table, monkeypatch):
    docs = table("documents")
    monkeypatch.setattr(p, "KNOWN_SHARE", 1.1)
    assert p.known_language(spark, docs, "").count() == 0
