"""Expressions against hand-made cases and plain-Python models."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import keys as ks
from ledgerlark.functions import numbers as nu
from ledgerlark.functions import periods as pe
from ledgerlark.functions import text as tx
from ledgerlark.operators.chunker import split_units


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


V = None


@pytest.fixture(autouse=True)
def value_column(spark):
    """Columns need a session, so the shared one is made here."""
    global V
    V = F.col("v")


def test_tokens_drop_stop_words_and_single_letters(spark):
    assert column(spark, ["The cost of $3.5m, A x risk-free", None, ""], tx.tokens(V)) == [["cost", "$3.5m", "risk-free"], [], []]


def test_units_equal_the_python_model(spark):
    texts = ["One. Two! x; y: z", "• bullet. stays\n(a) also; stays\nplain – dash", "", None, "1. item one. two\nno end", "a — b\r\n\r\n  c? d "]
    assert column(spark, texts, tx.units(V)) == [split_units(t or "") for t in texts]


def model_window(raw, terms, size=700):
    t = re.sub("\n", " ", raw or "").strip()
    if len(t) <= size:
        return t
    words = t.split()
    hit = [w.strip("():;,.").lower() in terms for w in words]
    best, left = -1, 0
    for p in [i for i, h in enumerate(hit) if h]:
        lo = max(0, p - 20)
        n = sum(hit[lo : p + 20])
        if n > best:
            best, left = n, lo
    return t[:size] if best < 0 else " ".join(words[left : left + 80])[:size]


def test_best_window_equals_the_python_model(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "beta,", "(risk)", "Token.", "gamma", "delta"]) if rng.random() < 0.3 else "filler" + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 300))) for _ in range(40)] + [None, "short token"]
    terms = F.array(F.lit("risk"), F.lit("token"))
    assert column(spark, texts, tx.best_window(V, terms)) == [model_window(t, {"risk", "token"}) for t in texts]


@pytest.mark.parametrize("text,want", [("(1,234.5)", -1234.5), ("$3.2M", 3.2e6), ("12%", 12.0), ("-5", -5.0), ("2 B", 2e9), ("1.5t", 1.5e12), ("n/a", None), ("", None), (None, None), ("1 2", None)])
def test_human_numbers(spark, text, want):
    got = column(spark, [text], nu.human_number(V))[0]
    assert got == (pytest.approx(want) if want is not None else None)


def test_number_tokens():
    got = nu.amounts("Paid $3.5 million in 5 months, 12 m over the next 3 months; see Rule 12b-2 and Section 13(a). Total 1,234")
    assert [(a["raw"], a["value"], a["currency"]) for a in got][:3] == [("$3.5 million", 3.5e6, "USD"), ("5 m", 5.0, None), ("12 m", 12.0, None)]
    assert got[-1]["value"] == 1234 and all("12b" not in a["raw"] for a in got)
    assert nu.amounts("5 men")[0]["value"] == 5e6 and len(nu.amounts("on 2024-01-31")) == 3
    assert nu.amounts(None) == [] and nu.union_spans([(5, 7), (1, 3), (3, 4)]) == [(1, 4), (5, 7)]


def test_number_features(spark):
    assert column(spark, ["5% and 2.5 %", None], nu.percents(V)) == [[0.05, 0.025], []]
    assert column(spark, ["$5, 3 RMB, usd", "¥¥9"], nu.currencies(V)) == [["CNY", "USD"], ["CNY", "JPY"]]
    assert column(spark, ["P1Y2M3D and P30D"], nu.iso_days(V)) == [[428, 30]]
    assert column(spark, ["inf", "-3", "2.0", "x", None], nu.decimals(V)) == [None, -3, 2, None, None]


def test_short_values_follow_python(spark):
    values = [0.0625, 1234.5, 1.5e6, 2.25e9, 3e12, 0.1, None]
    assert column(spark, values, nu.short_value()(V), "double") == ["0.0625", "1.234K" if f"{1.2345:.3f}" == "1.234" else "1.235K", "1.500M", "2.250B", "3000.000B", "0.1", None]
    assert column(spark, [3e12], nu.short_value(True)(V), "double") == ["3.000T"]


@pytest.mark.parametrize("day,fye,want", [("2023-09-30", "--09-30", "Q4"), ("2023-10-01", "--09-30", "Q4"), ("2023-10-02", "--09-30", "Q1"), ("2023-12-31", "--09-30", "Q1"), ("2023-03-31", "--12-31", "Q1"), ("2023-05-01", None, "Q2"), ("2023-05-01", "--02-29", None), ("bad", "--12-31", None)])
def test_fiscal_quarters(spark, day, fye, want):
    assert column(spark, [day], pe.fiscal_quarter(F.lit(None).cast("string"), V, F.lit(None).cast("string"), F.lit(fye).cast("string"))) == [want]


def test_periods(spark):
    no = F.lit(None).cast("string")
    assert column(spark, ["2023-06-30", None], pe.period_label(F.lit("2023-01-01"), V, no, F.lit(2023))) == ["FY2023 2023-01-01→2023-06-30", "FY2023 2023-01-01→?"]
    assert column(spark, ["2023-06-30", None], pe.period_label(no, no, V)) == ["instant 2023-06-30", None]
    assert column(spark, ["2023-06-30", None], pe.parsed_period_label(no, V, no, F.lit(None))) == ["FY? ? — 2023-06-30", None]
    assert column(spark, ["Q3 2024", "2023 current", "Current", "prior 2022", "none"], pe.header_weight(V)) == [20243, 20230, 3000, 21220, 0]


def test_signatures_and_ids(spark):
    dims = F.create_map(F.lit("b"), V, F.lit("a"), F.lit("1"), F.lit("a0"), F.lit("2"))
    assert column(spark, ["x"], ks.dims_signature(dims)) == ["a=1|a0=2|b=x"]
    want = int.from_bytes(hashlib.blake2b(b"k", digest_size=8).digest(), "big") & (1 << 63) - 1
    assert column(spark, ["k"], ks.stable_id(V)) == [want]
    assert column(spark, ['{"period": {"start_date": "2020-01-01", "end": "2020-12-31"}}', "nope", None], ks.context_period(V)["end"]) == ["2020-12-31", None, None]


def test_text_predicates(spark):
    lines = ["NOTE 4", "Item 1A. Risk", "lower case text", "Note 12 leases", "Net Income", "--", ""]
    assert column(spark, lines, tx.is_heading(V)) == [True, True, False, True, True, False, False]
    assert column(spark, lines, tx.is_noise(V)) == [False, False, False, False, False, True, True]
    assert column(spark, ["Page 3", "short", "costs 5", "Signatures"], tx.is_noise(V, False)) == [False, True, False, False]
    assert column(spark, ["0000123456-24-000001::text::chunk-12", "x"], tx.chunk_no(V)) == [12, None]


def test_titles_roles_and_languages(spark):
    assert column(spark, ["Risk", None, "  "], tx.title(V, F.lit("ABC"), F.lit("10-K"), F.lit(2023))) == ["Risk [ABC 10-K FY2023]", "Untitled [ABC 10-K FY2023]", "Untitled [ABC 10-K FY2023]"]
    assert column(spark, ["http://x/role/terseLabel", "http://x/role/label", "http://x/negatedLabel", None, "documentation"], tx.role_name(V)) == ["terse", "standard", "negatedLabel", "standard", "documentation"]
    assert column(spark, ["en-us", "EN", "zh-CN", "fr", " ", None], tx.lang_tag(V)) == ["en-US", "en", "zh", "fr", None, None]


def test_sentences(spark):
    got = column(spark, ["A b. C d! e。 f", "3.5 stays", None], tx.sentences(V))
    assert got == [["A b.", "C d!", "e.", "f"], ["3.5 stays"], []]
    assert re.split(r"\s", "a b") == ["a", "b"]


def test_search_tokens(spark):
    assert column(spark, ["Net Income (Loss), 5%", "  ", None], tx.search_tokens(V, F.lit("A/B"))) == ["net income loss 5% a/b", "a/b", "a/b"]
    assert column(spark, ["()", None], tx.search_tokens(V)) == [None, None]
