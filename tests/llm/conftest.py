"""Documents with the awkward cases that every operator must define."""

import random

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, ids out of order."""
    rng = random.Random(11)
    words = "the of and token alpha beta gamma delta licence Idiot über ñandú".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(12)]
    rows = [(i * 7 % 60, base[i % 12] + ("" if i % 3 else " tail"), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    rows += [(60, None, None, None), (61, "", "en", "s0"), (62, "   \n", "en", "s0"), (63, base[0].upper(), "en", "s1"), (64, "word " * 60_000, "en", "s1")]
    rows += [(65, "a b", "en", "s1"), (65, "a b", "en", "s1"), (None, base[1], "de", "s2"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with an extra column whose name operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in odd_rows], "doc_id long, text string, lang string, source string, rid int, body string, `key` int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
