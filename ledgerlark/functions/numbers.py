"""Numbers, units and their display."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import array_of

SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
SIGNS = {"$": "USD", "£": "GBP", "¥": "CNY", "€": "EUR"}


def percents(text: Column) -> Column:
    """Values before percent signs, as fractions."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1))
    return F.transform(found, lambda v: v.cast("double") / 100)


def currencies(text: Column) -> Column:
    """Sorted distinct currency codes, from signs and from code words."""
    t = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(F.upper(t), F.lit(r"\b(USD|RMB|JPY|GBP|EUR|CNY)\b"), F.lit(1)), lambda w: F.when(w == "RMB", "CNY").otherwise(w))
    signs = F.array(*[F.when(t.contains(s), F.lit(c)) for s, c in SIGNS.items()], F.when(t.contains("¥¥"), F.lit("JPY")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(words, signs), lambda c: c.isNotNull())))


def iso_days(text: Column) -> Column:
    """ISO durations in days: 365 a year, 30 a month."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bP(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?\b"), F.lit(0))
    part = lambda d, u: F.coalesce(F.nullif(F.regexp_extract(d, f"(?i)([0-9]+){u}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.transform(found, lambda d: part(d, "Y") * 365 + part(d, "M") * 30 + part(d, "D"))


def human_number(text: Column) -> Column:
    """``(1,234.5)``, ``$3.2M``, ``12%`` to a double; parentheses are negative and
    a percent sign is only dropped.  Null where nothing parses."""
    t = F.trim(text)
    shape = r"^\(?\s*([-+]?)\s*[$€£¥]?\s*([0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)\s*([KkMmBbTt]?)\s*%?\s*\)?$"
    digits = F.nullif(F.regexp_replace(F.regexp_extract(t, shape, 2), ",", ""), F.lit("")).try_cast("double")
    unit = F.upper(F.regexp_extract(t, shape, 3))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    sign = F.when(t.startswith("(") | (F.regexp_extract(t, shape, 1) == "-"), -1.0).otherwise(1.0)
    return digits * scale * sign + F.lit(0.0)


def plain_number(text: Column, percent: bool = False) -> Column:
    """Commas and percent signs dropped; with ``percent`` a sign divides by 100."""
    t = F.trim(text)
    value = F.regexp_replace(t, "[,%]", "").try_cast("double")
    return F.when(t.endswith("%"), value / 100).otherwise(value) if percent else value


def is_number(text: Column) -> Column:
    return human_number(text).isNotNull()


def first_int(text: Column) -> Column:
    """The first run of digits, as an integer (quarters such as ``Q3``)."""
    return F.nullif(F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), "([0-9]+)", 1), F.lit("")).try_cast("int")


def decimals(text: Column) -> Column:
    """Integer decimals; infinite and unparsable ones are null."""
    t = F.upper(F.trim(text.cast("string")))
    return F.when(~t.isin("INF", "INFINITY", "-INF", "+INF", "NAN", ""), t.try_cast("double").cast("int"))


def unit_family(unit: Column, qname: Column, display: Column) -> Column:
    """``struct(unit, family)``: currency code, shares, percent, pure, or the unit
    itself without a family.  A blank unit is percent where the display or the
    concept says so, else null."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    code = F.regexp_extract(u, r"(?:iso4217[:])?([A-Z][A-Z][A-Z])(?:[^A-Z]|\b)", 1)
    marked = F.coalesce(display, F.lit("")).contains("%")
    told = marked | F.lower(F.coalesce(qname, F.lit(""))).contains("percent")
    pair = lambda a, b: F.struct((F.lit(a) if isinstance(a, str) else a).alias("unit"), F.lit(b).cast("string").alias("family"))
    none = F.lit(None).cast("string")
    return (
        F.when((u == "") & told, pair("%", "percent"))
        .when(u == "", pair(none, None))
        .when(code != "", pair(code, "currency"))
        .when(u.rlike(r"(?i)\bshares?\b"), pair("shares", "shares"))
        .when(u.rlike(r"(?i)\bpercent\b") | (u.rlike(r"(?i)\bpure\b") & marked), pair("%", "percent"))
        .when(u.rlike(r"(?i)\bpure\b"), pair("pure", "pure"))
        .otherwise(pair(u, None))
    )


def is_percent(unit: Column, qname: Column, display: Column) -> Column:
    """One predicate for percent facts, so that they are scaled once."""
    return (F.lower(F.coalesce(unit, F.lit(""))) == "percent") | F.coalesce(display, F.lit("")).contains("%") | F.lower(F.coalesce(qname, F.lit(""))).contains("percent")


def resolved_value(*candidates: Column) -> Column:
    """The first candidate that parses: numeric columns before text ones."""
    return F.coalesce(*[human_number(c.cast("string")) for c in candidates])


def similarity_of_distance(distance: Column, inner_product: bool) -> Column:
    return distance if inner_product else 1 / (1 + distance)


def ratio_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, 0 where the whole is not positive."""
    return F.when(whole > 0, F.round(100 * part / whole, 2)).otherwise(F.lit(0.0))


def _short(value: float | None, units: tuple[tuple[float, str], ...]) -> str | None:
    if value is None or math.isnan(value):
        return None
    for size, name in units:
        if abs(value) >= size:
            return f"{value / size:.3f}{name}"
    return f"{value:.6g}"


def short_value(trillions: bool = False):
    """Display of large values; Python's half-even rounding decides, so a UDF."""
    units = ((1e12, "T"),) * trillions + ((1e9, "B"), (1e6, "M"), (1e3, "K"))

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _short(None if pd.isna(v) else float(v), units)).astype(object)

    return shown


_LEGAL = [re.compile(p, re.I) for p in (r"\b(?:item|rule)\s+\d+[-a-z0-9]*\b", r"\bsection\s+[0-9]+(?:[(][a-z][)])?\b", r"§\s*[0-9]+(?:[.][0-9]+)*", r"\b12b-2\b")]
_AMOUNT = re.compile(r"([€£¥$])?((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?)\s*(thousand|million|billion|mn|bn|m|k)?", re.I)
_MEMBER = re.compile(r"\b[\w:.-]*Member\b")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_LONG_DATE = re.compile(rf"\b(?:{'|'.join(_MONTHS.split())})[a-z]*\s+[0-9][0-9]?,\s*(?:20|19)[0-9][0-9]\b", re.I)
_ISO_DATE = re.compile(r"\b(?:19|20)\d\d-\d\d-\d\d\b")
_MONTH_WORD = re.compile(r"\bmonths?\b", re.I)


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint cover of intervals, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def amounts(text: str | None) -> list[dict]:
    """Numbers of a sentence with scale, currency and context flags.

    Numbers inside rule, item, section and paragraph references are skipped.
    ``m`` scales nothing where months are in sight.  No boundary is asked
    after a unit, so ``5 men`` reads as five million, as the reference data do.
    """
    s, out = text or "", []
    legal = union_spans([m.span() for p in _LEGAL for m in p.finditer(s)])
    for m in _AMOUNT.finditer(s):
        if any(a <= m.start() < b for a, b in legal):
            continue
        near = s[max(0, m.start() - 30) : m.end() + 30]
        unit = (m.group(3) or "").lower() or None
        base = float(m.group(2).replace(",", ""))
        scaled = unit if unit and not (unit == "m" and _MONTH_WORD.search(near)) else None
        out.append({"raw": m.group().strip(), "value": base * SCALES.get(scaled or "", 1.0), "base": base, "unit": unit, "scale": scaled, "currency": SIGNS.get(m.group(1) or ""), "near_date": bool(_ISO_DATE.search(near) or _LONG_DATE.search(near)), "near_member": bool(_MEMBER.search(near)), "window": near})
    return out


AMOUNT = array_of(raw="string", value="double", base="double", unit="string", scale="string", currency="string", near_date="boolean", near_member="boolean", window="string")


@F.pandas_udf(AMOUNT)
def amount_details(texts: pd.Series) -> pd.Series:
    """:func:`amounts` over Arrow batches."""
    return texts.map(amounts)
