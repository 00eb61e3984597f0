"""Metadata predicates and projections of retrieval and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RID


def meta_filter(df: DataFrame, ticker: str | None = None, form: str | None = None, year: int | None = None, fold_case: bool = True, keep_odd_year: bool = False, need_rid: bool = False, rid: str = "rid") -> DataFrame:
    """Equality on ticker, form and fiscal year; empty values filter nothing.

    ``fold_case`` compares case-insensitively (the sparse and dense retrievers);
    the fused filter does not.  ``keep_odd_year`` keeps rows whose ``fy`` is no
    integer (sparse), else they go (dense).  ``need_rid`` asks for well-formed
    record ids.  Plain equality reaches the Parquet scan.
    """
    same = (lambda c, v: F.upper(c) == v.upper()) if fold_case else (lambda c, v: F.col(c) == v)
    if ticker:
        df = df.where(same("ticker", ticker))
    if form:
        df = df.where(same("form", form))
    if year:
        fy = (F.coalesce("fy", "year") if "year" in df.columns else F.col("fy")).cast("string").try_cast("int")
        df = df.where((fy == year) | fy.isNull()) if keep_odd_year else df.where(fy == year)
    return df.where(F.col(rid).rlike(RID)) if need_rid else df


OPERATORS = {
    "eq": lambda c, v: c == v,
    "in": lambda c, v: c.isin(list(v)),
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "between": lambda c, v: c.between(*v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    "has": F.array_contains,
}


def predicate(rules: dict[str, dict]) -> Column:
    """``{column: {operator: value}}`` as one conjunction."""
    parts = []
    for column, ops in rules.items():
        for op, value in ops.items():
            if op not in OPERATORS:
                raise ValueError(f"unknown operator {op!r}")
            parts.append(OPERATORS[op](F.col(column), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def keep_columns(df: DataFrame, wanted: list[str], rest: bool = False) -> DataFrame:
    """The wanted columns that exist, in that order, then the others if ``rest``."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*have, *[c for c in df.columns if rest and c not in have])


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Row value first, file value where the row has null or no such column."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


FACT_MARK = r"\b(us-gaap|dei|[a-z]{2,10}):[A-Z][A-Za-z]+|\b[a-z]+:[A-Za-z]+Member\b|\biso4217:[A-Z]{3}\b"


def looks_like_facts(text: Column, least: int = 3) -> Column:
    """Text with at least ``least`` namespaced tokens goes to the facts route."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(FACT_MARK)) >= least


def is_text_block(qname: Column) -> Column:
    return F.coalesce(F.endswith(qname, F.lit("TextBlock")), F.lit(False))
