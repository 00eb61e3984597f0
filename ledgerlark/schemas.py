"""Record models: fields, aliases, validation with quarantine.

A model is a typed projection.  Each field has the spellings it may come under;
the first that is there and not blank is taken.  ``validated`` keeps every row
and says what is wrong; ``accepted`` keeps files that are wholly right.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "0.3.0"
FORMS = ("10-K", "10-Q", "8-K", "20-F", "6-K", "DEF 14A", "S-1", "OTHER")
HINTS = ("income", "balance", "cash", "equity", "other")


@dataclass(frozen=True)
class Model:
    name: str
    fields: dict[str, str]
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    one_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pattern: dict[str, str] = field(default_factory=dict)
    extra: str = "ignore"  # or "forbid"


_BASE = {"ticker": "string", "form": "string", "year": "int", "fy": "int", "fq": "string", "accno": "string", "doc_date": "string"}
_BASE_ALIASES = {"ticker": ("symbol",), "form": ("filing_form",), "year": ("fiscal_year", "report_year"), "accno": ("accession", "acc_no")}

MODELS = {
    m.name: m
    for m in (
        Model("text_row", _BASE | {"text": "string", "heading": "string", "page_no": "int", "tokens": "int"}, _BASE_ALIASES, ("text",)),
        Model("fact", _BASE | {"qname": "string", "value_num": "double", "value_raw": "string", "unit": "string", "decimals": "int", "period_start": "string", "period_end": "string", "instant": "string", "statement_hint": "string"}, _BASE_ALIASES | {"qname": ("concept", "name"), "value_num": ("numeric_value",), "value_raw": ("raw_value",), "unit": ("uom", "unit_normalized"), "period_start": ("start", "start_date"), "period_end": ("end", "end_date")}, ("qname",), {"form": FORMS, "statement_hint": HINTS}, {"qname": "^[^:]+:.+$"}),
        Model("calculation_edge", _BASE | {"parent": "string", "child": "string", "order": "double", "weight": "double"}, _BASE_ALIASES, ("parent", "child")),
        Model("definition_arc", _BASE | {"from_concept": "string", "to_concept": "string", "arcrole": "string", "order": "double"}, _BASE_ALIASES, ("from_concept", "to_concept")),
        Model("label", _BASE | {"concept": "string", "role": "string", "lang": "string", "label_text": "string"}, _BASE_ALIASES, ("concept", "label_text")),
        Model("label_best", _BASE | {"concept": "string", "label_best": "string", "label_doc": "string"}, _BASE_ALIASES, ("concept",)),
        Model("labels_wide", _BASE | {"concept": "string"}, _BASE_ALIASES, ("concept",)),
    )
}


def _taken(df: DataFrame, name: str, aliases: tuple[str, ...]) -> Column:
    have = [F.col(f"`{c}`").cast("string") for c in (name, *aliases) if c in df.columns]
    blank = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "null"), c)
    return F.coalesce(*[blank(c) for c in have]) if have else F.lit(None).cast("string")


def validated(df: DataFrame, model: str) -> DataFrame:
    """The model's columns, ``schema_version`` and ``problems`` (empty if none)."""
    m = MODELS[model]
    text = {k: _taken(df, k, m.aliases.get(k, ())) for k in m.fields}
    typed = {k: text[k] if t == "string" else text[k].try_cast(t) for k, t in m.fields.items()}
    problems = [F.when(typed[k].isNull(), F.lit(f"missing:{k}")) for k in m.required]
    problems += [F.when(text[k].isNotNull() & typed[k].isNull(), F.lit(f"type:{k}")) for k, t in m.fields.items() if t != "string" and k not in m.required]
    problems += [F.when(text[k].isNotNull() & ~text[k].isin(list(v)), F.lit(f"value:{k}")) for k, v in m.one_of.items()]
    problems += [F.when(text[k].isNotNull() & ~text[k].rlike(p), F.lit(f"pattern:{k}")) for k, p in m.pattern.items()]
    if m.extra == "forbid":
        known = set(m.fields) | {a for v in m.aliases.values() for a in v}
        problems += [F.lit(f"extra:{c}") for c in df.columns if c not in known]
    found = F.filter(F.array(*problems), lambda p: p.isNotNull())
    return df.select(*[c.alias(k) for k, c in typed.items()], F.lit(VERSION).alias("schema_version"), found.alias("problems"), *[F.col("file")] * ("file" in df.columns and "file" not in m.fields))


def accepted(rows: DataFrame, strict: bool = False, file: str = "file") -> DataFrame:
    """Rows without problems; ``strict`` takes only files none of whose rows has one."""
    if not strict:
        return rows.where(F.size("problems") == 0).drop("problems")
    bad = rows.where(F.size("problems") > 0).select(file).distinct()
    return rows.join(bad, file, "left_anti").drop("problems")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("problems") > 0)


def file_status(rows: DataFrame, file: str = "file") -> DataFrame:
    """``ok`` or ``fail`` and the row count of each file."""
    return rows.groupBy(file).agg(F.when(F.max(F.size("problems")) > 0, "fail").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("n_rows"))
