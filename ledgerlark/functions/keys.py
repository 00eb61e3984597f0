"""Hashes, signatures and JSON-held structures."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import collapsed


def dims_signature(dims: Column) -> Column:
    """``key=value`` pairs in key order, joined by ``|`` ("" for none)."""
    pairs = F.array_sort(F.map_entries(F.coalesce(dims, F.from_json(F.lit("{}"), "map<string,string>"))))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|")


def dims_of(json: Column) -> Column:
    """A JSON object as map; null on anything else."""
    return F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"})


PERIOD_DDL = "struct<period:struct<start:string,end:string,instant:string,start_date:string,end_date:string>,entity:string>"


def context_period(json: Column) -> Column:
    """``start, end, instant`` of a context object under either spelling."""
    c = F.from_json(json, PERIOD_DDL)["period"]
    return F.struct(F.coalesce(c["start"], c["start_date"]).alias("start"), F.coalesce(c["end"], c["end_date"]).alias("end"), c["instant"].alias("instant"))


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def signature(salt: list[Column], text: Column, n: int = 80) -> Column:
    """SHA-1 of the salted first ``n`` words of a text."""
    head = F.array_join(F.slice(F.split(collapsed(text), " "), 1, n), " ")
    return F.sha1(F.concat_ws("|", *[F.coalesce(s.cast("string"), F.lit("")) for s in salt], head))


def content_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


@F.pandas_udf(T.LongType())
def stable_id(keys: pd.Series) -> pd.Series:
    """BLAKE2b-64 without its sign bit, as vector indexes hold it."""
    return keys.map(lambda k: int.from_bytes(hashlib.blake2b((k or "").encode(), digest_size=8).digest(), "big") & (1 << 63) - 1)


def path_priority(path: Column, words: list[str]) -> Column:
    """How many of the words a path holds."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))


HINTS = (
    ("balance", "^us-gaap:(accumulateddepreciation|goodwill|intangibleasset|inventory|propertyplantandequipment)"),
    ("income", "earnings|eps|income|loss|profit|revenue"),
    ("cashflow", "cash|financingactivities|investingactivities|operatingactivities"),
    ("notes", "disclosure|note|schedule|supplemental|textblock"),
    ("balance", "asset|equity|goodwill|inventory|liabilit|payable|receivable"),
)


def statement_hint(qname: Column) -> Column:
    """Statement of a concept by the first keyword group it holds."""
    low = F.lower(F.coalesce(qname, F.lit("")))
    out = None
    for name, words in HINTS:
        out = F.when(low.rlike(words), name) if out is None else out.when(low.rlike(words), name)
    return out.otherwise("other")
