"""Keyed index building: conflict resolution, audits, updates and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import path_priority, text_key
from ..functions.text import RID, chunk_no


def flattened_meta(rows: DataFrame, inner: str = "meta", keep_null_heading: bool = False) -> DataFrame:
    """Nested metadata lifted to columns; an outer value wins where it is set.

    ``keep_null_heading`` lets an outer null heading win, as older files had it.
    """
    fields = rows.schema[inner].dataType.names
    out = [F.col(c) for c in rows.columns if c != inner and c not in fields]
    for f in fields:
        value = F.col(f"{inner}.{f}")
        if f in rows.columns:
            value = F.col(f) if keep_null_heading and f == "heading" else F.coalesce(F.col(f), value)
        out.append(value.alias(f))
    return rows.select(*out)


def upserted(rows: DataFrame, words: list[str], rid: str = "rid", text: str = "text", path: str = "path", mtime: str = "mtime", position: str = "position") -> DataFrame:
    """One row a record id: the best by path priority, then newest, then last.

    ``max_by`` combines map-side, so an id with many versions is no hot group.
    """
    best = F.struct(path_priority(F.col(path), words).alias("priority"), F.col(mtime), F.col(position))
    row = F.struct(*[F.col(c) for c in rows.columns if c != rid])
    return rows.groupBy(rid).agg(F.max_by(row, best).alias("row"), F.count_distinct(text_key(F.col(text))).alias("n_versions")).select(rid, "row.*", "n_versions")


def folded(rows: DataFrame, words: list[str], rid: str = "rid") -> DataFrame:
    """The same by an ordered fold, which differs where equal texts repeat.

    A repeat of the held text changes nothing but its source, and that only on
    higher priority; another text wins on priority, then on a time not before
    the held one.  ``position`` is where the text came from, ``source`` the row
    whose path and time it carries.
    """
    scored = rows.select(F.col(rid).alias("rid"), "position", "mtime", path_priority(F.col("path"), words).alias("priority"), text_key(F.col("text")).alias("key"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        text = source = None
        for r in frame.sort_values("position").itertuples(index=False):
            if text is None or (r.key != text.key and (r.priority, r.mtime) >= (source.priority, source.mtime)):
                text = source = r
            elif r.key == text.key and r.priority > source.priority:
                source = r
        return pd.DataFrame([{"rid": text.rid, "position": text.position, "source": source.position, "priority": source.priority}])

    kind = dict(scored.dtypes)["rid"]
    return scored.groupBy("rid").applyInPandas(fold, f"rid {kind}, position long, source long, priority int")


def audited(meta: DataFrame, rid: str = "rid", index: str = "chunk_index") -> DataFrame:
    """One row: total, ill-formed ids, and stored numbers unlike the id's."""
    good = F.coalesce(F.col(rid), F.lit("")).rlike(RID)
    wrong = good & F.col(index).isNotNull() & ~F.col(index).cast("string").try_cast("int").eqNullSafe(chunk_no(F.col(rid)))
    return meta.agg(F.count(F.lit(1)).alias("total"), F.count_if(~good).alias("bad_format"), F.count_if(wrong).alias("mismatch"))


def missing(meta: DataFrame, source: DataFrame, rid: str = "rid") -> DataFrame:
    """Index ids without a source row."""
    return meta.select(rid).distinct().join(source.select(rid), rid, "left_anti")


def contents(rows: DataFrame, wanted: DataFrame, rid: str = "rid", fields: tuple[str, ...] = ("content", "text", "raw_text", "page_text", "body")) -> DataFrame:
    """First non-empty text field of the wanted records; records without one go."""
    value = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields if f in rows.columns])
    return rows.join(wanted.select(rid).distinct(), rid, "left_semi").select(rid, value.alias("content")).where("content is not null")


def filing_facts(facts: DataFrame, filing: str = "accno") -> DataFrame:
    """Document facts of each filing: modal quarter and year, latest date."""
    return facts.groupBy(filing).agg(F.mode("fq", True).alias("dei_fq"), F.mode("fy", True).alias("dei_fy"), F.max("doc_date").alias("dei_doc_date"))


#: Document facts by local name, and the metadata they give.
DEI = {"ticker": "TradingSymbol", "form": "DocumentType", "fy": "DocumentFiscalYearFocus", "fq": "DocumentFiscalPeriodFocus", "doc_date": "DocumentPeriodEndDate", "fye": "CurrentFiscalYearEndDate"}


def document_metadata(facts: DataFrame, filing: str = "filing_id") -> DataFrame:
    """``ticker, form, doc_date, fy, fq, fye, year`` of each filing by its document
    facts ``qname, value_raw, doc_order``; of several the first counts.

    A form keeps its base name, a date its digits; a year that is not stated is
    the date's.  Values of another shape are null.
    """
    name, value = F.regexp_extract("qname", r"([^:}]*)$", 1), F.trim("value_raw")
    held = facts.where(F.col("value_raw").isNotNull() & name.isin(list(DEI.values())))
    # exchanged first: string aggregates sort, and a task then sorts a part of bounded size, not its share of the scan
    raw = held.select(filing, "qname", "value_raw", "doc_order").repartition(filing).groupBy(filing).agg(*[F.min_by(F.when(name == local, value), F.when(name == local, F.col("doc_order"))).alias(k) for k, local in DEI.items()])
    got = lambda c, shape: F.nullif(F.regexp_extract(F.upper(c), shape, 1), F.lit(""))
    date = F.regexp_replace(got("doc_date", r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$"), "-", "")
    year = F.coalesce(got("fy", "^([0-9]+)$").try_cast("int"), F.substring(date, 1, 4).cast("int"))
    return raw.select(filing, F.nullif(F.upper("ticker"), F.lit("")).alias("ticker"), got("form", "(10-K|10-Q|20-F|40-F|8-K)").alias("form"), date.alias("doc_date"), year.alias("fy"), got("fq", "^(Q[1-4]|FY)$").alias("fq"), got("fye", "([0-9]{2}-[0-9]{2})").alias("fye"), year.cast("string").alias("year"))


def with_fallback(rows: DataFrame, meta: DataFrame, key: str = "filing_id") -> DataFrame:
    """``rows`` with blank metadata taken from ``meta``, where it has the column;
    metadata columns that ``rows`` lacks are added."""
    other = meta.select(key, *[F.col(c).alias(f"_{c}") for c in meta.columns if c != key])
    out = rows.join(other, key, "left")
    for c in (c for c in meta.columns if c != key):
        if c in rows.columns:
            own = F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
            out = out.withColumn(c, F.coalesce(own, F.col(f"_{c}").cast(rows.schema[c].dataType)))
        else:
            out = out.withColumn(c, F.col(f"_{c}"))
    return out.drop(*[c for c in other.columns if c != key])


def merged(rows: DataFrame, dei: DataFrame, filing: str = "accno", force: bool = True) -> DataFrame:
    """Rows with filing values put in: over the row's own, or only where blank."""
    out = rows.join(dei, filing, "left")
    for c in ("fq", "fy", "doc_date"):
        if c in rows.columns and f"dei_{c}" in dei.columns:
            own = F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
            new = F.col(f"dei_{c}").cast(rows.schema[c].dataType)
            out = out.withColumn(c, F.coalesce(new, F.col(c)) if force else F.coalesce(own, new))
    return out.select(*rows.columns)


def build_info(rows: DataFrame, source: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("records"))
