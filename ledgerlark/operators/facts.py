"""Facts: normalisation, de-duplication, text-block extraction, fact SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as ks
from ..functions import numbers as nu
from ..functions import periods as pe
from ..functions.types import array_of
from .filters import is_text_block
from .windows import first_of


def _maybe(df: DataFrame, *names: str) -> Column:
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in have]) if have else F.lit(None).cast("string")


ALIASES = {
    "qname": ("qname", "concept", "name"),
    "value_raw": ("value_raw", "raw_value", "value"),
    "value_display": ("value_display", "display"),
    "unit": ("unit", "uom", "unit_normalized"),
    "ticker": ("ticker", "symbol"),
    "form": ("form", "filing_form"),
    "fy": ("fy", "year", "fiscal_year", "report_year"),
    "accno": ("accno", "accession", "acc_no"),
    "period_start": ("period_start", "start", "start_date"),
    "period_end": ("period_end", "end", "end_date"),
    "instant": ("instant", "period_instant"),
}

PER_SHARE = "antidilutivesecurities|basicshares|dilutedshares|earningspershare|weightedaveragenumber"
UNREALISED = "accumulated.*unrealized.*(loss|gain)"
BALANCE_LIKE = "assets|liabilities|cashandcashequivalents|marketablesecurities|(share|stock)holdersequity|retainedearnings|accumulatedothercomprehensiveincome|shortterm|longterm|debt|inventory|receivables|propertyplantandequipment|ppe"
ALWAYS_BALANCE = tuple(f"us-gaap:{n}" for n in ("MarketableSecuritiesCurrent", "MarketableSecuritiesNoncurrent", "CashAndCashEquivalentsAtCarryingValue"))


def final_hint(qname: Column, instant: Column, signature: Column) -> Column:
    """Statement of a fact; of the rules that hold the last one counts."""
    low, dated = F.lower(F.coalesce(qname, F.lit(""))), instant.isNotNull()
    hint = F.when(low.rlike(PER_SHARE), "income").otherwise(ks.statement_hint(qname))
    hint = F.when(dated & (low.rlike(UNREALISED) | F.contains(signature, F.lit("FairValueByFairValueHierarchyLevelAxis"))), "balance").otherwise(hint)
    hint = F.when(dated & low.rlike(BALANCE_LIKE), "balance").otherwise(hint)
    return F.when(qname.isin(list(ALWAYS_BALANCE)), "balance").otherwise(hint)


def normalised(df: DataFrame) -> DataFrame:
    """One row a fact with typed columns, whatever spelling the input uses.

    Percent facts are divided by 100 once, by one predicate.  Text blocks lose
    unit and decimals.  Statement hints come from the concept; later rules win.
    Values that do not parse are null and ``quarantined`` says why.
    """
    c = {k: _maybe(df, *v) for k, v in ALIASES.items()}
    number = [F.col(n).cast("double") for n in ("value_num_clean", "value_num", "numeric_value") if n in df.columns]
    value = F.coalesce(*number, nu.resolved_value(c["value_raw"], c["value_display"]))
    percent = nu.is_percent(c["unit"], c["qname"], c["value_display"])
    block = is_text_block(c["qname"])
    dims = ks.dims_of(F.col("dimensions_json")) if "dimensions_json" in df.columns else (F.col("dimensions") if "dimensions" in df.columns else ks.dims_of(F.lit(None).cast("string")))
    # Three balances are kept without dimensions.
    sig = F.when(~F.coalesce(c["qname"].isin(list(ALWAYS_BALANCE)), F.lit(False)), ks.dims_signature(dims))
    unit = nu.unit_family(c["unit"], c["qname"], c["value_display"])
    year = F.coalesce(pe.fiscal_year(c["period_start"], c["period_end"], c["instant"]), c["fy"].try_cast("int"))
    out = df.select(
        *[e.alias(k) for k, e in c.items() if k not in ("unit", "fy")],
        F.when(~block, unit["unit"]).alias("unit"),
        F.when(~block, unit["family"]).alias("unit_family"),
        year.alias("fy"),
        pe.calendar_quarter(c["period_start"], c["period_end"], c["instant"]).alias("fq"),
        pe.period_label(c["period_start"], c["period_end"], c["instant"], year).alias("period_label"),
        F.when(percent, value / 100).otherwise(value).alias("value_num"),
        F.when(~block, nu.decimals(_maybe(df, "decimals"))).alias("decimals"),
        sig.alias("dims_signature"),
        final_hint(c["qname"], c["instant"], sig).alias("statement_hint"),
        block.alias("is_text_block"),
    )
    reason = F.when(F.col("qname").isNull() | ~F.col("qname").contains(":"), "qname").when(F.col("value_num").isNull() & ~F.col("is_text_block"), "value")
    return out.withColumn("quarantined", reason)


DEDUP_KEYS = "accno qname instant period_start period_end dims_signature".split()


def deduplicated(facts: DataFrame, order: str) -> DataFrame:
    """The first fact of each concept, period, dimensions and filing."""
    return first_of(facts, DEDUP_KEYS, [order])


_BLOCK_NUMBER = re.compile(r"([$€£¥])?\s*(\(?\d[\d,]*(?:\.\d+)?\)?)\s*(thousand|million|billion|%)?", re.I)


def block_numbers(text: str | None) -> list[dict]:
    out = []
    for m in _BLOCK_NUMBER.finditer(re.sub(r"<[^>]+>", " ", text or "")):
        body, unit = m.group(2), (m.group(3) or "").lower()
        value = float(re.sub(r"[(),]", "", body)) * nu.SCALES.get(unit, 1.0) * (0.01 if unit == "%" else 1)
        out.append({"value": -value if body.startswith("(") else value, "unit": "percent" if unit == "%" else nu.SIGNS.get(m.group(1) or ""), "raw": m.group().strip()})
    return out


@F.pandas_udf(array_of(value="double", unit="string", raw="string"))
def block_number_list(texts: pd.Series) -> pd.Series:
    return texts.map(block_numbers)


def blocks_expanded(facts: DataFrame) -> DataFrame:
    """Text-block facts are replaced by the numbers found in them; others stay."""
    plain = facts.where(~F.col("is_text_block"))
    found = facts.where("is_text_block").withColumn("_n", F.explode(block_number_list("value_raw")))
    found = found.withColumns({"value_num": F.col("_n.value"), "unit": F.col("_n.unit"), "value_raw": F.col("_n.raw"), "is_text_block": F.lit(False)}).drop("_n")
    return plain.unionByName(found)


FACT_SQL = """
WITH ranked AS (
  SELECT filing_id, qname, label_text, role,
         row_number() OVER (PARTITION BY filing_id, qname
           ORDER BY CASE role WHEN 'standard' THEN 0 WHEN 'terse' THEN 1 ELSE 2 END, coalesce(lang, ''), label_text) AS rn
  FROM labels_of)
SELECT f.*, c.period_start, c.period_end, c.instant, u.measure, l.label_text AS best_label, l.role AS best_role
FROM facts_of f
LEFT JOIN contexts_of c ON f.filing_id = c.filing_id AND f.context_id = c.context_id
LEFT JOIN units_of u ON u.unit_id = f.unit_id AND u.filing_id = f.filing_id
LEFT JOIN ranked l ON f.filing_id = l.filing_id AND f.qname = l.qname AND l.rn = 1
"""


def fact_records(spark, facts: DataFrame, contexts: DataFrame, units: DataFrame, labels: DataFrame, filing_id: str | None = None, accession_no: str | None = None, ticker: str | None = None, qname_like: str | None = None, numeric_only: bool = False, limit: int | None = None) -> DataFrame:
    """The fact store's parameterised query: facts with context, unit and best label.

    Predicates are Column filters on the facts side, so they reach its scan;
    values are literals, never pasted into SQL text.
    """
    f = facts
    for column, value in (("filing_id", filing_id), ("accession_no", accession_no), ("ticker", ticker)):
        if value is not None:
            f = f.where(F.col(column) == value)
    if qname_like:
        f = f.where(F.contains(F.lower("qname"), F.lit(qname_like.lower())))
    if numeric_only:
        f = f.where("is_numeric")
    out = spark.sql(FACT_SQL.replace("facts_of", "{facts}").replace("contexts_of", "{contexts}").replace("units_of", "{units}").replace("labels_of", "{labels}"), facts=f, contexts=contexts, units=units, labels=labels)
    if limit is not None:
        order = [F.asc_nulls_last("doc_order")] if "doc_order" in facts.columns else []
        out = out.orderBy(*order, "qname").limit(limit)
    return out


def fact_segments(records: DataFrame) -> DataFrame:
    """One display line a fact and one document a filing, in order of concept."""
    line = F.concat_ws(" | ", "best_label", "qname", F.col("value_raw"), "measure", pe.period_label(F.col("period_start"), F.col("period_end"), F.col("instant")))
    return records.withColumn("line", line).groupBy("filing_id").agg(F.count(F.lit(1)).alias("n_facts"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("document"))
