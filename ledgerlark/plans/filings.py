"""Queries over sources, sinks, filters, labels and facts of filings.

Files of filings are made from the tables, one a key, and read again by the
library's own sources, so that the SQL of the same rows holds them to account.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import numbers as nu
from ..functions import text as tx
from ..operators import dense, facts, filters, hybrid, index, labels, windows
from ..session import scratch_folder
from ..sources import files, html, instance, linkbase, sinks
from .registry import query


def _fresh(t, name: str) -> str:
    """A new folder for files that a query writes and reads."""
    return scratch_folder(t.spark, name)


@query("""
WITH f AS (SELECT user_id AS accno, event_type AS fq, event_id % 4 AS fy, value AS doc_date FROM events),
q AS (SELECT accno, fq, row_number() OVER (PARTITION BY accno ORDER BY count(*) DESC, fq) AS r FROM f GROUP BY accno, fq),
y AS (SELECT accno, fy, row_number() OVER (PARTITION BY accno ORDER BY count(*) DESC, fy) AS r FROM f GROUP BY accno, fy)
SELECT f.accno, max(q.fq) AS dei_fq, max(y.fy) AS dei_fy, max(f.doc_date) AS dei_doc_date
FROM f JOIN q ON q.accno = f.accno AND q.r = 1 JOIN y ON y.accno = f.accno AND y.r = 1 GROUP BY f.accno
""")
def filing_facts(t):
    """Modal quarter and year and latest date of each filing."""
    e = t("events").select(F.col("user_id").alias("accno"), F.col("event_type").alias("fq"), (F.col("event_id") % 4).alias("fy"), F.col("value").alias("doc_date"))
    return index.filing_facts(e)


@query("""
SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1
""")
def facts_deduplicated(t):
    """First fact of each concept, period, dimensions and filing."""
    none = F.lit(None).cast("string")
    li = t("lineitem").select("*", F.col("l_orderkey").alias("accno"), F.col("l_returnflag").alias("qname"), none.alias("instant"), none.alias("period_start"), F.col("l_linestatus").alias("period_end"), none.alias("dims_signature"))
    return facts.deduplicated(li, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")


_META = "(SELECT doc_id, lang AS ticker, source AS form, CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE (2020 + doc_id % 4)::VARCHAR END AS fy, CASE WHEN doc_id % 3 = 0 THEN source ELSE printf('%010d-24-%06d::text::chunk-%d', doc_id, doc_id, doc_id % 7) END AS rid FROM documents)"


def _meta(t):
    d = F.col("doc_id")
    fy = F.when(d % 5 == 0, "n/a").otherwise((2020 + d % 4).cast("string"))
    rid = F.when(d % 3 == 0, F.col("source")).otherwise(F.format_string("%010d-24-%06d::text::chunk-%d", d, d, d % 7))
    return t("documents").select("doc_id", F.col("lang").alias("ticker"), F.col("source").alias("form"), fy.alias("fy"), rid.alias("rid"))


@query(f"SELECT doc_id FROM {_META} WHERE upper(ticker) = 'DE' AND coalesce(TRY_CAST(fy AS INTEGER) = 2022, TRUE)")
def filter_sparse(t):
    """Case folded, rows without an integer year stay."""
    return filters.meta_filter(_meta(t), "De", None, 2022, keep_odd_year=True).select("doc_id")


@query(f"SELECT doc_id FROM {_META} WHERE upper(ticker) = 'DE' AND TRY_CAST(fy AS INTEGER) = 2022")
def filter_dense(t):
    """Case folded, rows without an integer year go."""
    return filters.meta_filter(_meta(t), "De", "", 2022).select("doc_id")


@query(f"SELECT doc_id FROM {_META} WHERE ticker = 'en' AND form = 'src1'")
def filter_exact(t):
    """Plain equality, as the fused filter has it."""
    return filters.meta_filter(_meta(t), "en", "src1", fold_case=False).select("doc_id")


@query(f"SELECT doc_id, rid FROM {_META} WHERE regexp_matches(rid, '{tx.RID}')")
def filter_rid(t):
    """Well-formed record ids only."""
    return filters.meta_filter(_meta(t), need_rid=True).select("doc_id", "rid")


@query("SELECT doc_id, '10-K' AS form, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, 'xx') AS lang, n_chars, 1 AS missing FROM documents")
def columns_kept(t):
    """Wanted columns first, file values where the row has none."""
    d = t("documents").select("n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), "doc_id")
    out = filters.keep_columns(filters.with_defaults(d, {"lang": "xx", "form": "10-K"}), ["doc_id", "form", "lang", "heading"], rest=True)
    return out.withColumn("missing", F.lit(len(filters.missing_columns(out, ["heading", "lang"]))))


_QNAME = "'ll:' || replace(p_name, ' ', '') || CASE WHEN p_partkey % 3 = 0 THEN 'TextBlock' ELSE '' END"


@query(f"SELECT p_partkey, q AS qname FROM (SELECT p_partkey, {_QNAME} AS q FROM part) WHERE suffix(q, 'TextBlock')")
def text_blocks(t):
    """Facts whose concept is a text block."""
    q = F.concat(F.lit("ll:"), F.replace("p_name", F.lit(" "), F.lit("")), F.when(F.col("p_partkey") % 3 == 0, "TextBlock").otherwise(""))
    return t("part").select("p_partkey", q.alias("qname")).where(filters.is_text_block(F.col("qname")))


@query("""
SELECT o_orderkey, o_orderkey * 1e6 AS value_num, NULL::VARCHAR AS unit, o_orderkey || ' million' AS value_raw FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, -o_custkey::DOUBLE, NULL, '(' || o_custkey || ')' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_custkey::DOUBLE * 0.01::DOUBLE, 'percent', o_custkey || '%' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_custkey::DOUBLE, 'USD', '$' || o_custkey FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, NULL, 'plain' FROM orders WHERE o_orderkey % 2 <> 0
""")
def blocks_expanded(t):
    """Text blocks replaced by the numbers found in them; other facts stay."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("<p>sold <b>"), key, F.lit(" million</b> less ("), cust, F.lit(") or "), cust, F.lit("% of $"), cust, F.lit("</p>"))
    block = F.col("o_orderkey") % 2 == 0
    rows = t("orders").select("o_orderkey", block.alias("is_text_block"), F.when(block, text).otherwise("plain").alias("value_raw"), F.lit(None).cast("double").alias("value_num"), F.lit(None).cast("string").alias("unit"))
    return facts.blocks_expanded(rows).select("o_orderkey", "value_num", "unit", "value_raw")


_LONG = """(SELECT p_brand AS concept, CASE p_partkey % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'terse' WHEN 2 THEN 'verbose' ELSE 'documentation' END AS role,
CASE WHEN p_partkey % 3 = 0 THEN 'en' ELSE 'en-US' END AS lang, p_name AS label_text FROM part)"""


def _long(t):
    k = F.col("p_partkey")
    role = F.element_at(F.array(*map(F.lit, ("standard", "terse", "verbose", "documentation"))), (k % 4 + 1).cast("int"))
    return t("part").select(F.col("p_brand").alias("concept"), role.alias("role"), F.when(k % 3 == 0, "en").otherwise("en-US").alias("lang"), F.col("p_name").alias("label_text"))


@query(f"""
WITH l AS {_LONG},
w AS (SELECT concept, min(label_text) FILTER (role = 'standard' AND lang = 'en-US') AS standard_us, min(label_text) FILTER (role = 'terse' AND lang = 'en') AS terse_en FROM l GROUP BY concept),
b AS (SELECT concept, label_text AS best FROM l QUALIFY row_number() OVER (PARTITION BY concept ORDER BY CASE role WHEN 'standard' THEN 0 WHEN 'terse' THEN 1 ELSE 999 END, CASE lang WHEN 'en-US' THEN 0 ELSE 1 END, label_text) = 1)
SELECT concept, standard_us, terse_en, best FROM w LEFT JOIN b USING (concept)
""")
def labels_wide(t):
    """Labels by role and language beside the best one."""
    out = labels.wide_labels(_long(t), ("standard", "terse"), ("en-US", "en"), ["concept"])
    return out.select("concept", F.col("`label_standard_en-US`").alias("standard_us"), F.col("label_terse_en").alias("terse_en"), F.col("label_best").alias("best"))


@query(f"""
WITH l AS {_LONG},
b AS (SELECT concept, label_text AS label_best, role AS role_best FROM l QUALIFY row_number() OVER (PARTITION BY concept ORDER BY CASE role WHEN 'standard' THEN 0 WHEN 'terse' THEN 1 WHEN 'documentation' THEN 3 ELSE 4 END, CASE lang WHEN 'en-US' THEN 0 ELSE 1 END, label_text) = 1),
d AS (SELECT concept, label_text AS label_doc FROM l WHERE role = 'documentation' QUALIFY row_number() OVER (PARTITION BY concept ORDER BY length(label_text) DESC, label_text DESC) = 1)
SELECT concept, label_best, role_best, label_doc FROM b LEFT JOIN d USING (concept)
""")
def labels_preferred(t):
    """Best labels from long rows whose roles are addresses."""
    named = {"standard": "label", "terse": "terseLabel", "verbose": "verboseLabel"}
    uri = F.concat(F.lit("http://www.xbrl.org/2003/role/"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("role")), F.col("role")))
    return labels.preferred_labels(_long(t).withColumns({"role": uri, "lang": F.lower("lang")}), ["concept"]).select("concept", "label_best", "role_best", "label_doc")


@query("SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z./%-]+') AS w FROM documents)")
def mapping_tokens(t):
    """Tokens of the concept mapping, of whole texts."""
    d = t.wide("documents").select("doc_id", tx.mapping_tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\s+', ' ', 'g')) AS text FROM documents")
def white_space(t):
    """Every run of white space one blank."""
    return t.wide("documents").select("doc_id", tx.spaces(F.col("text")).alias("text"))


_ANNOUNCED = "'(' || p_brand || ' in ' || CASE p_partkey % 4 WHEN 0 THEN 'thousands' WHEN 1 THEN 'Millions of USD' WHEN 2 THEN 'billions, €' ELSE 'pieces' END || ')'"


@query(f"""
WITH p AS (SELECT p_partkey, lower({_ANNOUNCED}) AS s FROM part),
u AS (SELECT p_partkey, nullif(regexp_extract(s, '\\b(thousand|million|billion)s\\b', 1), '') || 's' AS unit, CASE WHEN contains(s, 'usd') THEN 'USD' WHEN contains(s, '€') THEN 'EUR' END AS currency FROM p)
SELECT p_partkey, unit, currency, CASE WHEN unit IS NULL AND currency IS NULL THEN 'Total' ELSE 'Total (' || concat_ws(', ', currency, unit) || ')' END AS header FROM u
""")
def table_units(t):
    """Scale and currency announced by a table, and the header that shows them."""
    words = F.element_at(F.array(*map(F.lit, ("thousands", "Millions of USD", "billions, €", "pieces"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    unit, currency = html.unit_of(F.concat(F.lit("("), "p_brand", F.lit(" in "), words, F.lit(")")))
    return t("part").select("p_partkey", unit.alias("unit"), currency.alias("currency"), html.shown_header(F.lit("Total"), unit, currency).alias("header"))


@query("""
SELECT p_partkey AS file, 0 AS "table", 1 AS row, 'Size' AS account, 'FY 2023' AS header, 1 AS period_rank, p_size::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, 0, 1, 'Size', 'FY 2022', 2, (0 - p_partkey)::DOUBLE FROM part
UNION ALL SELECT p_partkey, 0, 2, p_brand, 'FY 2023', 1, p_size * 1000.0 FROM part
UNION ALL SELECT p_partkey, 0, 2, p_brand, 'FY 2022', 2, p_partkey::DOUBLE FROM part
""")
def tables_compacted(t):
    """Tables of pages made from parts: account and the two latest of three periods."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    cell = lambda *x: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v if not isinstance(v, str) else F.lit(v), F.lit("</td>")) for v in x], F.lit("</tr>"))
    page = F.concat(F.lit("<p>before</p><table>"), cell("Account", "FY 2021", "FY 2023", "FY 2022"), cell("Size", "7", size, F.concat(F.lit("("), key, F.lit(")"))), cell(F.col("p_brand"), "8", F.concat(F.lit("$"), size, F.lit("K")), key), F.lit("</table>"))
    return html.compact_tables(html.cells(t.wide("part").select("p_partkey", page.alias("page")), "p_partkey", "page"))


@query("SELECT p_partkey AS file, (p_partkey % 3)::INTEGER AS \"table\" FROM part")
def tables_largest(t):
    """The table with most cells of each page, the first of equals."""
    one = "<table><tr><td>a</td></tr></table>"
    two = "<table><tr><td colspan='2'>a</td><td>b</td></tr><tr><td></td><td>c</td></tr></table>"
    pages = F.array(*[F.lit(x) for x in (two + one + two, one + two + one, one + one + two)])
    p = t("part").select("p_partkey", F.element_at(pages, (F.col("p_partkey") % 3 + 1).cast("int")).alias("page"))
    return html.largest_tables(html.cells(p, "p_partkey", "page"))


@query("""
SELECT c_custkey AS filing_id, CASE WHEN c_custkey % 2 = 0 THEN 'OWN' ELSE 'T' || c_nationkey END AS ticker, CASE WHEN c_custkey % 3 > 0 THEN '10-Q' END AS form,
CASE WHEN c_custkey % 5 > 0 THEN (2000 + c_custkey % 20) || '0930' END AS doc_date, CASE WHEN c_custkey % 7 = 0 THEN 1999 WHEN c_custkey % 5 > 0 THEN 2000 + c_custkey % 20 END::INTEGER AS fy, 'Q' || (1 + c_custkey % 4) AS fq FROM customer
""")
def metadata_fallback(t):
    """A file's own metadata, then that of its document facts."""
    k = F.col("c_custkey")
    fact = lambda name, value, order: F.struct(F.lit(f"dei:{name}").alias("qname"), value.alias("value_raw"), F.lit(order).alias("doc_order"))
    stated = F.array(
        fact("TradingSymbol", F.concat(F.lit(" t"), F.col("c_nationkey").cast("string")), 1), fact("TradingSymbol", F.lit("late"), 9), fact("DocumentType", F.when(k % 3 > 0, "10-Q/A").otherwise("S-1"), 2),
        fact("DocumentPeriodEndDate", F.when(k % 5 > 0, F.concat((2000 + k % 20).cast("string"), F.lit("-09-30"))), 3), fact("DocumentFiscalYearFocus", F.when(k % 7 == 0, "1999"), 4), fact("DocumentFiscalPeriodFocus", F.concat(F.lit("q"), (1 + k % 4).cast("string")), 5),
    )
    found = t.wide("customer").select(k.alias("filing_id"), F.explode(stated).alias("f")).select("filing_id", "f.*")
    own = t("customer").select(k.alias("filing_id"), F.when(k % 2 == 0, "OWN").otherwise("").alias("ticker"))
    return index.with_fallback(own, index.document_metadata(found)).select("filing_id", "ticker", "form", "doc_date", "fy", "fq")


_XLINK = 'xmlns:xlink="http://www.w3.org/1999/xlink"'


def _linkbases(t, each):
    """A linkbase of each region: its locator, then ``each`` nation's elements."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = F.concat(F.lit(f'<l {_XLINK}><x xlink:type="extended"><loc xlink:type="locator" xlink:label="r" xlink:href="geo.xsd#geo_Region'), F.col("r_regionkey").cast("string"), F.lit('"/>'))
    body = n.groupBy("r_regionkey").agg(F.array_join(F.collect_list(each), "").alias("body"))
    return body.select(F.col("r_regionkey").alias("file"), F.concat(head, "body", F.lit("</x></l>")).alias("xml"))


def _locator():
    key = F.col("n_nationkey").cast("string")
    return F.concat(F.lit('<loc xlink:type="locator" xlink:label="n'), key, F.lit('" xlink:href="geo.xsd#geo_Nation'), key, F.lit('"/>'))


@query("""
SELECT n_regionkey AS file, 'geo:Region' || n_regionkey AS from_concept, 'geo:Nation' || n_nationkey AS to_concept, 'urn:parent-child' AS arcrole, n_nationkey::DOUBLE AS "order", CASE WHEN n_nationkey % 2 = 0 THEN -1.0::DOUBLE END AS weight FROM nation
""")
def linkbase_arcs(t):
    """Relations parsed from linkbases and resolved through their locators."""
    key = F.col("n_nationkey").cast("string")
    arc = F.concat(F.lit('<arc xlink:type="arc" xlink:arcrole="urn:parent-child" xlink:from="r" xlink:to="n'), key, F.lit('" order="'), key, F.when(F.col("n_nationkey") % 2 == 0, '" weight="-1.0"/>').otherwise('" weight="none"/>'))
    other = F.concat(F.lit('<arc xlink:type="arc" xlink:arcrole="urn:other" xlink:from="n'), key, F.lit('" xlink:to="r"/>'))
    return linkbase.arcs(linkbase.items(_linkbases(t, F.concat(_locator(), arc, other))), ["urn:parent-child"])


@query("""
SELECT n_regionkey AS file, 'geo:Nation' || n_nationkey AS concept, 'standard' AS role, 'en' AS lang, n_name AS label_text FROM nation
""")
def linkbase_labels(t):
    """Labels parsed from linkbases; roles and languages of no interest go."""
    key = F.col("n_nationkey").cast("string")
    text = lambda role, lang, name: F.concat(F.lit(f'<lab xlink:type="resource" xlink:label="{name}'), key, F.lit(f'" xlink:role="{role}" xml:lang="{lang}">\n '), "n_name", F.lit(f'</lab><arc xlink:type="arc" xlink:from="n'), key, F.lit(f'" xlink:to="{name}'), key, F.lit('"/>'))  # noqa: E731, F541
    parsed = linkbase.items(_linkbases(t, F.concat(_locator(), text("standard", "en", "a"), text("terse", "fr", "b"), text("odd", "en", "c"))))
    return linkbase.wanted_labels(linkbase.labels(parsed))


@query("""
SELECT c_custkey AS filing_id, 'll:Balance' AS qname, c_custkey::VARCHAR AS value_raw, '2' AS decimals, 0 AS doc_order, 'C' || c_custkey AS entity, '2020-12-31' AS instant, '{"geo:Axis": "geo:Nation' || c_nationkey || '"}' AS dimensions_json, 'iso4217:USD/shares' AS measure FROM customer
""")
def instance_facts(t):
    """Facts of instances with their contexts, dimensions and divided units; nil facts go."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    xml = F.concat(
        F.lit('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:ll="urn:ll"><context id="c"><entity><identifier scheme="s">C'), key,
        F.lit('</identifier><segment><xbrldi:explicitMember dimension="geo:Axis">geo:Nation'), nation, F.lit("</xbrldi:explicitMember></segment></entity><period><instant>2020-12-31</instant></period></context>"),
        F.lit('<unit id="u"><divide><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit><ll:Balance contextRef="c" unitRef="u" decimals="2">'), key,
        F.lit('</ll:Balance><ll:None contextRef="c" xsi:nil="true"/></xbrl>'),
    )
    out = instance.facts_in_context(t.wide("customer").select(F.col("c_custkey").alias("filing_id"), xml.alias("xml")))
    return out.select("filing_id", "qname", "value_raw", "decimals", "doc_order", "entity", "instant", "dimensions_json", "measure")


_RAW = """(SELECT p_partkey, p_size AS file, CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN 'NoColon' ELSE 'll:' || p_brand END AS concept, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_size::VARCHAR END AS value,
CASE WHEN p_partkey % 11 = 0 THEN 'Z' ELSE '10-K' END AS form FROM part)"""


def _raw(t):
    k = F.col("p_partkey")
    q = F.when(k % 7 == 0, " ").when(k % 5 == 0, "NoColon").otherwise(F.concat(F.lit("ll:"), "p_brand"))
    return t("part").select(F.col("p_size").alias("file"), q.alias("concept"), F.when(k % 6 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("numeric_value"), F.when(k % 11 == 0, "Z").otherwise("10-K").alias("filing_form"), k.cast("string").alias("accession"))


@query(f"""
SELECT p_partkey::VARCHAR AS accno, nullif(concept, ' ') AS qname, TRY_CAST(value AS DOUBLE) AS value_num, concat_ws(',', CASE WHEN concept = ' ' THEN 'missing:qname' END, CASE WHEN value = 'x' THEN 'type:value_num' END, CASE WHEN form = 'Z' THEN 'value:form' END, CASE WHEN concept = 'NoColon' THEN 'pattern:qname' END) AS problems FROM {_RAW}
""")
def rows_validated(t):
    """Fact rows under other spellings, typed, with what is wrong."""
    return schemas.validated(_raw(t), "fact").select("accno", "qname", "value_num", F.array_join("problems", ",").alias("problems"))


_WRONG = "concept IN (' ', 'NoColon') OR value = 'x' OR form = 'Z'"


@query(f"SELECT file, CASE WHEN bool_or({_WRONG}) THEN 'fail' ELSE 'ok' END AS status, count(*) AS n_rows FROM {_RAW} GROUP BY file")
def files_status(t):
    """Whether all rows of a file are right."""
    return schemas.file_status(schemas.validated(_raw(t), "fact"))


@query(f"SELECT p_partkey::VARCHAR AS accno FROM {_RAW} r WHERE NOT ({_WRONG})")
def rows_accepted(t):
    """Rows without problems."""
    return schemas.accepted(schemas.validated(_raw(t), "fact")).select("accno")


@query("""
SELECT o_orderkey, (o_orderkey % 4)::INTEGER AS quarter, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3 - 2)::INTEGER END AS decimals, o_custkey / 100.0 AS part, o_custkey::DOUBLE AS plain,
round(100.0 * o_custkey / o_orderkey, 2) AS percent, 1 / (1 + o_custkey::DOUBLE) AS similarity FROM orders WHERE o_orderkey > 0
""")
def number_parsers(t):
    """Quarters, decimals, plain numbers, percentages and similarities."""
    o, k, c = t("orders").where("o_orderkey > 0"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        "o_orderkey", nu.first_int(F.concat(F.lit("Q"), k % 4, F.lit(" of 2020"))).alias("quarter"), nu.decimals(F.when(k % 3 == 0, "INF").otherwise((k % 3 - 2).cast("string"))).alias("decimals"),
        nu.plain_number(F.concat(c.cast("string"), F.lit("%")), percent=True).alias("part"), nu.plain_number(F.concat(F.lit(" "), c.cast("string"))).alias("plain"),
        nu.ratio_percent(c, k).alias("percent"), nu.similarity_of_distance(c.cast("double"), False).alias("similarity"),
    )


@query(r"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, lower(source) || CASE WHEN doc_id % 4 = 0 THEN ' index' WHEN doc_id % 4 = 1 THEN ' gross margin' ELSE '' END AS head FROM documents)
SELECT doc_id, round(greatest(-0.2, 0.0::DOUBLE + CASE WHEN regexp_matches(head, 'cover|index|signature|table of contents') THEN -0.15 ELSE 0 END
+ CASE WHEN regexp_matches(low, '(?s)compared to|\b20[0-9]{2}\b.*\b20[0-9]{2}\b.*\b20[0-9]{2}\b') THEN 0.08 ELSE 0 END
+ CASE WHEN contains(low, '%') OR contains(head, 'gross margin') THEN 0.08 ELSE 0 END), 6) AS rule FROM d
""")
def rule_scores(t):
    """Intent boosts and cover matter, over whole texts."""
    d = F.col("doc_id") % 4
    head = F.concat("source", F.when(d == 0, " Index").when(d == 1, " Gross margin").otherwise(""))
    return t.wide("documents").select("doc_id", F.round(hybrid.rule_score("gross margin 2023 vs 2022", F.col("text"), head), 6).alias("rule"))


@query("""
WITH e AS (SELECT event_id, value AS d, event_id % 101 AS c FROM events), s AS (SELECT min(d) AS d0, max(d) AS d1, min(c) AS c0, max(c) AS c1 FROM e)
SELECT event_id, round(0.3 * (c - c0) / (c1 - c0) + 0.7 * (d - d0) / (d1 - d0), 6) AS fused FROM e, s
""")
def scores_fused(t):
    """Scaled dense and cross-encoder scores, weighed."""
    e = t("events").select("event_id", "value", (F.col("event_id") % 101).cast("double").alias("ce"))
    return dense.fused(e, "value", "ce", "mix", 0.3).select("event_id", F.round("fused", 6).alias("fused"))


@query("""
WITH e AS (SELECT event_id, user_id % 3 AS k, event_type, max(CASE WHEN event_type <> 'click' THEN event_id END) OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM events)
SELECT e.event_id, h.event_type AS held FROM e LEFT JOIN events h ON h.event_id = e.at
""")
def carried_forward(t):
    """Last value before each row of three large keys, without a task a key."""
    e = t("events").select("event_id", (F.col("user_id") % 3).alias("k"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("v"))
    return windows.carried_forward(e, ["k"], ["event_id"], "v", "held").select("event_id", "held")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines(t):
    """A table written as JSON lines and read strictly, by its schema."""
    path = _fresh(t, "json")
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write(n, path, "nation", ("json",))
    return files.json_rows(t.spark, f"{path}/nation.json", n.schema)


@query("""
SELECT CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS n_name, CASE WHEN n_nationkey % 4 = 0 THEN '{broken ' || n_nationkey END AS bad FROM nation
""")
def json_audited(t):
    """Broken lines are kept with their text."""
    path = _fresh(t, "lines")
    n = t("nation")
    line = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("{broken "), F.col("n_nationkey").cast("string"))).otherwise(F.to_json(F.struct("n_nationkey", "n_name")))
    n.select(line.alias("value")).write.text(path)
    return files.json_rows_audited(t.spark, path, n.select("n_nationkey", "n_name").schema, "bad")


@query("""
SELECT 'csv' AS format, count(*) AS n, sum(r_regionkey)::BIGINT AS keys, max(r_name) AS name FROM region
UNION ALL SELECT 'json', count(*), sum(r_regionkey)::BIGINT, max(r_name) FROM region UNION ALL SELECT 'parquet', count(*), sum(r_regionkey)::BIGINT, max(r_name) FROM region
""")
def sink_formats(t):
    """One frame in three formats, each read again by suffix; a second write stays out."""
    path = _fresh(t, "formats")
    r = t("region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    sinks.write(r, path, "region", ("csv", "json", "parquet"))
    sinks.write(r.where("false"), path, "region", ("csv", "json", "parquet"))
    read = [files.table(t.spark, f"{path}/region.{x}", r.schema).select(F.lit(x).alias("format"), "*") for x in ("csv", "json", "parquet")]
    return read[0].union(read[1]).union(read[2]).groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("r_regionkey").alias("keys"), F.max("r_name").alias("name"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 'new' END AS note, 'F' || n_regionkey AS filing_id FROM nation WHERE n_regionkey < 2")
def filing_store(t):
    """Two filings in the store, one loaded twice with a further column."""
    path, n = _fresh(t, "store"), t("nation")
    for key, rows in ((0, n.select("n_nationkey", "n_name")), (1, n.select("n_nationkey", "n_name")), (1, n.select("n_nationkey", "n_name", F.lit("new").alias("note")))):
        sinks.save_filing(t.spark, path, {"definition_edges": rows.join(n.where(f"n_regionkey = {key}").select("n_nationkey"), "n_nationkey", "left_semi")}, f"F{key}")
    return sinks.load_store(t.spark, path, "definition_edges").select("n_nationkey", "n_name", "note", "filing_id")


@query("SELECT count(*) AS records, max(len(embedding))::INTEGER AS dims FROM embeddings")
def index_written(t):
    """Build information of a written dense index."""
    path = _fresh(t, "dense")
    e = t("embeddings").select(F.col("vec_id").alias("rid"), F.col("embedding").alias("vector"))
    sinks.write_index(e, e.select("rid"), path)
    return t.spark.read.parquet(f"{path}/build_info").select("records", F.col("dims").cast(T.IntegerType()).alias("dims"))
