"""Fact and label queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as ks
from ..functions import numbers as nu
from ..functions import periods as pe
from ..operators import aggregates as ag
from ..operators import facts, index, labels, windows
from .registry import query

_FACTS = "SELECT l_suppkey AS filing_id, l_orderkey AS context_id, l_returnflag AS unit_id, 'tag:' || l_linestatus AS qname, l_extendedprice AS value_num, l_quantity > 10 AS is_numeric, l_linenumber AS doc_order FROM lineitem"
_LABELS = "SELECT s_suppkey AS filing_id, 'tag:' || v.s AS qname, v.role, v.lang, v.t || s_suppkey AS label_text FROM supplier, (VALUES ('O','standard','en','a'),('O','terse',NULL,'b'),('O','total','en','c'),('F','total','de','d'),('F','verbose','en','e')) v(s, role, lang, t) WHERE s_acctbal > 0"


def _store(t):
    li, o, s = t("lineitem"), t("orders"), t("supplier")
    f = li.select(F.col("l_suppkey").alias("filing_id"), F.col("l_orderkey").alias("context_id"), F.col("l_returnflag").alias("unit_id"), F.concat(F.lit("tag:"), "l_linestatus").alias("qname"), F.col("l_extendedprice").alias("value_num"), (F.col("l_quantity") > 10).alias("is_numeric"), F.col("l_linenumber").alias("doc_order"))
    pairs = li.select(F.col("l_suppkey").alias("filing_id"), F.col("l_orderkey").alias("context_id")).distinct()
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ctx = pairs.join(o, F.col("context_id") == F.col("o_orderkey")).select("filing_id", "context_id", day.alias("period_start"), F.lit(None).cast("string").alias("period_end"), F.lit(None).cast("string").alias("instant"))
    units = li.select(F.col("l_suppkey").alias("filing_id"), F.col("l_returnflag").alias("unit_id")).distinct().where("unit_id <> 'R'").withColumn("measure", F.concat(F.lit("u"), "unit_id"))
    rows = [("O", "standard", "en", "a"), ("O", "terse", None, "b"), ("O", "total", "en", "c"), ("F", "total", "de", "d"), ("F", "verbose", "en", "e")]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("role"), F.lit(c).cast("string").alias("lang"), F.lit(d).alias("t")) for a, b, c, d in rows]))
    lab = s.where("s_acctbal > 0").withColumn("v", each).select(F.col("s_suppkey").alias("filing_id"), F.concat(F.lit("tag:"), "v.s").alias("qname"), "v.role", "v.lang", F.concat("v.t", F.col("s_suppkey").cast("string")).alias("label_text"))
    return f, ctx, units, lab


@query(f"""
WITH f AS ({_FACTS}), l AS ({_LABELS}),
c AS (SELECT DISTINCT l_suppkey AS filing_id, l_orderkey AS context_id, strftime(o_orderdate, '%Y-%m-%d') AS period_start FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT DISTINCT l_suppkey AS filing_id, l_returnflag AS unit_id, 'u' || l_returnflag AS measure FROM lineitem WHERE l_returnflag <> 'R'),
r AS (SELECT *, row_number() OVER (PARTITION BY filing_id, qname ORDER BY CASE role WHEN 'standard' THEN 0 WHEN 'terse' THEN 1 ELSE 2 END, coalesce(lang, ''), label_text) AS rn FROM l)
SELECT measure, best_role, substr(period_start, 1, 4) AS year, count(*) AS n, count(best_label) AS labelled, round(sum(value_num), 2) AS total
FROM (SELECT f.*, c.period_start, u.measure, r.label_text AS best_label, r.role AS best_role FROM f LEFT JOIN c USING (filing_id, context_id) LEFT JOIN u USING (filing_id, unit_id) LEFT JOIN r ON f.filing_id = r.filing_id AND f.qname = r.qname AND r.rn = 1) GROUP BY 1, 2, 3
""")
def fact_join_labels(t):
    """Facts with context, unit and best label, summed by measure and year."""
    out = facts.fact_records(t("lineitem").sparkSession, *_store(t))
    return out.groupBy("measure", "best_role", F.substring("period_start", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count("best_label").alias("labelled"), F.round(F.sum("value_num"), 2).alias("total"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_brand = 'Brand#7' ORDER BY p_size NULLS LAST, p_name, p_partkey LIMIT 50")
def fact_like_limit(t):
    """Substring, equality, ordered limit."""
    p = t("part").where(F.contains(F.lower("p_name"), F.lit("ring")) & (F.col("p_brand") == "Brand#7"))
    return p.orderBy(F.asc_nulls_last("p_size"), "p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


_ORDERS = "SELECT o_custkey AS concept, CASE o_orderpriority WHEN '1-URGENT' THEN 'standard' WHEN '2-HIGH' THEN 'terse' WHEN '5-LOW' THEN 'documentation' ELSE 'other' END AS role, CASE WHEN o_orderstatus = 'O' THEN 'en' WHEN o_orderstatus = 'F' THEN 'en-US' END AS lang, 'x' || o_orderkey AS label_text FROM orders"
_RANKED = """(CASE WHEN role IS NULL THEN 500 WHEN role = 'standard' THEN 0 WHEN role = 'terse' THEN 1 WHEN role = 'documentation' THEN 3 ELSE 999 END) AS r, (CASE WHEN lang IS NULL THEN 500 WHEN lang = 'en-US' THEN 0 WHEN lang = 'en' THEN 1 ELSE 999 END) AS l"""


def _orders(t):
    o = t("orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.select(F.col("o_custkey").alias("concept"), F.when(p == "1-URGENT", "standard").when(p == "2-HIGH", "terse").when(p == "5-LOW", "documentation").otherwise("other").alias("role"), F.when(s == "O", "en").when(s == "F", "en-US").alias("lang"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("label_text"))


@query(f"""
SELECT concept, label_text AS label_best, role AS role_best FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY r, l, label_text) AS n FROM (SELECT *, {_RANKED} FROM ({_ORDERS}))) WHERE n = 1
""")
def best_label(t):
    """Best label by role rank, then language rank."""
    return labels.best_labels(_orders(t), ["concept"]).select("concept", "label_best", "role_best")


@query(f"SELECT concept, label_text AS label_doc FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY length(label_text) DESC, label_text DESC) AS n FROM ({_ORDERS}) WHERE role = 'documentation') WHERE n = 1")
def longest_doc(t):
    """Longest documentation label of each concept."""
    return labels.best_labels(_orders(t), ["concept"]).where("label_doc is not null").select("concept", "label_doc")


@query(f"""
WITH o AS ({_ORDERS})
SELECT concept, min(label_text) FILTER (role = 'standard' AND lang = 'en') AS label_standard_en, min(label_text) FILTER (role = 'terse' AND lang = 'en-US') AS "label_terse_en-US" FROM o WHERE lang IS NOT NULL GROUP BY concept
""")
def pivot_min(t):
    """One column a role and language with the least label; null keys drop out."""
    o = _orders(t).where("lang is not null").withColumn("name", F.concat_ws("_", F.lit("label"), "role", "lang"))
    return ag.pivot_least(o, ["concept"], "name", "label_text", ["label_standard_en", "label_terse_en-US"])


@query(f"""
WITH o AS ({_ORDERS}), w AS (SELECT concept, min(label_text) FILTER (role = 'standard' AND lang = 'en') AS a, min(label_text) FILTER (role = 'terse' AND lang = 'en') AS b FROM o WHERE lang IS NOT NULL GROUP BY concept)
SELECT concept, 'standard' AS role, 'en' AS lang, a AS label_text FROM w WHERE a IS NOT NULL UNION ALL SELECT concept, 'terse', 'en', b FROM w WHERE b IS NOT NULL
""")
def labels_from_wide(t):
    """A wide label table back to long rows."""
    o = _orders(t).where("lang is not null").withColumn("name", F.concat_ws("_", F.lit("label"), "role", "lang"))
    wide = ag.pivot_least(o, ["concept"], "name", "label_text", ["label_standard_en", "label_terse_en"])
    return labels.from_wide(wide, ["concept"])


@query("SELECT DISTINCT n_regionkey::VARCHAR AS parent, n_nationkey::VARCHAR AS child, n_nationkey::DOUBLE AS \"order\", CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE END AS weight FROM nation")
def edges_cleaned(t):
    """Edges with coerced numbers, distinct."""
    n = t("nation").select(F.col("n_regionkey").cast("string").alias("parent"), F.col("n_nationkey").cast("string").alias("child"), F.col("n_nationkey").cast("string").alias("order"), F.when(F.col("n_nationkey") % 2 == 0, "1").otherwise("n/a").alias("weight"))
    return labels.clean_edges(n.union(n), labels.CALCULATION)


@query("""
WITH e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation), q AS (SELECT 'n' || n_nationkey AS concept FROM nation UNION SELECT 'r1')
SELECT concept, child AS related, 'child' AS kind FROM q JOIN e ON parent = concept UNION SELECT concept, parent, 'parent' FROM q JOIN e ON child = concept
UNION SELECT q.concept, b.child, 'sibling' FROM q JOIN e a ON a.child = q.concept JOIN e b ON b.parent = a.parent WHERE b.child <> q.concept
""")
def onehop_expand(t):
    """Children, parents and siblings of concepts."""
    n = t("nation")
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    q = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("concept")).union(n.sparkSession.createDataFrame([("r1",)], "concept string"))
    return labels.one_hop(e, q)


@query("""
SELECT a.n_name AS from_concept, r.r_name AS to_concept, 'member' AS arcrole, a.n_nationkey::DOUBLE AS "order" FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey
""")
def arcs_resolved(t):
    """Arcs whose ends are found through locators."""
    n, r = t("nation"), t("region")
    loc = n.select(F.lit("d").alias("doc"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("concept")).union(r.select(F.lit("d"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), "r_name"))
    arc = n.select(F.lit("d").alias("doc"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to"), F.lit("member").alias("arcrole"), F.col("n_nationkey").cast("double").alias("order"))
    return labels.joined_arcs(labels.edges_of(arc, ["member"]), loc).select("from_concept", "to_concept", "arcrole", "order")


_Q = "CASE WHEN dt = close + 1 THEN 4 ELSE (((month(dt) - 9 - 1) % 12 + 12) % 12) // 3 + 1 END"


@query(f"""
SELECT o_orderkey, year(dt)::INTEGER AS fy, 'Q' || quarter(dt) AS cq, 'Q' || ({_Q}) AS fq, 'FY' || year(dt) || ' instant ' || strftime(dt, '%Y-%m-%d') AS label, strftime(dt, '%Y%m%d') AS compact
FROM (SELECT o_orderkey, o_orderdate::DATE AS dt, make_date(year(o_orderdate), 9, 30) AS close FROM orders)
""")
def fiscal_quarter(t):
    """Calendar and year-end-shifted quarters, labels and compact dates."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    no = F.lit(None).cast("string")
    return t("orders").select("o_orderkey", pe.fiscal_year(no, d, no).alias("fy"), pe.calendar_quarter(no, d, no).alias("cq"), pe.fiscal_quarter(no, d, no, F.lit("--09-30")).alias("fq"), pe.period_label(no, no, d, pe.fiscal_year(no, no, d)).alias("label"), pe.compact_day(d).alias("compact"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'")
def year_bounds(t):
    """A half-open year; the bounds are pushed to the scan."""
    return t("orders").where(pe.in_year(F.col("o_orderdate"), 1995)).select("o_orderkey")


@query("SELECT event_id, k, 'a=' || k || '|b=' || event_type AS signature, (2020 + k % 5)::VARCHAR || '-12-31' AS period_end FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS kk, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def json_context(t):
    """JSON objects to maps, signatures in key order, periods of contexts."""
    e = t("events").withColumn("m", ks.dims_of(F.col("props")))
    k = F.col("m")["k"]
    dims = F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), k)
    ctx = F.format_string('{"period": {"start_date": "2020-01-01", "end_date": "%d-12-31"}}', 2020 + k.cast("long") % 5)
    return e.select("event_id", k.cast("long").alias("k"), ks.dims_signature(dims).alias("signature"), ks.context_period(ctx)["end"].alias("period_end"))


_TEXTS = "CASE event_id % 6 WHEN 0 THEN '(' || printf('%d', floor(value)::BIGINT) || ')' WHEN 1 THEN '$' || printf('%d', floor(value)::BIGINT) || '.5K' WHEN 2 THEN printf('%d', floor(value)::BIGINT) || ' M' WHEN 3 THEN '1,234.5' WHEN 4 THEN 'n/a' ELSE printf('%d', floor(value)::BIGINT) || '.25%' END"


def _texts():
    e, v = F.col("event_id") % 6, F.floor("value")
    return F.when(e == 0, F.format_string("(%d)", v)).when(e == 1, F.format_string("$%d.5K", v)).when(e == 2, F.format_string("%d M", v)).when(e == 3, "1,234.5").when(e == 4, "n/a").otherwise(F.format_string("%d.25%%", v))


@query(f"""
SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN 0.0 - TRY_CAST(s[2:-2] AS DOUBLE) WHEN 1 THEN TRY_CAST(s[2:-2] AS DOUBLE) * 1000 WHEN 2 THEN TRY_CAST(s[:-3] AS DOUBLE) * 1000000 WHEN 3 THEN 1234.5 WHEN 4 THEN NULL ELSE TRY_CAST(s[:-2] AS DOUBLE) END, 4) AS human,
round(CASE WHEN s LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(s[:-2] AS DOUBLE) / 100 ELSE TRY_CAST(regexp_replace(s, '[,%]', '', 'g') AS DOUBLE) END, 6) AS fraction
FROM (SELECT event_id, {_TEXTS} AS s FROM events)
""")
def human_numbers(t):
    """Parenthesised, scaled and percent numbers."""
    return t("events").select("event_id", F.round(nu.human_number(_texts()), 4).alias("human"), F.round(nu.plain_number(_texts(), True), 6).alias("fraction"))


@query(r"""
SELECT event_id, list_transform(regexp_extract_all(s, '([0-9]+(?:\.[0-9]+)?)\s*%', 1), lambda v: round(v::DOUBLE / 100, 6)) AS percents,
list_sort(list_distinct(list_filter([CASE WHEN event_id % 3 = 0 THEN 'CNY' END, CASE WHEN event_id % 3 = 1 THEN 'EUR' END, CASE WHEN event_id % 2 = 0 THEN 'USD' END], lambda c: c IS NOT NULL))) AS codes,
[(event_id % 4)::INTEGER * 365 + 45] AS days
FROM (SELECT event_id, event_id % 40 || '.5 % and ' || event_id % 7 || '% of' AS s FROM events)
""")
def number_features(t):
    """Percents, currency codes and ISO durations of a sentence."""
    e = F.col("event_id")
    s = F.concat((e % 40).cast("string"), F.lit(".5 % and "), (e % 7).cast("string"), F.lit("% of"))
    money = F.concat(F.when(e % 3 == 0, "RMB ").when(e % 3 == 1, "5 € ").otherwise(""), F.when(e % 2 == 0, "$4").otherwise(""))
    return t("events").select("event_id", F.transform(nu.percents(s), lambda v: F.round(v, 6)).alias("percents"), nu.currencies(money).alias("codes"), nu.iso_days(F.concat(F.lit("over P"), (e % 4).cast("string"), F.lit("Y1M15D"))).alias("days"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'x' WHEN 2 THEN 'shares' WHEN 3 THEN '%' ELSE 'pure' END AS unit, CASE event_id % 5 WHEN 0 THEN 'currency' WHEN 1 THEN NULL WHEN 2 THEN 'shares' WHEN 3 THEN 'percent' ELSE 'pure' END AS family,
CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN -3 ELSE 2 END::INTEGER AS decimals FROM events
""")
def unit_norm(t):
    """Unit families and decimals."""
    e = F.col("event_id")
    unit = F.when(e % 5 == 0, "iso4217:USD").when(e % 5 == 1, "x").when(e % 5 == 2, "xbrli:shares").when(e % 5 == 3, "").otherwise("xbrli:pure")
    shown = F.when(e % 5 == 3, "4%").otherwise("4")
    return t("events").select("event_id", nu.unit_family(unit, F.lit("a:b"), shown)["unit"].alias("unit"), nu.unit_family(unit, F.lit("a:b"), shown)["family"].alias("family"), nu.decimals(F.when(e % 3 == 0, "INF").when(e % 3 == 1, "-3").otherwise("2")).alias("decimals"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cashflow' WHEN 1 THEN 'income' WHEN 2 THEN 'balance' ELSE 'other' END AS hint FROM part")
def statement_hints(t):
    p = F.col("p_partkey") % 4
    return t("part").select("p_partkey", ks.statement_hint(F.when(p == 0, "a:NetCashProvided").when(p == 1, "a:Revenues").when(p == 2, "a:Assets").otherwise("a:Name")).alias("hint"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 20243 WHEN 1 THEN 3000 ELSE 20220 + 1000 END::INTEGER AS weight FROM events")
def header_weights(t):
    e = F.col("event_id") % 3
    return t("events").select("event_id", pe.header_weight(F.when(e == 0, "Q3 2024").when(e == 1, "Current period").otherwise("Prior year 2022")).alias("weight"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1
""")
def fact_dedup(t):
    """First fact of each key in source order."""
    li = t("lineitem")
    return windows.first_of(li, ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


_QUALITY = """
WITH d AS (SELECT source, lang, n_chars, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS value, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '2020' END AS fy FROM documents),
q AS (SELECT source, count(*) AS n_rows, round((round(100.0 * count(lang) / count(*), 2) + round(100.0 * count(value) / count(*), 2)) / 2, 2) AS nonnull_pct, round(100.0 * count(TRY_CAST(fy AS INTEGER)) / count(*), 2) AS year_pct,
round(100.0 * count(value) / greatest(count(n_chars), 1), 2) AS number_pct, round(100.0 * (count(*) - count(DISTINCT coalesce(lang, '') || '|' || n_chars)) / count(*), 2) AS duplicate_pct FROM d GROUP BY source)
"""


@query(_QUALITY + "SELECT *, 100.0::DOUBLE AS presence_pct, round(least(100, greatest(0, 15 + 0.35 * nonnull_pct + 0.10 * year_pct + 0.40 * number_pct - least(10, 0.2 * duplicate_pct))), 2) AS score FROM q")
def quality_score(t):
    """Quality of each source in one pass."""
    return ag.quality(_quality_rows(t), "source", ["lang", "value"], ["lang", "n_chars"], "fy", "value", ("n_chars",))


def _quality_rows(t):
    d = F.col("doc_id")
    return t("documents").select("source", "lang", "n_chars", F.when(d % 11 != 0, d).alias("value"), F.when(d % 7 == 0, "x").otherwise("2020").alias("fy"))


@query(_QUALITY + "SELECT round(sum(nonnull_pct * n_rows) / sum(n_rows), 2) AS nonnull_pct, round(sum(number_pct * n_rows) / sum(n_rows), 2) AS number_pct, sum(n_rows)::BIGINT AS n_rows FROM q")
def weighted_avg(t):
    """Row-weighted averages of the quality figures."""
    return ag.weighted(ag.quality(_quality_rows(t), "source", ["lang", "value"], ["lang", "n_chars"], "fy", "value", ("n_chars",)), ["nonnull_pct", "number_pct"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stage_counters(t):
    return ag.counters(t("events"), "event_type")


@query("SELECT user_id, props FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value >= 20) WHERE r = 1")
def first_known(t):
    """First non-null value of each key."""
    e = t("events").select("user_id", "event_id", F.when(F.col("value") >= 20, F.col("props")).alias("props"))
    return ag.first_known(e, ["user_id"], "props", "event_id")


_DEI = "d AS (SELECT user_id, max(event_type) AS t, max(event_id) AS m FROM events WHERE event_type <> 'error' AND value > 30 GROUP BY user_id)"


@query(f"WITH {_DEI} SELECT event_id, coalesce(t, CASE WHEN event_id % 2 = 0 THEN event_type END) AS fq FROM events LEFT JOIN d USING (user_id)")
def dei_merge(t):
    """Filing values put over the rows' own."""
    return index.merged(*_dei(t), "user_id", True).select("event_id", "fq")


@query(f"WITH {_DEI} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE t END AS fq FROM events LEFT JOIN d USING (user_id)")
def dei_fill(t):
    """Filing values only where the row has none."""
    return index.merged(*_dei(t), "user_id", False).select("event_id", "fq")


def _dei(t):
    e = t("events")
    rows = e.select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("fq"))
    return rows, e.where("event_type <> 'error' and value > 30").groupBy("user_id").agg(F.max("event_type").alias("dei_fq"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def fact_totals(t):
    """Sums of numeric facts by two dimensions under a date bound."""
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query()
def facts_normalised(t):
    """The fact normaliser over order lines (expressions tested one by one)."""
    li = t("lineitem").select(F.concat(F.lit("us-gaap:"), F.when(F.col("l_linestatus") == "O", "RevenuesPercent").otherwise("Assets")).alias("concept"), F.format_string("%.2f", "l_extendedprice").alias("value"), F.lit("iso4217:USD").alias("uom"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("instant"), F.col("l_orderkey").cast("string").alias("accno"), F.lit("INF").alias("decimals"))
    return facts.normalised(li)


@query()
def amount_tokens(t):
    """Number tokens with scale, currency and context (tested against fixtures)."""
    return t("benchmark").select("item_id", nu.amount_details(F.concat(F.lit("In 2024 paid $3.5 million under Rule 12b-2, "), F.col("text"))).alias("numbers"))


@query()
def short_values(t):
    """Display values (Python's rounding decides; tested against it)."""
    return t("lineitem").select("l_orderkey", "l_linenumber", nu.short_value()(F.col("l_extendedprice") * 1000).alias("shown"))
