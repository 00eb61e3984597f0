"""Retrieval queries: BM25, dense, fusion, evidence and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as ks
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import bm25, dense, evidence, filters, hybrid, index, windows
from ..session import scratch_folder, version_of
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{tx.TOKEN}'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))"
TERMS = ("worthless", "token", "licensed", "license")
QUERY = "worthless token licensed License the"


def bm25_sql(where: str = "TRUE", limit: int = 20) -> str:
    q = ", ".join(f"('{t}')" for t in TERMS)
    return f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents WHERE {where}),
e AS (SELECT doc_id, toks, len(toks) AS n FROM d WHERE len(toks) > 0),
s AS (SELECT count(*) AS n, avg(n) AS mean FROM e),
p AS (SELECT doc_id, e.n AS dl, t.term, len(list_filter(toks, lambda x: x = t.term)) AS tf FROM e, (VALUES {q}) t(term)),
df AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY term),
r AS (SELECT p.doc_id, sum(ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1.0) * (p.tf * 2.5) / (p.tf + 1.5 * (1 - 0.75 + 0.75 * (p.dl / (s.mean + 1e-9))) + 1e-12)) AS score
      FROM p JOIN df ON p.term = df.term, s WHERE p.tf > 0 GROUP BY p.doc_id)
SELECT doc_id AS rid, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0
ORDER BY score DESC, doc_id LIMIT {limit}
"""


def _index(t) -> bm25.Index:
    """The stored BM25 index of ``documents``, made by the first query that asks."""
    return bm25.index_of(t("documents"), version_of(t.spark, t.path("documents")), "doc_id")


def _hits(t, topk: int):
    return _index(t).search(QUERY, topk)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(bm25_sql())
def bm25_topk(t):
    """Top 20 documents by BM25 over the whole table."""
    return _rounded(_hits(t, 20), "score")


@query(bm25_sql("upper(lang) = 'EN' AND upper(source) = 'SRC1'", 10))
def bm25_filtered(t):
    """Statistics follow the filtered candidates."""
    docs = filters.meta_filter(t("documents").withColumnsRenamed({"lang": "ticker", "source": "form"}), ticker="en", form="Src1")
    return _rounded(_index(t).search(QUERY, 10, docs.select(F.col("doc_id").alias("rid"))), "score")


@query(bm25_sql("contains(text, 'token')", 15))
def bm25_scan(t):
    """The same scores from the texts themselves, for a corpus asked once."""
    return _rounded(bm25.search(t.wide("documents").where(F.contains("text", F.lit("token"))), QUERY, 15, "doc_id"), "score")


@query(f"""
WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term)
SELECT count(*) AS n_postings, count(DISTINCT doc_id) AS n_docs, sum(tf)::BIGINT AS n_tokens FROM p
""")
def bm25_index(t):
    """A new index of the whole table, as the first search builds it: its totals."""
    built = bm25.build_index(t.wide("documents"), scratch_folder(t.spark, "bm25"), "doc_id")
    none = F.lit(None).cast("long")
    p = built.postings.agg(F.count(F.lit(1)).alias("n_postings"), none.alias("n_docs"), F.sum("tf").alias("n_tokens"))
    n = built.lengths.agg(none.alias("n_postings"), F.count_distinct("rid").alias("n_docs"), none.alias("n_tokens"))
    return p.unionByName(n).agg(*[F.sum(c).alias(c) for c in p.columns])


@query(f"""
WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM d GROUP BY term ORDER BY df DESC, term LIMIT 100
""")
def bm25_term_stats(t):
    """Document and corpus frequency of the 100 commonest terms."""
    p = bm25.postings(t.wide("documents"), "doc_id")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(100)


_DENSE = """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(q, q)) AS score FROM embeddings, q {where})
SELECT vec_id AS rid, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, vec_id LIMIT {k}
"""


def _query_vector(t) -> list[float]:
    return list(t("embeddings").where("vec_id = 0").first()["embedding"])


@query(_DENSE.format(where="", k=20))
def dense_topk(t):
    """Exact inner-product search for one vector."""
    return _rounded(dense.search(t("embeddings"), _query_vector(t), 20, "vec_id", "embedding"), "score")


@query(_DENSE.format(where="WHERE label = 3", k=10))
def dense_filtered(t):
    """The filter comes before the search, so no hit is lost to it."""
    return _rounded(dense.search(t("embeddings").where("label = 3"), _query_vector(t), 10, "vec_id", "embedding"), "score")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(q, q)) AS score FROM q, embeddings),
r AS (SELECT query_id, vec_id AS rid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def dense_many(t):
    """A stated query set (ids divisible by 20) against all rows, by blocks."""
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _rounded(dense.search_many(e, q, 5, "vec_id", "embedding"), "score")


def _lists(t):
    sparse = _hits(t, 50)
    near = dense.search(t("embeddings"), _query_vector(t), 50, "vec_id", "embedding")
    return sparse, near


_LISTS = f"WITH sp AS ({bm25_sql(limit=50)}), de AS ({_DENSE.format(where='', k=50)})"
_RRF = f"""{_LISTS}, f AS (
SELECT coalesce(sp.rid, de.rid) AS rid, coalesce(2.0 / (60 + sp.rank), 0.0) + coalesce(2.0 / (60 + de.rank), 0.0) AS rrf, sp.rank AS rank_bm25, de.rank AS rank_dense
FROM sp FULL OUTER JOIN de ON sp.rid = de.rid)"""


@query(_RRF + " SELECT rid, round(rrf, 6) AS rrf_score, rank_bm25, rank_dense FROM f ORDER BY rrf DESC, rid LIMIT 30")
def rrf_fuse(t):
    """Reciprocal-rank fusion of the sparse and the dense list."""
    return _rounded(hybrid.rrf(*_lists(t), keep=30), "rrf_score")


@query(_RRF + """, g AS (SELECT * FROM f ORDER BY rrf DESC, rid LIMIT 256),
c AS (SELECT rid, rrf, (rid * 37 % 101) / 7.0 AS ce FROM g),
b AS (SELECT min(ce) AS lo, max(ce) AS hi FROM c)
SELECT rid, round(rrf * 0.5 + CASE WHEN hi > lo THEN (ce - lo) / (hi - lo) ELSE ce END * 0.5, 6) AS final_score FROM c, b
ORDER BY rrf * 0.5 + CASE WHEN hi > lo THEN (ce - lo) / (hi - lo) ELSE ce END * 0.5 DESC, rid LIMIT 8""")
def hybrid_blend(t):
    """Fusion blended with a cross-encoder column (a stand-in from the id)."""
    pool = hybrid.rrf(*_lists(t)).withColumn("ce", (F.col("rid") * 37 % 101) / 7.0)
    return _rounded(hybrid.blended(pool, 0.5, "ce", 8).select("rid", "final_score"), "final_score")


@query(_RRF + " SELECT rid, round(rrf * 0.5, 6) AS final_score FROM f ORDER BY rrf DESC, rid LIMIT 8")
def hybrid_without_encoder(t):
    """Without a cross-encoder the fused score is still scaled by its weight."""
    return _rounded(hybrid.blended(hybrid.rrf(*_lists(t)), 0.5, None, 8).select("rid", "final_score"), "final_score")


@query(f"""
WITH sp AS ({bm25_sql(limit=50)}), a AS (SELECT doc_id, source AS s, lang FROM documents JOIN sp ON doc_id = rid),
b AS (SELECT doc_id, lang || ' ' || source || ' ' || n_chars AS s, source AS lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)
SELECT coalesce(a.doc_id, b.doc_id) AS rid, CASE WHEN length(coalesce(b.s, '')) > length(coalesce(a.s, '')) THEN b.s ELSE coalesce(a.s, '') END AS snippet, coalesce(b.lang, a.lang) AS meta
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id
""")
def candidate_pool(t):
    """Union of two candidate lists: longest snippet, last metadata."""
    d = t("documents")
    hits = _hits(t, 50).select(F.col("rid").alias("doc_id"))
    sparse = d.join(F.broadcast(hits), "doc_id").select(F.col("doc_id").alias("rid"), F.col("source").alias("snippet"), F.col("lang").alias("meta"))
    long = d.orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.col("doc_id").alias("rid"), F.concat_ws(" ", "lang", "source", F.col("n_chars").cast("string")).alias("snippet"), F.col("source").alias("meta"))
    return hybrid.pooled(sparse, long)


@query("""
WITH s AS (SELECT min(value) lo, max(value) hi, avg(value) m, stddev_pop(value) d FROM events)
SELECT event_id, round((value - lo) / (hi - lo), 6) AS scaled, round((value - m) / (d + 1e-12), 6) AS z FROM events, s
""")
def minmax_zscore(t):
    """Global scaling without bringing rows together."""
    e = t("events").select("event_id", "value")
    return _rounded(ag.zscore(ag.minmax(e, "value", "scaled"), "value", "z").drop("value"), "scaled", "z")


@query("""
SELECT event_id, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.5), 6) AS scaled
FROM events WINDOW w AS (PARTITION BY event_type)
""")
def minmax_grouped(t):
    """Scaling within a key; a constant group gives one half."""
    return _rounded(ag.minmax(t("events").select("event_id", "event_type", "value"), "value", "scaled", ["event_type"], 0.5).select("event_id", "scaled"), "scaled")


@query("""
SELECT label, mode FROM (SELECT label, event_type AS mode, row_number() OVER (PARTITION BY label ORDER BY n DESC, seen) AS r
FROM (SELECT user_id % 50 AS label, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2)) WHERE r = 1
""")
def mode_anchor(t):
    """Most frequent value with first-seen ties."""
    return ag.mode_of(t("events").withColumn("label", F.col("user_id") % 50), ["label"], "event_type", "event_id", "mode")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def topk_per_group(t):
    return windows.top_of(t("documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("doc_id")


_SIG = r"sha1(lang || '|' || array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), 1, 80), ' '))"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_SIG} ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2")
def sig_cap(t):
    """At most two documents of one signature."""
    d = t("documents").withColumn("sig", ks.signature([F.col("lang")], F.col("text"))).select("doc_id", "n_chars", "sig")
    return windows.top_of(d, ["sig"], [F.desc("n_chars"), "doc_id"], 2).select("doc_id")


@query(r"""
SELECT d.doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS overlap FROM (
SELECT x.doc_id, list_distinct(""" + _TOKENS.replace("text", "x.text") + ") AS a, list_distinct(" + _TOKENS.replace("text", "y.text") + ") AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1) d WHERE len(list_concat(a, b)) > 0")
def jaccard_pairs(t):
    """Word overlap of neighbouring documents."""
    bag = t("documents").select("doc_id", F.array_distinct(tx.tokens(F.col("text"))).alias("a"))
    nxt = bag.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return bag.join(nxt, "doc_id").where(F.size("a") + F.size("b") > 0).select("doc_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


_VERSIONS = "SELECT n_chars % 97 AS rid, doc_id, text, source, doc_id * 13 % 50 AS mtime, (source LIKE '%src1%')::INT + (source LIKE '%src12%')::INT AS priority FROM documents"


@query(f"SELECT rid, doc_id AS position, priority AS p FROM ({_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY priority DESC, mtime DESC, doc_id DESC) = 1")
def index_upsert_priority(t):
    """Versions of a record: path priority, then time, then order."""
    v = t("documents").select((F.col("n_chars") % 97).alias("rid"), F.col("doc_id").alias("position"), "text", F.col("source").alias("path"), (F.col("doc_id") * 13 % 50).alias("mtime"))
    return index.upserted(v, ["src1", "src12"]).select("rid", "position", ks.path_priority(F.col("path"), ["src1", "src12"]).alias("p"))


@query()
def index_upsert_fold(t):
    """The ordered fold; not an argmax, hence no SQL form (tested against a model)."""
    v = t("documents").select((F.col("n_chars") % 97).alias("rid"), F.col("doc_id").alias("position"), "text", F.col("source").alias("path"), (F.col("doc_id") * 13 % 50).alias("mtime"))
    return index.folded(v, ["src1", "src12"])


_RIDS = "SELECT printf('%010d-24-%06d::text::chunk-%d', doc_id, doc_id, doc_id % 7) AS rid, doc_id % 9 AS chunk_index FROM documents"


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT regexp_matches(rid, '{tx.RID}')) AS bad_format, count(*) FILTER (chunk_index <> regexp_extract(rid, '{tx.CHUNK_NO}', 1)::INT) AS mismatch FROM ({_RIDS})")
def index_audit(t):
    """Ill-formed ids and stored chunk numbers unlike the id's."""
    d = t("documents").select(F.format_string("%010d-24-%06d::text::chunk-%d", "doc_id", "doc_id", F.col("doc_id") % 7).alias("rid"), (F.col("doc_id") % 9).alias("chunk_index"))
    return index.audited(d)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_audit(t):
    """Index ids without a source row."""
    return index.missing(t("documents"), t("labels"), "doc_id")


@query("SELECT doc_id, text AS content FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND text <> ''")
def semi_content(t):
    """Contents of wanted records."""
    return index.contents(t("documents"), t("labels").where("quality = 1"), "doc_id")


@query("SELECT doc_id, ticker, src FROM (SELECT doc_id, coalesce(lang, 'xx') AS ticker, source AS src FROM documents)")
def meta_flatten(t):
    """Nested metadata lifted; the outer value wins where it is set."""
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("ticker"), F.struct(F.col("lang").alias("ticker"), F.col("source").alias("src")).alias("meta"))
    return index.flattened_meta(d).select("doc_id", F.coalesce("ticker", F.lit("xx")).alias("ticker"), "src")


@query("SELECT source, count(*) AS records FROM documents GROUP BY source")
def build_info(t):
    return index.build_info(t("documents"), "source")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 4000 AND contains(lower(text), 'tion') AND doc_id >= 5")
def filter_grammar(t):
    """Declared filters: in, between, contains, gte."""
    rules = {"lang": {"in": ["en", "fr"]}, "n_chars": {"between": (200, 4000)}, "text": {"contains": "Tion"}, "doc_id": {"gte": 5}}
    return t("documents").where(filters.predicate(rules)).select("doc_id")


def _records(t):
    """The records of one hybrid query: its top 50, which is the packer's input."""
    hits = _hits(t, 50).select(F.col("rid").alias("doc_id"), F.col("score").alias("final_score"), "rank")
    d = t("documents").join(F.broadcast(hits), "doc_id")
    rid = F.format_string("%010d-24-000001::text::chunk-%d", F.col("doc_id") % 40, F.floor(F.col("doc_id") / 40))
    return d.select(F.lit(0).alias("query_id"), rid.alias("rid"), F.col("source").alias("ticker"), F.lit("10-K").alias("form"), (2020 + F.col("doc_id") % 4).alias("fy"), F.col("lang").alias("heading"), F.col("text").alias("content"), tx.section_tag(F.col("text")).alias("section_tag"), tx.mentions_other_years(F.col("text")).alias("mentions_other_years"), "final_score", F.col("rank").alias("place"), F.col("doc_id").cast("string").alias("doc"))


@query()
def evidence_mmr(t):
    """Packed evidence of a query's records (tested against fixtures)."""
    return _rounded(evidence.packed(_records(t)), "score")


@query(f"""
WITH sp AS ({bm25_sql(limit=50)})
SELECT 0 AS query_id, string_agg('[' || doc_id || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS block FROM documents JOIN sp ON doc_id = rid
""")
def evidence_blocks(t):
    """A query's evidence formatted for a prompt."""
    return evidence.evidence_block(_records(t).select("query_id", "place", F.col("doc").alias("rid"), F.col("content").alias("text")))


@query(f"WITH sp AS ({bm25_sql(limit=50)}) SELECT doc_id::VARCHAR AS rid, substr(trim(text), 1, 240) AS quote FROM documents WHERE doc_id IN (SELECT rid FROM sp)")
def citation_guard(t):
    """Citations of every document; those whose id was packed stay, quotes cut."""
    d = t("documents").select(F.col("doc_id").cast("string").alias("rid"), F.col("text").alias("quote"))
    return evidence.guarded_citations(d, _records(t).select(F.col("doc").alias("rid")))
