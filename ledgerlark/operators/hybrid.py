"""Reciprocal-rank fusion of sparse and dense lists, and the final blend."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import minmax


def rrf(sparse: DataFrame, dense: DataFrame, k: float = 60.0, w_sparse: float = 2.0, w_dense: float = 2.0, keep: int = 256) -> DataFrame:
    """``rid, rrf_score, rank_bm25, rank_dense`` of the best ``keep`` candidates.

    A full outer join of two ranked lists; a list a record is absent from adds 0.
    """
    a = sparse.select("rid", F.col("rank").alias("rank_bm25"))
    b = dense.select("rid", F.col("rank").alias("rank_dense"))
    part = lambda w, c: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    pool = a.join(b, "rid", "full_outer").withColumn("rrf_score", part(w_sparse, "rank_bm25") + part(w_dense, "rank_dense"))
    return pool.orderBy(F.desc("rrf_score"), "rid").limit(max(1, keep))


def pooled(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Candidates with the longer snippet of both lists and the dense metadata
    where both have some."""
    a = sparse.select("rid", F.col("snippet").alias("s1"), F.col("meta").alias("m1"))
    b = dense.select("rid", F.col("snippet").alias("s2"), F.col("meta").alias("m2"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return a.join(b, "rid", "full_outer").select("rid", F.when(size("s2") > size("s1"), F.col("s2")).otherwise(F.coalesce("s1", F.lit(""))).alias("snippet"), F.coalesce("m2", "m1").alias("meta"))


def blended(pool: DataFrame, ce_weight: float = 0.5, ce: str | None = None, topk: int = 8) -> DataFrame:
    """``final_score`` = rrf * (1 - weight) + ce * weight, the top rows.

    The cross-encoder column is scaled to [0, 1] unless it is constant; without
    one its share is 0 and the fused score is still scaled down.
    """
    if ce and ce_weight > 1e-6:
        pool = minmax(pool, ce, "ce_score", constant=None)
    else:
        pool = pool.withColumn("ce_score", F.lit(0.0))
    out = pool.withColumn("final_score", F.col("rrf_score") * (1 - ce_weight) + F.col("ce_score") * ce_weight)
    return out.orderBy(F.desc("final_score"), "rid").limit(topk)


#: (query pattern, text pattern, heading pattern) of each intent.
INTENTS = (
    (r"\b(versus|vs|compared to|year[- ]over[- ]year|yoy)\b", r"compared to|\b20[0-9]{2}\b.*\b20[0-9]{2}\b.*\b20[0-9]{2}\b", None),
    (r"\b(fx|foreign currency|exchange rates?)\b", r"foreign|currency|u\.s\. dollar|usd", None),
    (r"\b(gm|gross margins?)\b", "%", "gross margin"),
    (r"\b(research and development|r&d)\b", "research and development", "operating expenses"),
)


def rule_score(query: str, text: Column, heading: Column, concepts: Column | None = None, main_labels: Column | None = None) -> Column:
    """Intent boosts of 0.08, 0.15 for annotated concepts and 0.05 where the heading
    holds one's label, -0.15 for cover matter; -0.2 at least."""
    low, head = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(heading, F.lit("")))
    rule = F.when(head.rlike("cover|index|signature|table of contents"), -0.15).otherwise(0.0)
    for asked, body, title in INTENTS:
        if re.search(asked, query.lower()):
            met = low.rlike(f"(?s){body}")
            rule = rule + F.when(met | head.contains(title) if title else met, 0.08).otherwise(0.0)
    if concepts is not None:
        rule = rule + F.when(F.size(concepts) > 0, 0.15).otherwise(0.0)
    if main_labels is not None:
        rule = rule + F.when(F.exists(main_labels, lambda m: F.contains(head, F.lower(m))), 0.05).otherwise(0.0)
    return F.greatest(rule, F.lit(-0.2))


def rule_reranked(hits: DataFrame, query: str, dense: str = "score_dense", sparse: str = "score_sparse", text: str = "content", heading: str = "heading") -> DataFrame:
    """0.6 dense + 0.3 sparse, each scaled, plus the rule score; best first."""
    out = minmax(minmax(hits, dense, "_d", constant=0.0), sparse, "_s", constant=0.0)
    extra = [F.col(c) if c in hits.columns else None for c in ("concepts", "main_labels")]
    out = out.withColumn("rule_score", rule_score(query, F.col(text), F.col(heading), *extra))
    return out.withColumn("score", 0.6 * F.col("_d") + 0.3 * F.col("_s") + F.col("rule_score")).drop("_d", "_s").orderBy(F.desc("score"), "rid")
