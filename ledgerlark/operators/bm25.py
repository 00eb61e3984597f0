"""BM25 over a DataFrame of texts, or over a stored index of it; statistics
follow the filtered candidates either way."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_window, tokens
from ..session import exists, removed, shared_folder, spread

K1, B = 1.5, 0.75


def postings(docs: DataFrame, rid: str = "rid", text: str = "text") -> DataFrame:
    """``rid, term, tf, length`` of every document that has tokens.

    Persist or write this partitioned by term to answer many queries.
    """
    t = docs.select(F.col(rid).alias("rid"), tokens(F.col(text)).alias("toks")).where(F.size("toks") > 0)
    each = t.select("rid", F.size("toks").alias("length"), F.explode("toks").alias("term"))
    return each.groupBy("rid", "length", "term").agg(F.count(F.lit(1)).alias("tf")).select("rid", "term", "tf", "length")


def counted(docs: DataFrame, rid: str = "rid", text: str = "text") -> DataFrame:
    """``rid, length, counts(term, tf)``: each document's terms, counted in its row."""
    t = docs.select(F.col(rid).alias("rid"), F.sort_array(tokens(F.col(text))).alias("toks"))
    starts = F.filter(F.transform("toks", lambda w, i: F.when((i == 0) | (w != F.get("toks", i - 1)), i)), lambda i: i.isNotNull())
    runs = t.select("rid", "toks", starts.alias("starts"))
    counts = F.transform("starts", lambda s, j: F.struct(F.get("toks", s).alias("term"), (F.coalesce(F.get("starts", j + 1), F.size("toks")) - s).cast("long").alias("tf")))
    return runs.select("rid", F.size("toks").alias("length"), counts.alias("counts"))


@dataclass
class Index:
    """A stored index: ``postings(term, rid, tf, length)`` in order of term, and
    ``lengths(rid, length)`` of every document that has tokens."""

    postings: DataFrame
    lengths: DataFrame

    def search(self, query: str, topk: int = 8, candidates: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """``rid, score, rank`` as ``search`` gives them; reads the query's terms only.

        ``candidates(rid)`` are the documents that count, for the statistics too.
        """
        held, lengths = self.postings.where(F.col("term").isin(query_terms(self.postings.sparkSession, query))), self.lengths
        if candidates is not None:
            ids = candidates.select("rid").distinct()
            held, lengths = held.join(ids, "rid", "left_semi"), lengths.join(ids, "rid", "left_semi")
        whole = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")))  # one row
        idf = F.broadcast(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row a term of the query
        tf, norm = F.col("tf"), k1 * (1 - b + b * (F.col("length") / (F.col("mean") + 1e-9)))
        weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * (tf * (k1 + 1.0)) / (tf + norm + 1e-12)
        scored = held.join(idf, "term").join(whole).groupBy("rid").agg(F.sum(weight).alias("score"))
        return _ranked(scored.where("score > 0").orderBy(F.desc("score"), "rid").limit(topk), "score")


def build_index(docs: DataFrame, path: str, rid: str = "rid", text: str = "text") -> Index:
    """Write the index of ``docs``, whose ids are unique, under ``path``.

    Postings are range-partitioned and sorted by term and id: a query's terms
    prune row groups by their statistics, and a frequent term spreads over files.
    Terms are counted in their document's row and kept a while, so postings are
    exchanged once and the texts read once.
    """
    spark = docs.sparkSession
    counted(docs, rid, text).write.mode("overwrite").parquet(f"{path}/counts")
    held = spark.read.parquet(f"{path}/counts").where("length > 0")
    p = held.select("rid", "length", F.inline("counts")).repartitionByRange("term", "rid")
    if held.groupBy("rid", "length").count().where("count > 1").take(1):  # the ranges hold all of a term and id
        p = p.groupBy("term", "rid", "length").agg(F.sum("tf").alias("tf"))
    p.select("term", "rid", "tf", "length").sortWithinPartitions("term", "rid").write.mode("overwrite").parquet(f"{path}/postings")
    held.groupBy("rid").agg(F.first("length").alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")
    removed(spark, f"{path}/counts")
    return load_index(spark, path)


def load_index(spark, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def index_of(docs: DataFrame, version: str, rid: str = "rid", text: str = "text") -> Index:
    """The index of ``docs`` in the shared folder, built where it is not there yet.

    ``version`` names the state of the documents; a build that did not end, which
    leaves no lengths behind it, is made again.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/bm25-{hashlib.sha1(f'{version}|{rid}|{text}'.encode()).hexdigest()[:16]}"
    return load_index(spark, path) if exists(spark, f"{path}/lengths/_SUCCESS") else build_index(spread(docs), path, rid, text)


def scores(docs: DataFrame, query: str, rid: str = "rid", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``rid, score`` of documents that hold a query term.

    Term counts are taken inside each document by array functions for the
    query's terms only, so the corpus is not exploded: one scan yields document
    lengths and frequencies, one small aggregate the corpus statistics.
    """
    terms = query_terms(docs.sparkSession, query)
    base = docs.select(F.col(rid).alias("rid"), tokens(F.col(text)).alias("toks")).where(F.size("toks") > 0)
    tf = [F.size(F.filter("toks", _equals(w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    per = base.select("rid", F.size("toks").alias("length"), *tf)
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    norm = k1 * (1 - b + b * (F.col("length") / (F.col("mean") + 1e-9)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1.0)
        score = score + F.when(F.col(f"tf{i}") > 0, idf * (F.col(f"tf{i}") * (k1 + 1.0)) / (F.col(f"tf{i}") + norm + 1e-12)).otherwise(0.0)
    return per.join(F.broadcast(stats)).select("rid", score.alias("score")).where("score > 0")


def _equals(word: str):
    return lambda token: token == word


def query_terms(spark, query: str) -> list[str]:
    """Distinct tokens of a query in order, by the documents' own tokenizer."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()
    return row["t"]


def search(docs: DataFrame, query: str, topk: int = 8, rid: str = "rid", text: str = "text", snippet: bool = False) -> DataFrame:
    """Top documents as ``rid, score, rank``, ties by id; optional snippets.

    ``orderBy().limit()`` keeps ``topk`` rows a task before they meet.
    """
    top = scores(docs, query, rid, text).orderBy(F.desc("score"), "rid").limit(topk)
    ranked = _ranked(top, "score")
    if not snippet:
        return ranked
    terms = F.array(*[F.lit(t) for t in query_terms(docs.sparkSession, query)])
    texts = docs.select(F.col(rid).alias("rid"), best_window(F.col(text), terms).alias("snippet"))
    return texts.join(F.broadcast(ranked), "rid").select("rid", "score", "rank", "snippet")


def _ranked(top: DataFrame, score: str) -> DataFrame:
    """Ranks of an already limited list (at most ``topk`` rows)."""
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), "rid")))
