"""Exact inner-product search and score fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .aggregates import minmax, zscore
from .bm25 import _ranked


def inner_product(vector: Column, query: list[float]) -> Column:
    """Sum of products in double precision, in index order; JVM-side."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, query: list[float], topk: int = 8, rid: str = "rid", vector: str = "vector") -> DataFrame:
    """``rid, score, rank`` of the nearest vectors; scores that are null or not
    finite do not count, equal ones go by id.  Filter ``vectors`` first: the
    search is exact, so no over-fetch is needed and no hit is lost to filters."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    scored = vectors.select(F.col(rid).alias("rid"), inner_product(F.col(vector), q.tolist()).alias("score"))
    return _ranked(scored.where("score is not null and not isnan(score) and abs(score) < double('Infinity')").orderBy(F.desc("score"), "rid").limit(topk), "score")


def search_many(vectors: DataFrame, queries: DataFrame, topk: int, rid: str = "rid", vector: str = "vector", max_queries: int | None = None, block: int = 8192) -> DataFrame:
    """``query_id, rid, score, rank`` for any set of queries by blocked products.

    ``block`` query vectors at a time are sent to the tasks; each task keeps its
    best, of equal scores the smaller ids, and multiplies 512 rows at a time.
    Scores that are not finite do not count.  The
    results of more than one block are checkpointed in turn, so the driver holds
    one block and one partition of queries.  ``max_queries``, if given, is checked.
    """
    if max_queries is not None and queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries; search in parts")
    # one row per distinct id, so that a repeated id is in one block only
    kind = dict(queries.dtypes)["query_id"]
    rows = queries.groupBy("query_id").agg(F.collect_list("vector").alias("vectors")).toLocalIterator()
    held: list[tuple] = []
    done: DataFrame | None = None
    for r in rows:
        held += [(r["query_id"], v) for v in r["vectors"]]
        if len(held) >= block:
            done = _settled(_search_block(vectors, held, kind, topk, rid, vector), done)
            held = []
    if done is None:
        return _search_block(vectors, held, kind, topk, rid, vector)
    return _settled(_search_block(vectors, held, kind, topk, rid, vector), done) if held else done


def _settled(part: DataFrame, done: DataFrame | None) -> DataFrame:
    """``part`` written to the checkpoint folder, behind what is ``done``."""
    spark = part.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    part = part.checkpoint()
    return part if done is None else done.union(part)


def _search_block(vectors: DataFrame, held: list[tuple], id_kind: str, topk: int, rid: str, vector: str) -> DataFrame:
    ids = [i for i, _ in held]
    q = np.array([v for _, v in held], float)
    if len(ids):
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))  # query, score, id
        floor = np.full(len(ids), -np.inf)  # the score that the topk-th of a query has so far
        for f in frames:
            for s in range(0, len(f) if len(ids) else 0, 512):
                part = f.iloc[s : s + 512]
                sim = np.stack(part["vector"].to_numpy()).astype(float) @ q.T
                sim[~np.isfinite(sim)] = -np.inf
                cut = np.partition(sim, len(sim) - topk, axis=0)[len(sim) - topk] if len(sim) > topk else floor
                row, col = np.nonzero((sim >= np.maximum(cut, floor)) & (sim > -np.inf))
                best = [np.concatenate(x) for x in zip(best, (col, sim[row, col], part["rid"].to_numpy().astype(object)[row]))]
                order = np.lexsort((pd.Series(best[2]).rank(method="dense", na_option="top").to_numpy(), -best[1], best[0]))
                best = [x[order] for x in best]
                first = np.searchsorted(best[0], best[0])
                keep = np.arange(len(first)) - first < topk  # of equal scores the smaller ids
                best = [x[keep] for x in best]
                last = np.flatnonzero(np.arange(len(keep))[keep] - first[keep] == topk - 1)
                floor[best[0][last]] = best[1][last]
        yield pd.DataFrame({"query_id": np.array(ids, object)[best[0]], "rid": best[2], "score": best[1]})

    from pyspark.sql import Window as W

    kind = dict(vectors.select(F.col(rid).alias("rid")).dtypes)["rid"]
    part = vectors.select(F.col(rid).alias("rid"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")
    best = part.mapInPandas(block, f"query_id {id_kind}, rid {kind}, score double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rid"))).where(F.col("rank") <= topk)


def fused(df: DataFrame, dense: str, ce: str | None = None, mode: str = "ce", alpha: float = 1.0, norm: str = "minmax") -> DataFrame:
    """``fused``: the scaled dense score (``dense``, or without a cross-encoder), the
    scaled cross-encoder score (``ce``), or alpha * ce + (1 - alpha) * dense.

    ``norm`` is ``minmax`` (a constant column gives one half) or ``zscore``.
    """
    scale = (lambda d, c, out: minmax(d, c, out, constant=0.5)) if norm == "minmax" else zscore
    if mode == "dense" or ce is None:
        return scale(df, dense, "fused")
    if mode == "ce":
        return scale(df, ce, "fused")
    out = scale(scale(df, dense, "_d"), ce, "_c")
    return out.withColumn("fused", alpha * F.col("_c") + (1 - alpha) * F.col("_d")).drop("_d", "_c")


def encoder(encode: Callable[[list[str]], np.ndarray], batch: int = 64):
    """An iterator UDF text -> unit float vector around any encoder; the callable
    is made once a task and fed ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows: list[np.ndarray] = []
            for s in range(0, len(texts), batch):
                v = np.asarray(encode(texts.iloc[s : s + batch].fillna("").tolist()), np.float32)
                rows.extend(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield pd.Series(rows, index=texts.index)

    return udf


def pair_scorer(score: Callable[[list[tuple[str, str]]], np.ndarray], query: str, batch: int = 16):
    """An iterator UDF text -> relevance around a cross-encoder: one logit is
    the score, of two the softmax of the second."""

    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[float] = []
            for s in range(0, len(texts), batch):
                v = np.asarray(score([(query, t or " ") for t in texts.iloc[s : s + batch]]), float)
                if v.ndim == 2 and v.shape[1] > 1:
                    e = np.exp(v - v.max(axis=1, keepdims=True))
                    v = (e / e.sum(axis=1, keepdims=True))[:, 1]
                out.extend(v.reshape(-1).tolist())
            yield pd.Series(out, index=texts.index)

    return udf
