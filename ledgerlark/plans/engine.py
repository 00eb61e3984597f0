"""Entry points: one hybrid query, and the staged batch pipeline."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators import bm25, chunker, cleaning, dense, evidence, filters, hybrid
from ..sources import files, html, sinks


@dataclass
class QueryRequest:
    """One hybrid query.  ``encode`` maps texts to vectors and ``score`` pairs to
    relevance; without them the dense list or the re-ranking is left out."""

    query: str
    ticker: str | None = None
    form: str | None = None
    year: int | None = None
    topk: int = 8
    bm25_topk: int = 200
    dense_topk: int = 200
    candidates: int = 256
    k: float = 60.0
    w_bm25: float = 2.0
    w_dense: float = 2.0
    ce_weight: float = 0.5
    strict: bool = True
    context_tokens: int = 2400
    encode: Callable[[list[str]], np.ndarray] | None = None
    score: Callable[[list[tuple[str, str]]], np.ndarray] | None = None
    answer: Callable[[str], dict | str] | None = None


@dataclass
class QueryResult:
    records: DataFrame
    evidence: DataFrame | None = None
    answer: dict | None = field(default=None)


def run_query(chunks: DataFrame, vectors: DataFrame | None, request: QueryRequest) -> QueryResult:
    """Filter, search both ways, fuse, re-rank, cut; then pack and answer.

    ``chunks(rid, content, ticker, form, fy, heading, section_tag,
    mentions_other_years)``; ``vectors(rid, vector)`` with the same ids.  Loose
    mode applies no filter at all.  The plan is lazy up to the answer.
    """
    r = request
    if not r.query.strip():
        raise ValueError("the query is empty")
    pool = filters.meta_filter(chunks, r.ticker, r.form, r.year, keep_odd_year=True) if r.strict else chunks
    sparse = bm25.search(pool, r.query, r.bm25_topk, "rid", "content")
    if vectors is not None and r.encode is not None:
        near_pool = filters.meta_filter(chunks, r.ticker, r.form, r.year) if r.strict else chunks
        near = dense.search(vectors.join(near_pool.select("rid"), "rid", "left_semi"), np.asarray(r.encode([r.query])[0], float).tolist(), r.dense_topk)
    else:
        near = sparse.where("false")
    fused = hybrid.rrf(sparse, near, r.k, r.w_bm25, r.w_dense, r.candidates)
    records = chunks.join(F.broadcast(fused), "rid")
    ce = None
    if r.score is not None and r.ce_weight > 1e-6:
        records, ce = records.withColumn("ce", dense.pair_scorer(r.score, r.query)("content")), "ce"
    records = hybrid.blended(records, r.ce_weight, ce, r.topk)
    if r.answer is None:
        return QueryResult(records)
    if not records.head(1):
        return QueryResult(records, None, {"answer": NOTHING, "citations": []})
    records = settled(records)  # at most ``topk`` rows, used three times
    packed = settled(evidence.packed(records.withColumn("query_id", F.lit(0)), "query_id", r.context_tokens))
    block = evidence.evidence_block(packed).first()
    if not block:
        return QueryResult(records, packed, {"answer": NOTHING, "citations": []})
    rids = {x["rid"] for x in packed.select("rid").collect()}
    return QueryResult(records, packed, checked(r.answer(prompt(r.query, block["block"])), rids))


#: The answer where no evidence was found or fits.
NOTHING = "No evidence for this question was found in the indexed filings."


def salvaged(reply: dict | str) -> dict:
    """A model's reply as a dictionary: JSON, else the JSON between the outer braces
    of a text around it, else an empty answer."""
    if isinstance(reply, dict):
        return dict(reply)
    inner = re.search(r"\{.*\}", reply or "", re.S)
    for text in (reply, inner.group() if inner else None):
        try:
            out = json.loads(text)
        except (TypeError, ValueError):
            continue
        if isinstance(out, dict):
            return out
    return {"answer": "", "citations": []}


def checked(reply: dict | str, rids: set[str]) -> dict:
    """The reply with those citations that quote packed records, quotes cut at 240
    characters; without an answer it says so."""
    out = salvaged(reply)
    quoted = [(c.get("rid"), str(c.get("quote") or "").strip()) for c in out.get("citations") or [] if isinstance(c, dict)]
    out["citations"] = [{"rid": rid, "quote": q[:240]} for rid, q in quoted if rid in rids and q]
    out["answer"] = out.get("answer") or NOTHING
    return out


def settled(rows: DataFrame) -> DataFrame:
    """A small result as a local table, computed once."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def prompt(query: str, block: str) -> str:
    return f"Answer from the evidence only and cite record ids.\n\nQuestion: {query}\n\nEvidence:\n{block}"


def parse_stage(spark: SparkSession, source: str, out: str, overwrite: bool) -> DataFrame:
    """HTML files -> text rows."""
    raw = spark.read.text(source, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.htm*").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    return _stage(spark, html.text_rows(raw), out, "text", overwrite)


def clean_stage(spark: SparkSession, source: str, out: str, overwrite: bool) -> DataFrame:
    """Text rows -> clean sentences."""
    return _stage(spark, cleaning.clean_rows(spark.read.parquet(f"{out}/text.parquet"), "file", "position", "text"), out, "clean", overwrite)


def chunk_stage(spark: SparkSession, source: str, out: str, overwrite: bool) -> DataFrame:
    """Clean sentences -> chunks with the metadata of their paths."""
    clean = spark.read.parquet(f"{out}/clean.parquet").withColumn("place", F.struct("position", "part"))
    chunks = chunker.chunks(clean, "file", "place", "heading", "text")
    meta = tx.path_meta(F.col("file"))
    rid = F.concat(F.coalesce(meta["accno"], F.lit("UNKNOWN")), F.lit("::text::chunk-"), F.col("chunk_index").cast("string"))
    ready = chunks.withColumns(meta).withColumn("rid", rid).withColumn("fy", F.col("year")).withColumn("title", tx.title(F.col("heading"), F.col("ticker"), F.col("form"), F.col("year"))).drop("id")
    return _stage(spark, ready, out, "chunks", overwrite)


def index_stage(spark: SparkSession, source: str, out: str, overwrite: bool) -> DataFrame:
    """JSON lines of a tree -> validated tables by model, and a row a file: model,
    status, rows.  Lines and fields of any shape are read as text first."""
    lines = spark.read.text(source, recursiveFileLookup=True, pathGlobFilter="*.jsonl").where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value")
    routed = lines.withColumn("model", files.model_of(F.col("file")))
    status = None
    for name, model in schemas.MODELS.items():
        fields = {*model.fields, *(a for v in model.aliases.values() for a in v)}
        parsed = routed.where(F.col("model") == name).select("file", F.from_json("value", F.lit(", ".join(f"`{f}` string" for f in sorted(fields - {"file"})))).alias("r")).select("file", "r.*")
        rows = _stage(spark, schemas.validated(parsed, name), out, f"silver_{name}", overwrite)
        one = schemas.file_status(rows).withColumn("model", F.lit(name))
        status = one if status is None else status.union(one)
    return _stage(spark, status, out, "status", overwrite)


def listing_stage(spark: SparkSession, source: str, out: str, overwrite: bool) -> DataFrame:
    """Files of the tree with path metadata."""
    return _stage(spark, files.listing(spark, source), out, "listing", overwrite)


def postprocess_stage(spark: SparkSession, source: str, out: str, overwrite: bool) -> DataFrame:
    """The main document of each folder."""
    return _stage(spark, files.main_documents(files.listing(spark, source)), out, "main", overwrite)


def _stage(spark: SparkSession, df: DataFrame, out: str, stem: str, overwrite: bool) -> DataFrame:
    sinks.write(df, out, stem, overwrite=overwrite)
    return spark.read.parquet(f"{out}/{stem}.parquet")


def build_chunks(spark: SparkSession, pages: str, out: str, overwrite: bool = False) -> DataFrame:
    """HTML files -> text rows -> clean sentences -> chunks, each stage a table
    under ``out`` that the next one reads."""
    parse_stage(spark, pages, out, overwrite)
    clean_stage(spark, pages, out, overwrite)
    return chunk_stage(spark, pages, out, overwrite)


def embed(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], out: str, use_title: bool = True) -> None:
    """Vectors, metadata and build information of chunks."""
    text = F.concat_ws("\n", "title", "content") if use_title else F.col("content")
    vectors = chunks.select("rid", dense.encoder(encode)(text).alias("vector"))
    sinks.write_index(vectors, chunks.withColumn("snippet", tx.snippet(F.col("content"))).drop("content"), out)


#: Stages in their order; ``chunks`` is parse, clean and chunk in one.  Files are
#: landed before: nothing is downloaded.
STAGES = {"listing": listing_stage, "postprocess": postprocess_stage, "parse": parse_stage, "clean": clean_stage, "index": index_stage, "chunk": chunk_stage, "chunks": build_chunks}


def run_stages(spark: SparkSession, stages: list[str], source: str, out: str, overwrite: bool = False, encode: Callable | None = None) -> dict[str, int]:
    """Run named stages in the order given; row counts by stage.  ``embed`` needs
    an ``encode`` and writes its index under ``out/index``."""
    done = {}
    for stage in stages:
        if stage == "embed":
            if encode is None:
                raise ValueError("the stage 'embed' needs an encoder")
            embed(spark.read.parquet(f"{out}/chunks.parquet"), encode, f"{out}/index")
            done[stage] = sinks.read_index(spark, f"{out}/index")[0].count()
        elif stage in STAGES:
            done[stage] = STAGES[stage](spark, source, out, overwrite).count()
        else:
            raise ValueError(f"unknown stage {stage!r}; known: {', '.join([*STAGES, 'embed'])}")
    return done
