"""Small dictionaries from YAML or JSON files: concepts, forms, patterns, targets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(path: str) -> dict:
    """A YAML or JSON mapping; YAML needs its library."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs pyyaml; use JSON instead") from e
    return yaml.safe_load(text) or {}


def forms(spark: SparkSession, concepts: dict[str, dict]) -> DataFrame:
    """``concept, form`` of ``{concept: {main, forms: [...]}}``."""
    rows = [(c, f) for c, v in concepts.items() for f in dict.fromkeys([v.get("main"), *(v.get("forms") or [])]) if f]
    return spark.createDataFrame(rows, "concept string, form string")


def relations(spark: SparkSession, definitions: dict[str, dict]) -> DataFrame:
    """``concept, related, kind`` of children, siblings and related concepts."""
    rows = [(c, r, kind) for c, v in definitions.items() for kind in ("children", "siblings", "related") for r in v.get(kind) or []]
    return spark.createDataFrame(rows, "concept string, related string, kind string")


def expanded(spark: SparkSession, queries: DataFrame, concept_forms: DataFrame, related: DataFrame) -> DataFrame:
    """``query_id, concepts, tokens``: concepts whose form a query holds, those one
    step on, and all their forms with the years the query names."""
    from ..operators.labels import annotated

    hit = annotated(queries.select(F.col("query_id").alias("rid"), "query"), concept_forms, "query").withColumnRenamed("rid", "query_id")
    wide = hit.union(hit.join(related.select("concept", "related"), "concept").select("query_id", "related")).distinct()
    words = wide.join(concept_forms, "concept").select("query_id", F.col("form").alias("token"))
    years = queries.select("query_id", F.explode(F.regexp_extract_all("query", F.lit("20[0-9]{2}"), F.lit(0))).alias("token"))
    tokens = words.union(years).groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    concepts = wide.groupBy("query_id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    return queries.select("query_id").join(concepts, "query_id", "left").join(tokens, "query_id", "left")


def pattern_score(text: Column, include: list[str], exclude: list[str], phrases: list[str] = ()) -> Column:
    """How many include patterns and phrases a text meets; null where an exclude
    pattern does.  Patterns are case-insensitive regular expressions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum([low.rlike(p).cast("int") for p in include] + [low.contains(p.lower()).cast("int") for p in phrases], F.lit(0))
    barred = F.lit(False)
    for p in exclude:
        barred = barred | low.rlike(p)
    return F.when(~barred, score)


def targets(config: dict | list) -> list[dict]:
    """Extraction targets, whether listed or grouped by category."""
    if isinstance(config, dict):
        return [t | {"category": c} for c, ts in config.items() for t in (ts or [])]
    return list(config)


def standard_name(ticker: Column, year: Column, form: Column, accno: Column, suffix: Column) -> Column:
    """``US_`` ticker, year, form and accession number, joined by underscores, and the suffix."""
    return F.concat(F.lit("US_"), F.concat_ws("_", ticker, year.cast("string"), form, accno), F.lit("."), suffix)
