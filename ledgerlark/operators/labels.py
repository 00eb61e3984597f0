"""Label tables: best label, documentation, wide form, edges."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import lang_tag, role_name, search_tokens
from .aggregates import pivot_least

#: Role orders of the two stages; they differ on purpose.
PARSE_ROLES = tuple("terse standard total verbose documentation".split())
CLEAN_ROLES = tuple("standard terse total documentation verbose".split())
PARSE_LANGS = ("en", "en-US")
CLEAN_LANGS = tuple("en-US en en-GB zh nl".split())
KEYS = "ticker fy form accno concept".split()


def rank_in(column: Column, order: tuple[str, ...], unknown: int = 999, blank: int = 500) -> Column:
    """Place in an order; values outside rank last, null between."""
    out = F.when(column.isNull(), blank)
    for i, v in enumerate(order):
        out = out.when(column == v, i)
    return out.otherwise(unknown)


def tidy(labels: DataFrame) -> DataFrame:
    return labels.withColumn("role", role_name(F.col("role"))).withColumn("lang", lang_tag(F.col("lang"))).where(F.col("label_text") != "")


def best_labels(labels: DataFrame, keys: list[str] = KEYS, roles: tuple[str, ...] = CLEAN_ROLES, langs: tuple[str, ...] = CLEAN_LANGS) -> DataFrame:
    """Best label and longest documentation of each concept, in one group-by.

    ``min_by`` and ``max_by`` combine map-side, so a concept with many labels
    is never gathered, and no self-join is needed.
    """
    order = F.struct(rank_in(F.col("role"), roles).alias("r"), rank_in(F.col("lang"), langs).alias("l"), "label_text")
    doc = F.col("role") == "documentation"
    out = labels.groupBy(*keys).agg(
        F.min_by("label_text", order).alias("label_best"),
        F.min_by("role", order).alias("role_best"),
        F.max_by(F.when(doc, F.col("label_text")), F.when(doc, F.struct(F.length("label_text"), "label_text"))).alias("label_doc"),
    )
    return out.withColumn("search_tokens", search_tokens(F.col("label_best"), F.col("concept")) if "concept" in keys else search_tokens(F.col("label_best")))


def wide_labels(labels: DataFrame, roles: tuple[str, ...], langs: tuple[str, ...], keys: list[str] = KEYS) -> DataFrame:
    """``label_{role}_{lang}`` columns joined with the best labels on the keys.

    Join keys compare with ``=``: rows with a null key have no wide form.
    """
    names = [f"label_{r}_{l}" for r in roles for l in langs]  # noqa: E741
    named = labels.withColumn("_name", F.concat_ws("_", F.lit("label"), "role", "lang"))
    return pivot_least(named, keys, "_name", "label_text", names).join(best_labels(labels, keys, roles, langs), keys, "left")


def from_wide(wide: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Long rows of a wide table: role and language from the column names."""
    columns = [c for c in wide.columns if c.startswith("label_") and c.count("_") >= 2]
    long = wide.unpivot(keys, columns, "_name", "label_text").where(F.col("label_text").isNotNull())
    part = lambda i: F.regexp_extract("_name", r"^label_([^_]+)_(.+)$", i)
    return long.select(*keys, part(1).alias("role"), part(2).alias("lang"), "label_text")


def preferred_labels(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Best labels of any of three shapes: already best, wide, or long."""
    if "label_best" in df.columns:
        return df.dropDuplicates()
    if "label_text" in df.columns:
        return best_labels(tidy(df), keys)
    return best_labels(from_wide(df, keys), keys)


CALCULATION = {"parent": "string", "child": "string", "order": "double", "weight": "double"}
DEFINITION = {"from_concept": "string", "to_concept": "string", "arcrole": "string", "order": "double"}


def clean_edges(edges: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns added, numbers coerced (null where they do not parse), distinct."""
    fixed = [(F.col(f"`{c}`").cast("string").try_cast(t) if c in edges.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()]
    return edges.select(*[c for c in edges.columns if c not in columns], *fixed).distinct()


def edges_of(arcs: DataFrame, arcroles: list[str]) -> DataFrame:
    """Edges of the given arc roles (definition edges are a union of five)."""
    return arcs.where(F.col("arcrole").isin(arcroles)).distinct()


def joined_arcs(arcs: DataFrame, locators: DataFrame) -> DataFrame:
    """Arcs with both ends resolved through their document's locators."""
    loc = lambda side: locators.select("doc", F.col("label").alias(side), F.col("concept").alias(f"{side}_concept"))
    return arcs.join(loc("from"), ["doc", "from"]).join(loc("to"), ["doc", "to"])


def one_hop(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Children, parents and siblings of concepts: ``concept, related, kind``."""
    down = concepts.join(edges.select(F.col("parent").alias("concept"), F.col("child").alias("related")), "concept").withColumn("kind", F.lit("child"))
    up = concepts.join(edges.select(F.col("child").alias("concept"), F.col("parent").alias("related")), "concept").withColumn("kind", F.lit("parent"))
    side = up.select("concept", F.col("related").alias("parent")).join(edges.select("parent", F.col("child").alias("related")), "parent").where("related <> concept").select("concept", "related").withColumn("kind", F.lit("sibling"))
    return down.unionByName(up).unionByName(side).distinct()


def annotated(texts: DataFrame, forms: DataFrame, text: str = "text", block: int = 200_000) -> DataFrame:
    """Texts with the surface forms they hold, in lower case: ``rid, concept``.

    One automaton finds all forms in a pass over each text.  ``block`` forms at a
    time are sent to the tasks; a larger dictionary takes more passes, one a block.
    """
    f = forms.select("concept", F.lower("form").alias("form")).where("form <> ''").distinct()
    spark = texts.sparkSession
    low = texts.select("rid", F.lower(F.col(text)).alias("low")).where("low is not null")
    kinds = low.schema["rid"].dataType, f.schema["concept"].dataType
    schema = T.StructType([T.StructField("rid", kinds[0]), T.StructField("concept", kinds[1])])
    parts: list[DataFrame] = []
    held: list[tuple] = []

    def take() -> None:
        parts.append(low.mapInArrow(_finder(spark.sparkContext.broadcast(held[:]), to_arrow_type(kinds[1])), schema))
        held.clear()

    for r in f.toLocalIterator():
        held.append((r["form"], r["concept"]))
        if len(held) == block:
            take()
    if held or not parts:
        take()
    return reduce(DataFrame.union, parts).distinct()


def _finder(shared, kind: pa.DataType):
    def run(batches):
        import ahocorasick

        of: dict = {}
        for form, concept in shared.value:
            of.setdefault(form, []).append(concept)
        auto = ahocorasick.Automaton()
        for form, concepts in of.items():
            auto.add_word(form, concepts)
        auto.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, low in enumerate(batch.column(1).to_pylist()) if of else ():
                mine = {c for _, concepts in auto.iter(low) for c in concepts}
                rows += [i] * len(mine)
                found += mine
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, kind)], names=["rid", "concept"])

    return run
