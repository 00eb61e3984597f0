"""Sinks: several formats of one frame, keyed tables, incremental append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import exists


def flattened(df: DataFrame) -> DataFrame:
    """Decimals, maps, arrays and structs as text, for formats without them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def write(df: DataFrame, folder: str, stem: str, formats: tuple[str, ...] = ("parquet",), partition_by: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Write ``folder/stem.format`` in each format; existing output stays unless
    ``overwrite``.  With more than one format the frame is computed once."""
    if len(formats) > 1:
        df = df.persist()
    try:
        for fmt in formats:
            out = flattened(df) if fmt == "csv" else nan_to_null(df) if fmt == "json" else df
            done = exists(df.sparkSession, f"{folder}/{stem}.{fmt}/_SUCCESS")  # what a failed run left is written again
            w = out.write.mode("ignore" if done and not overwrite else "overwrite")
            if fmt == "csv":
                w = w.option("header", "true")
            (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(f"{folder}/{stem}.{fmt}")
    finally:
        if len(formats) > 1:
            df.unpersist()


STORE = ("filings", "facts", "contexts", "units", "labels", "calculation_edges", "presentation_edges", "definition_edges")


def save_filing(spark: SparkSession, folder: str, tables: dict[str, DataFrame], filing_id: str) -> None:
    """Append one filing's tables to the store, new columns allowed, old ones kept.

    Rows of a filing live in their own partition, which is overwritten, so a
    repeated load replaces rows instead of fanning out later joins.
    """
    unknown = set(tables) - set(STORE)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    for name, df in tables.items():
        w = df.withColumn("filing_id", F.lit(filing_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        w.partitionBy("filing_id").parquet(f"{folder}/{name}")


def load_store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")


def write_index(vectors: DataFrame, meta: DataFrame, folder: str) -> None:
    """Vectors, metadata and build information of a dense index."""
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")
    built = vectors.sparkSession.read.parquet(f"{folder}/vectors").agg(F.count(F.lit(1)).alias("records"), F.max(F.size("vector")).alias("dims"))
    built.withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/build_info")


def read_index(spark: SparkSession, folder: str, rid: str = "rid") -> tuple[DataFrame, DataFrame]:
    """(vectors, metadata) of a stored dense index; refused where their sizes or the
    stated number of records differ, as after a build that did not end."""
    vectors, meta = (spark.read.parquet(f"{folder}/{part}") for part in ("vectors", "meta"))
    stated = spark.read.parquet(f"{folder}/build_info").first()["records"]
    sizes = vectors.count(), meta.count(), meta.select(rid).distinct().count()
    if {*sizes, stated} != {stated}:
        raise ValueError(f"the index has {sizes[0]} vectors, {sizes[1]} metadata rows of {sizes[2]} ids and {stated} stated records")
    return vectors, meta


def markdown(df: DataFrame, max_rows: int = 120) -> str:
    """A small table as Markdown; at most ``max_rows`` rows reach the driver."""
    rows = df.limit(max_rows).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", r"\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *[line(r) for r in rows]])
