"""File sources: JSON lines under three tolerances, tables, routing, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_meta
from ..operators.windows import first_of


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, glob: str | None = None) -> DataFrame:
    """JSON lines with a given schema: ``strict`` fails on a bad line, else such
    lines are dropped.  Blank lines never count.  Trees are read recursively."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def json_rows_audited(spark: SparkSession, path: str, schema: T.StructType, bad: str = "_parse_error") -> DataFrame:
    """JSON lines with the text of each bad line kept in ``bad``."""
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("recursiveFileLookup", "true").json(path)


def table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV by suffix."""
    low = path.rstrip("/").lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".jsonl", ".json")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if low.endswith(".csv"):
        return (spark.read.schema(schema) if schema else spark.read).option("header", "true").csv(path)
    raise ValueError(f"no reader for {path}")


ROUTES = (("labels_wide", "labels_wide"), ("labels", "label_best"), ("calculation", "calculation_edge"), ("definition", "definition_arc"), ("fact", "fact"), ("text_corpus", "text_clean"), ("text", "text_row"))


def model_of(path: Column) -> Column:
    """Model name of a file by its name; the first part that it holds decides."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    out = None
    for part, model in ROUTES:
        out = F.when(name.contains(part), model) if out is None else out.when(name.contains(part), model)
    return out


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, size, modified`` and path metadata of the files of a tree, without contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumns(path_meta(F.col("path"))).withColumn("model", model_of(F.col("path")))


def main_documents(files: DataFrame, folder: str = "folder") -> DataFrame:
    """One HTML file a folder: not the details page if there is another, then the largest."""
    html = files.where(F.lower("path").rlike(r"\.html?$")).withColumn(folder, F.regexp_replace("path", r"/[^/]*$", ""))
    return first_of(html, [folder], [F.lower("path").contains("filing-details").cast("int"), F.desc("size"), "path"])


def filing_date(metadata_json: Column, html: Column, accno: Column) -> Column:
    """Filing year from metadata, then the page, then the accession number, else "0000"."""
    stated = F.regexp_extract(F.coalesce(F.get_json_object(metadata_json, "$.filing_date"), F.lit("")), r"^([0-9]{4})", 1)
    shown = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)filing date[^0-9]{0,80}([0-9]{4})-[0-9]{2}-[0-9]{2}", 1)
    short = F.regexp_extract(F.coalesce(accno, F.lit("")), r"-([0-9]{2})-", 1)
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(stated), blank(shown), F.concat(F.lit("20"), blank(short)), F.lit("0000"))


def companies(spark: SparkSession, path: str) -> DataFrame:
    """Requested filings: listed US companies by form type and year."""
    rows = spark.read.option("header", "true").csv(path).where("upper(source) = 'EDGAR' and upper(market) = 'US'")
    pick = lambda c: F.explode(F.filter(F.transform(F.split(c, r"\|"), F.trim), lambda x: x != ""))
    return rows.withColumn("form", pick("form_types")).withColumn("year", pick("years")).withColumn("year", F.col("year").try_cast("int")).drop("form_types", "years")


def issuer_cik(accno: Column, header: Column, known: dict[str, str], ticker: Column, agents: list[str]) -> Column:
    """Issuer's CIK: stated in the header, else known by ticker, else the
    accession number's prefix unless it is a filing agent's."""
    stated = F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)central index key[^0-9]*([0-9]{1,10})", 1), F.lit(""))
    table_ = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    prefix = F.nullif(F.regexp_extract(accno, r"^([0-9]{10})", 1), F.lit(""))
    return F.coalesce(F.lpad(stated, 10, "0"), F.lpad(F.try_element_at(table_, F.upper(ticker)), 10, "0"), F.when(~prefix.isin(agents), prefix) if agents else prefix)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text filings: distinct lines of each file in order of first place."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = rows.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("position", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")
    return first_of(lines, ["file", "text"], ["position"])
