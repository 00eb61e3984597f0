"""Window-shaped operators: fills, islands, ranks, first-of, token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list, mark: str = "_rank") -> DataFrame:
    """The first row of each key in an explicit order (nulls are a key value).

    ``row_number`` = 1 becomes a group limit below the shuffle, so a hot key
    sends one row a task.
    """
    return df.withColumn(mark, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(mark) == 1).drop(mark)


def top_of(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """At most ``k`` rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def fill_forward(df: DataFrame, keys: list[str], order: list, columns: dict[str, Column]) -> DataFrame:
    """Each named column is the last non-null value up to and with this row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in columns.items()})


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` of the rows before this one in its key.

    A key may hold any share of the rows: rows are ranged over tasks by key and
    order, filled within each range, and the first rows of a range take what the
    ranges before hold, from one row a key and range.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    seen = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v")))
    ends = ranged.groupBy("_range", *keys).agg(F.max(seen)["v"].alias("_end"))
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    inside = ranged.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))
    held = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    met = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(held, met, "left").withColumn(name, F.coalesce(name, "_before")).select(*df.columns, name)


def sections(df: DataFrame, keys: list[str], order: list, heading: str, name: str = "section") -> DataFrame:
    """Section numbers from 0: a row opens one where the row before has a
    heading and this row's differs; rows without heading join what follows."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(heading).over(w)
    opens = (before.isNotNull() & ~F.col(heading).eqNullSafe(before)).cast("int")
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")


def numbered(df: DataFrame, keys: list[str], order: list, index: str = "chunk_index", count: str = "chunk_count") -> DataFrame:
    """Zero-based number and total of each key's rows."""
    return df.withColumn(index, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).withColumn(count, F.count(F.lit(1)).over(W.partitionBy(*keys)))


def islands(df: DataFrame, keys: list[str], number: str, name: str = "island") -> DataFrame:
    """Runs of consecutive numbers share an island value."""
    return df.withColumn(name, F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number)))


def stitched(df: DataFrame, keys: list[str], number: str, text: str, glue: str = "\n\n") -> DataFrame:
    """Adjacent numbered rows of one key become one row, texts in order."""
    runs = islands(df, keys, number)
    parts = runs.groupBy(*keys, "island").agg(F.min(number).alias("first_no"), F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_list(F.struct(F.col(number).alias("no"), F.col(text).alias("t")))).alias("parts"))
    return parts.withColumn(text, F.array_join(F.transform("parts", lambda p: p["t"]), glue)).drop("parts", "island")


def token_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of ``size`` words with ``overlap`` words shared; columns
    ``window_no`` and ``window``.  The last window ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))
    n = F.greatest(F.lit(1), F.ceil((F.size("_words") - overlap) / (size - overlap)).cast("int"))
    spread = df.withColumn("_words", words).where(F.size("_words") > 0).withColumn("window_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return spread.withColumn("window", F.array_join(F.slice("_words", F.col("window_no") * (size - overlap) + 1, F.lit(size)), " ")).drop("_words")


def covered(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of intervals of each key: a running maximum of ends opens a new
    cover where a start is beyond it.  Null starts and ends come last and open
    nothing, unless no end stands before them."""
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
