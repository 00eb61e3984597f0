"""Aggregations: scaling, modes, pivots, counters and quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def minmax(df: DataFrame, column: str, out: str, keys: list[str] | None = None, constant: float | None = 0.0) -> DataFrame:
    """Scale to [0, 1]; a constant column gives ``constant``, or itself for None.

    Without keys the bounds come from a one-row aggregate joined back, so rows
    are never brought together in one task.
    """
    if keys:
        w = W.partitionBy(*keys)
        low, high = F.min(column).over(w), F.max(column).over(w)
        df = df.withColumns({"_low": low, "_high": high})
    else:
        df = df.join(F.broadcast(df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))))
    flat = F.col(column) if constant is None else F.lit(constant)
    return df.withColumn(out, F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(flat)).drop("_low", "_high")


def zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - mean) / (population deviation + 1e-12), from a one-row aggregate."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_dev"))
    return df.join(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("_mean")) / (F.col("_dev") + 1e-12)).drop("_mean", "_dev")


def mode_of(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Most frequent non-null value of each key; ties go to the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col("_at")).alias("neg"))).alias(out))


def pivot_least(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each known name with the least non-empty value; rows with a
    null key are left out.  Names are given, so no pass is spent on finding them."""
    clean = df.where(F.col(value) != "").dropna(subset=keys)
    return clean.groupBy(*keys).pivot(name, names).agg(F.min(value))


def first_known(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """The first non-null value of each key."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min_by(column, order).alias(column))


def counters(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def share(condition: Column) -> Column:
    """Percentage of rows that hold the condition, two decimals."""
    return F.round(100.0 * F.count_if(condition) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2)


def quality(df: DataFrame, file: str, required: list[str], keys: list[str], year: str, clean: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """Quality of each file: presence of columns 0.15, mean non-null rate 0.35,
    integral year 0.10, clean numbers among rows that look numeric 0.40, less a
    fifth of the duplicate rate (10 points at most); between 0 and 100.

    A row looks numeric where one of ``raw`` parses (without commas and percent
    signs).  One pass: duplicates are rows beyond the distinct keys, nulls equal.
    """
    have = [c for c in required if c in df.columns]
    presence = round(100.0 * len(have) / max(len(required), 1), 2)
    n = F.count(F.lit(1))
    rate = lambda part, whole: F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)
    filled = sum((rate(F.count(c), n) for c in have), F.lit(0.0)) / max(len(have), 1)
    looks = F.lit(False)
    for c in raw or (clean,):
        looks = looks | F.regexp_replace(F.col(c).cast("string"), "[,%]", "").try_cast("double").isNotNull()
    looks = F.coalesce(looks, F.lit(False))
    fine = F.coalesce(F.abs(F.col(clean).cast("string").try_cast("double")) < float("inf"), F.lit(False))
    distinct = F.count_distinct(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys]))
    got = df.groupBy(file).agg(
        n.alias("n_rows"),
        F.round(filled, 2).alias("nonnull_pct"),
        rate(F.count_if(F.col(year).cast("string").try_cast("double").isNotNull()), n).alias("year_pct"),
        rate(F.count_if(looks & fine), F.greatest(F.count_if(looks), F.lit(1))).alias("number_pct"),
        rate(n - distinct, n).alias("duplicate_pct"),
    )
    base = 0.15 * presence + 0.35 * F.col("nonnull_pct") + 0.10 * F.col("year_pct") + 0.40 * F.col("number_pct")
    score = base - F.least(F.lit(10.0), 0.2 * F.col("duplicate_pct"))
    return got.withColumn("presence_pct", F.lit(presence)).withColumn("score", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 2))


def weighted(df: DataFrame, columns: list[str], weight: str = "n_rows") -> DataFrame:
    """Row-weighted averages over all files."""
    total = F.sum(weight)
    return df.agg(*[F.round(F.sum(F.col(c) * F.col(weight)) / total, 2).alias(c) for c in columns], total.alias(weight))
