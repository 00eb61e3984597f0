"""Numpy helpers for links found inside buckets, and tiles for hot buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the links a-b.

    As many rows as there are linked nodes, however many links there are.
    """
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    x, y, lab = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        before = lab.copy()
        low = np.minimum(lab[x], lab[y])
        np.minimum.at(lab, x, low)
        np.minimum.at(lab, y, low)
        lab = lab[lab]
        if np.array_equal(before, lab):
            return nodes, nodes[lab]


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the integer sum of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(values[order], first)


def tile_pairs(chunks: DataFrame) -> DataFrame:
    """Pairs of different chunks of one bucket: ``key, left, right`` payloads.

    ``chunks(key, chunk, payload)`` holds buckets cut into pieces of bounded
    size.  Each piece meets each other piece once, in a row of its own that is
    hashed by (key, pair), so a hot bucket spreads over all tasks.
    """
    n = chunks.groupBy("key").agg((F.max("chunk") + 1).alias("n"))
    c = chunks.join(n, "key").where("n > 1")
    left = c.where("chunk < n - 1").select("key", F.col("chunk").alias("i"), F.col("payload").alias("left"), F.explode(F.sequence(F.col("chunk") + 1, F.col("n") - 1)).alias("j"))
    right = c.where("chunk > 0").select("key", F.col("chunk").alias("j"), F.col("payload").alias("right"), F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("i"))
    return left.join(right, ["key", "i", "j"]).select("key", "left", "right")
