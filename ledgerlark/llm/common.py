"""Shared plumbing: the shared working folder, stored tables and components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master (a test) gets a temporary
    folder of this process, set as the checkpoint directory; on a cluster that is
    an error, as each machine would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[key])
    return _FALLBACK[key]


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the context may be gone; files are only scratch
            return


atexit.register(_sweep)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder in the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/ll-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation, and
    values made from partition numbers stay what they were.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_file(path: str) -> str:
    """A path that ``open`` takes for a ``file:`` URI of a shared mount."""
    return path[5:].replace("//", "/") if path.startswith("file:") else path


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``{new name: column}`` with nested names quoted, nothing else."""
    quoted = {k: F.col("`" + v.replace("`", "``") + "`") for k, v in columns.items()}
    return df.select(*[c.alias(k) for k, c in quoted.items()])


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5 = 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def utf8(value: str | None) -> bytes:
    return value.encode("utf-8", "surrogatepass") if value else b""


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def one_thread() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def components(edges: DataFrame, max_rounds: int = 40, small: int = 200_000) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``.

    Alternates the large-star and small-star contractions, which keep the edge
    count linear and finish in O(log^2 n) rounds.  Every round is one table in
    the shared folder, so lost executors never replay more than a round.  A
    node's star is a group-by with a partial minimum followed by an equi-join;
    no neighbour list is ever gathered in one task.  Only nodes with an edge
    come back; ``root`` is the smallest node of the component.

    Graphs of at most ``small`` edges (the documented bound of what reaches
    the driver, 16 bytes an edge) finish with union-find on the driver; the
    answer is the same.
    """
    spark = edges.sparkSession
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = e.count()
    before = None
    for _ in range(max_rounds):
        if n <= small:
            return _driver_components(e)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(e, "edges")
        n, now = e.count(), e.agg(F.sum(F.hash("a", "b").cast("long")).alias("h")).first()["h"]
        if (n, now) == before:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(e.select("b", "b").distinct())
        before = (n, now)
    raise RuntimeError("component contraction did not settle")


def _driver_components(e: DataFrame) -> DataFrame:
    spark = e.sparkSession
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    got = e.toArrow()
    for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted(parent)
    return spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())}))
