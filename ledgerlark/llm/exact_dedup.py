"""Exact deduplication over an extendible-hash index in shared files.

Map tasks normalise each text, hash it and write one entry a row to shared files;
an equal text met lately in the same task is recorded as a reference, so a text
that a third of all rows share travels about once a task.  The driver inserts
the entries' load by hash prefix: a bucket over capacity splits on its next bit
and the directory doubles where that bit is beyond its depth.  Owner tasks each
take a range of keys, whole buckets of about equal load, chain the entries of
one hash and compare their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored, utf8

_ENTRY = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("hkey", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("size", pa.int64())])
_OWNED = pa.schema([("rep", pa.int64()), ("cls", pa.int64()), ("chain", pa.int32())])


def normalise(text: str | None) -> bytes:
    """Bytes that decide equality: UTF-8 with only A-Z lower-cased, null as empty."""
    return utf8(text).lower()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def entry_mapper(hash_of=xxhash.xxh64_intdigest, local_bytes: int = 24 << 20):
    """Entries of one map task; ``local_bytes`` bounds its table of texts, from
    which the one not met for longest goes first."""

    def entries(batches):
        base, n, seen, held = TaskContext.get().partitionId() << 40, 0, {}, 0
        press, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, len(b), 1024)):  # few texts are held twice
            rid, rep, key, sha, body = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = normalise(text)
                digest, me = hashlib.sha256(raw), base + n
                n += 1
                k = digest.digest()
                found = seen.pop(k, None)
                if found and unpack(found[1]) == raw:
                    seen[k], owner, packed = found, found[0], None
                else:
                    owner, packed = me, press(raw)
                    seen[k] = (me, packed)
                    held += len(packed) + 200 - (len(found[1]) + 200 if found else 0)
                    while held > local_bytes and len(seen) > 1:
                        held -= len(seen.pop(next(iter(seen)))[1]) + 200
                rid.append(me)
                rep.append(owner)
                key.append(_signed(hash_of(raw)))
                sha.append(digest.hexdigest())
                body.append(packed)
            cols = [pa.array(rid, pa.int64()), batch.column(0), pa.array(rep, pa.int64()), pa.array(key, pa.int64()), pa.array(sha, pa.string()), pa.array(body, pa.binary()), pa.array([0 if b is None else len(b) + 64 for b in body], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=_ENTRY)

    return entries


class Directory:
    """Extendible-hash directory over hash prefixes of ``max_depth`` bits.

    ``load[c]`` is the load of prefix cell ``c``; cells are inserted one after
    the other.  Buckets start as one; an overfull one splits on its next bit, and
    the directory doubles when that bit is beyond its depth.  A bucket that is
    still overfull at ``max_depth`` stays whole and grows a chain.
    """

    def __init__(self, load, capacity: int, max_depth: int):
        self.max_depth, self.depth, self.capacity = max_depth, 0, capacity
        self.slots = np.zeros(1, np.int64)
        self.first, self.local, self.load = [0], [0], [0]
        self.cells = np.zeros(1 << max_depth, np.int64)
        for cell in np.flatnonzero(load).tolist():
            self.insert(cell, int(load[cell]))
        order = np.argsort(self.first)
        self.buckets = [(self.first[b], self.local[b]) for b in order.tolist()]
        self.loads = [self.load[b] for b in order.tolist()]
        self.slots = np.argsort(order)[self.slots]

    def insert(self, cell: int, load: int) -> None:
        self.cells[cell] += load
        self.load[self.slots[cell >> (self.max_depth - self.depth)]] += load
        while True:
            b = int(self.slots[cell >> (self.max_depth - self.depth)])
            if self.load[b] <= self.capacity or self.local[b] == self.max_depth:
                return
            self.split(b)

    def split(self, b: int) -> None:
        if self.local[b] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        self.local[b] += 1
        half = 1 << (self.max_depth - self.local[b])
        middle, new = self.first[b] + half, len(self.first)
        moved = int(self.cells[middle : middle + half].sum())
        self.first.append(middle)
        self.local.append(self.local[b])
        self.load.append(moved)
        self.load[b] -= moved
        at, wide = middle >> (self.max_depth - self.depth), 1 << (self.depth - self.local[b])
        self.slots[at : at + wide] = new

    def bucket(self, cell: int) -> int:
        return int(self.slots[cell >> (self.max_depth - self.depth)])

    def owners(self, tasks: int) -> np.ndarray:
        """Task of each bucket: ranges of neighbours with about the same load."""
        load = np.array(self.loads, np.int64)
        middle = np.cumsum(load) - (load + 1) // 2
        return np.minimum(tasks - 1, middle * tasks // max(int(load.sum()), 1))


def chain_owner(batches):
    """Chains of one owner task; rows come sorted by hash key.

    Equal compressed bytes are equal texts; others are unpacked and compared, so
    how a worker compresses does not matter."""
    key, chain = None, []
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in (b.slice(s, 1024) for b in batches for s in range(0, len(b), 1024)):
        rep, cls, link = [], [], []
        for k, r, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                key, chain = k, []
            for at, (other, owner) in enumerate(chain):
                if other == body or unpack(other) == unpack(body):
                    break
            else:
                at, owner = len(chain), r
                chain.append((body, r))
            rep.append(r)
            cls.append(owner)
            link.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(cls, pa.int64()), pa.array(link, pa.int32())], schema=_OWNED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4 << 20, max_depth: int = 22, hash_of=xxhash.xxh64_intdigest, local_bytes: int = 24 << 20, salts: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``
    and the index columns ``bucket, chain``.

    Texts are equal when identical after lower-casing A-Z; null is empty.  Of
    equal texts the row with the largest id stays; a null id is below every
    other, and of rows that repeat an id exactly one stays.  Input columns
    other than the two named are not read.  Empty tables give empty results.
    ``capacity`` is the bytes of compressed text in a bucket before it splits;
    prefixes grow with the corpus up to ``max_depth`` bits.  Texts whose hash
    collides but whose bytes differ share a chain, not a group.  A bucket that no
    split brings below capacity is chained in ``salts`` parts first, so one text
    that many tasks hold does not go to its owner from each.  What the driver
    counts and broadcasts is at most ``2**max_depth`` integers, and about eight
    for each bucket in use.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    entries = stored(rows.mapInArrow(entry_mapper(hash_of, local_bytes), "rid long, doc_id long, rep long, hkey long, sha string, body binary, size long"), "exact-entries", "none")
    heads = entries.where("size > 0")
    total = heads.agg(F.sum("size").alias("n")).first()["n"] or 0
    depth = min(max_depth, max(1, (total // capacity).bit_length()) + 3)
    got = heads.groupBy(F.shiftrightunsigned("hkey", 64 - depth).cast("int").alias("c")).agg(F.sum("size").alias("n")).toArrow()
    load = np.zeros(1 << depth, np.int64)
    load[got["c"].to_numpy()] = got["n"].to_numpy()
    directory = Directory(load, capacity, depth)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    owner = directory.owners(parts)
    full = np.array([n > capacity for n in directory.loads])
    numbers = directory.slots.astype(np.int32)
    slots = F.broadcast(spark.createDataFrame(pa.table({"slot": pa.array(range(len(numbers)), pa.int32()), "bucket": pa.array(numbers), "owner": pa.array(owner[numbers].astype(np.int32)), "full": pa.array(full[numbers])})))
    slot = F.shiftrightunsigned("hkey", 64 - directory.depth).cast("int") if directory.depth else F.lit(0)
    owned = heads.select("hkey", "rep", "body", slot.alias("slot")).join(slots, "slot")
    first = None
    if full.any():
        hot = owned.where("full").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)))
        first = stored(hot.repartition("hkey", "salt").sortWithinPartitions("hkey", "salt", "rep").select(F.xxhash64("hkey", "salt").alias("hkey"), "rep", "body").mapInArrow(chain_owner, "rep long, cls long, chain int"), "exact-salted")
        owned = owned.where("not full").union(owned.where("full").join(first.where("rep = cls").select("rep"), "rep", "left_semi").select(*owned.columns))
    chained = owned.repartitionById(parts, F.col("owner")).sortWithinPartitions("hkey", "rep").select("hkey", "rep", "body")
    chains = stored(chained.mapInArrow(chain_owner, "rep long, cls long, chain int"), "exact-index")
    if first is not None:  # what was chained in a part takes the class of its part's first
        inner = first.where("rep <> cls").select("rep", F.col("cls").alias("via"))
        chains = chains.union(inner.join(chains.withColumnRenamed("rep", "via"), "via").select("rep", "cls", "chain"))

    small = entries.select("rid", "doc_id", "rep", "hkey", "sha")
    best = F.max(F.struct("doc_id", (-F.col("rid")).alias("neg")))
    by_rep = small.groupBy("rep").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).join(chains, "rep")
    by_class = by_rep.groupBy("cls").agg(F.max("best").alias("top"), F.sum("n").alias("group_size"))
    decided = chains.join(by_class, "cls").select("rep", "chain", "top", "group_size")
    return (
        small.join(decided, "rep")
        .withColumn("slot", slot)
        .join(slots.select("slot", "bucket"), "slot")
        .select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("top.neg")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")
    )


#: DuckDB: the same groups by the normalised text itself.
ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
