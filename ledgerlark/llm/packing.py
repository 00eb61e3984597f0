"""Best-fit packing planned over the histogram of piece lengths.

The driver sees one count per length (at most ``size`` of them) and packs counts,
longest first, each into the fullest open sequences that it fits.  Equal
sequences are one run, so the plan has runs, not documents.  Every piece then
finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Codec, _rows
from .common import stored


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(slots, sequences): slots are ``length, rank, sequence, offset``: pieces of
    a length from that rank on (up to the next slot's) go to consecutive
    sequences from ``sequence`` on, at ``offset``.

    Best-fit decreasing: a piece goes to the open sequence with least room that
    holds it, and a new one opens only if none does.
    """
    rooms: list[int] = []  # sorted rooms that have runs
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
    slots, opened = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, many))

    for length in sorted((c for c, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # Open full stacks of this length at once, then a partial one.
                high = size // length
                many = left // high
                if many:
                    for level in range(high):
                        slots.append((length, rank, opened, level * length))
                        rank += many
                    put(size - high * length, opened, many)
                    opened, left = opened + many, left - many * high
                if left:
                    for level in range(left):
                        slots.append((length, rank, opened, level * length))
                        rank += 1
                    put(size - left * length, opened, 1)
                    opened, left = opened + 1, 0
                break
            room = rooms[at]
            first, many = runs[room].pop()
            high = min(room // length, left)
            take = min(many, left // high)
            for level in range(high):
                slots.append((length, rank, first, size - room + level * length))
                rank += take
            left -= take * high
            if take < many:
                runs[room].append((first + take, many - take))
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            put(room - high * length, first, take)
    return slots, opened


def cut_mapper(tokenizer: str, size: int, end_id: int):
    """Pieces of each text with their number among the task's pieces of that length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("k", pa.int64())])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        codec, task, seen = Codec.of(tokenizer, cache=500_000), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(batch.column(0).to_pylist(), codec.encode_texts(batch.column(1).to_pylist())):
                raw += tail
                for p, a in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[a : a + 4 * size]
                    n = len(part) // 4
                    for c, v in zip(rows, (doc, p, a // 4, n, zlib.crc32(part), seen[n])):
                        c.append(v)
                    seen[n] += 1
            cols = [*rows[:5], [task] * len(rows[0]), rows[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def slot_mapper(starts, ranks, sequences, offsets):
    """Sequence and offset of rows (length, rank) by binary search in the plan."""

    def run(batches):
        s, r, q, o = starts.value, ranks.value, sequences.value, offsets.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (5, 6))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                here = length == n
                at[here] = s[n] + np.searchsorted(r[s[n] : s[n + 1]], rank[here], side="right") - 1
            seq = q[at] + rank - r[at]
            cols = [*[batch.column(i) for i in range(5)], pa.array(seq), pa.array(o[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "ids_crc32", "length", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    A document is its ids and ``end_id``; only those longer than ``size`` are
    cut.  Null and empty texts are the end id alone.  Null and repeated ids
    are packed like others; an empty table gives no pieces.  Only the two named
    columns are read.  The plan holds runs of at most ``size`` lengths and is
    what is broadcast; ranks come from counts by (task, length), so pieces of
    one frequent length are never gathered.
    """
    spark = docs.sparkSession
    cut = _rows(docs, id_col, text_col).mapInArrow(cut_mapper(tokenizer, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, k long")
    pieces = stored(cut, "pieces")
    per_task = pieces.groupBy("length", "task").count()
    before = per_task.select("length", "task", (F.sum("count").over(W.partitionBy("length").orderBy("task")) - F.col("count")).alias("before"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, _ = plan(counts, size)
    by_length = np.array(sorted(slots), np.int64).reshape(-1, 4)
    starts = np.searchsorted(by_length[:, 0], np.arange(size + 2))
    shared = [spark.sparkContext.broadcast(x) for x in (starts, *[np.ascontiguousarray(by_length[:, i]) for i in (1, 2, 3)])]
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "ids_crc32", F.col("length").alias("len"), "length", (F.col("before") + F.col("k")).alias("rank"))
    placed = ranked.mapInArrow(slot_mapper(*shared), "doc_id long, piece int, start long, ids_crc32 long, length long, sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
