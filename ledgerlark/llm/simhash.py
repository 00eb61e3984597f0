"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a common neighbour within half of it.
Every distinct fingerprint emits all variants within half the radius; equal
variants meet in the shuffle and the colliding pairs are verified.

With radius 4 a plain ball has 1+64+2016 variants.  ``blocks=3`` first applies
the pigeonhole principle: of three blocks of bits the one with most differences
holds at least two of four, so on the two others at most two differ and half of
that is one.  Each fingerprint then emits 3 x (1+about 43) variants of about 43
bits, 132 instead of 2081, and no pair is lost.  ``blocks=1`` is the plain ball.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import stars, sums, tile_pairs
from .common import components, pick, stored, utf8

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of word shingles: A-Z lowered, words split at ASCII space."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(line, seed)
    else:
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprint_mapper(shingle: int, seed: int):
    schema = pa.schema([("rid", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], schema=schema)

    return run


class Ball:
    """Variants of fingerprints and the one bucket in which a pair counts."""

    def __init__(self, radius: int = 4, blocks: int = 3):
        if not 0 <= radius < BITS or not 1 <= blocks <= 8:
            raise ValueError("radius must be in 0..63 and blocks in 1..8")
        self.radius = radius
        # Without the fullest block, at most radius - ceil(radius / blocks) bits differ on the rest.
        self.inner = radius if blocks == 1 else radius - -(-radius // blocks)
        self.half = -(-self.inner // 2)
        cut = [BITS * i // blocks for i in range(blocks + 1)]
        whole = (1 << BITS) - 1
        drops = [0] if blocks == 1 else [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
        self.masks = np.array([whole ^ d for d in drops], np.uint64)
        self.flips = []
        for d in drops:
            free = [i for i in range(BITS) if not d >> i & 1]
            self.flips.append(np.array([sum(1 << i for i in c) for r in range(self.half + 1) for c in combinations(free, r)], np.uint64))

    def variants(self, fps: np.ndarray) -> np.ndarray:
        """(len(fps), number of variants) of bucket keys."""
        return np.concatenate([(fps & m)[:, None] ^ f[None, :] for m, f in zip(self.masks, self.flips)], axis=1)

    def home(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bucket in which the pair counts: symmetric, and common to both."""
        x = a ^ b
        key, todo = np.zeros_like(a), np.ones(len(a), bool)
        for m in self.masks:
            d = x & m
            here = todo & (np.bitwise_count(d) <= self.inner)
            if here.any():
                rest = d[here]
                low = np.zeros_like(rest)
                for _ in range(self.half):  # up to half of the differing bits, lowest first
                    take = np.bitwise_count(low) * 2 < np.bitwise_count(d[here])
                    bit = np.where(take, rest & (~rest + np.uint64(1)), np.uint64(0))
                    low |= bit
                    rest ^= bit
                am, bm = a[here] & m, b[here] & m
                key[here] = np.minimum(am ^ low, bm ^ low)
                todo &= ~here
        return key

    def links(self, key, a, b):
        """Which of the candidate pairs are links that count in bucket ``key``."""
        near = np.bitwise_count(a ^ b) <= self.radius
        at = np.flatnonzero(near & (a != b))
        return at[self.home(a[at], b[at]) == key[at]]


_PART = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary())])
_PART_DDL = "node long, n long, root long, key long, chunk int, payload binary"


def _emit(a, b, na, nb, key=(), chunk=(), payload=()):
    """Links a-b as partial counts and star edges, then chunks of hot buckets."""
    node, n = sums(np.concatenate([a, b]), np.concatenate([nb, na]))
    leaf, root = stars(a, b)
    assert np.array_equal(node, leaf)
    pad = len(key)
    none = pa.nulls(len(node))
    cols = [(node.view(np.int64), [None] * pad), (n, [None] * pad), (root.view(np.int64), [None] * pad), (none, list(key)), (none, list(chunk)), (none, list(payload))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type), pa.array(y, f.type)]) for (x, y), f in zip(cols, _PART)], schema=_PART)


def _all_pairs(ball, key, fa, na, fb, nb, step: int = 256):
    """Links between two lists of one bucket, by rows of ``step`` at a time."""
    out = []
    for s in range(0, len(fa), step):
        x = np.bitwise_count(fa[s : s + step, None] ^ fb[None, :]) <= ball.radius
        i, j = np.nonzero(x)
        i += s
        a, b = fa[i], fb[j]
        hit = ball.links(np.full(len(a), key, np.uint64), a, b)
        out.append((a[hit], b[hit], na[i[hit]], nb[j[hit]]))
    return [np.concatenate(c) for c in zip(*out)]


def bucket_mapper(ball: Ball, block: int):
    """Links inside buckets; rows (key, fp, n) come sorted by key and fp.

    Buckets of one row end here.  Buckets of up to ``block`` rows are compared
    here; larger ones also go out in chunks that meet chunk by chunk elsewhere.
    """

    def whole(key, fp, n):
        """Links within complete buckets, by shifting the sorted rows."""
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
        key, fp, n = key[keep], fp[keep], n[keep]
        out, shift, left = [], 1, np.arange(len(key))
        while True:
            left = left[left + shift < len(key)]
            left = left[key[left] == key[left + shift]]
            if not len(left):
                break
            hit = left[ball.links(key[left], fp[left], fp[left + shift])]
            out.append((fp[hit], fp[hit + shift], n[hit], n[hit + shift]))
            shift += 1
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2

    def run(batches):
        tail = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        chunk = 0
        for batch in batches:
            cols = [np.concatenate([t, batch.column(i).to_numpy(zero_copy_only=False).view(t.dtype)]) for i, t in enumerate(tail)]
            key = cols[0]
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last and chunk:  # the head ends a bucket that was cut
                end = int(np.flatnonzero(key != key[0])[0])
                yield piece(key[0], cols[1][:end], cols[2][:end], chunk)
                cols, last, chunk = [c[end:] for c in cols], last - end, 0
            if last:
                yield _emit(*whole(*[c[:last] for c in cols]))
            tail = [c[last:] for c in cols]
            while len(tail[0]) > block:
                yield piece(tail[0][0], tail[1][:block], tail[2][:block], chunk)
                tail, chunk = [c[block:] for c in tail], chunk + 1
        if len(tail[0]):
            yield piece(tail[0][0], tail[1], tail[2], chunk) if chunk else _emit(*whole(*tail))

    def piece(key, fp, n, chunk):
        fp, at = np.unique(fp, return_index=True)
        n = n[at]
        a, b, na, nb = _all_pairs(ball, key, fp, n, fp, n)
        once = a < b
        return _emit(a[once], b[once], na[once], nb[once], [int(np.uint64(key).view(np.int64))], [chunk], [np.stack([fp, n.view(np.uint64)]).tobytes()])

    return run


def tile_mapper(ball: Ball):
    def run(batches):
        for batch in batches:
            for key, left, right in zip(*[c.to_pylist() for c in batch.columns]):
                l, r = (np.frombuffer(x, np.uint64).reshape(2, -1) for x in (left, right))
                yield _emit(*_all_pairs(ball, np.int64(key).view(np.uint64), l[0], l[1].view(np.int64), r[0], r[1].view(np.int64)))

    return run


def fingerprint_links(fps: DataFrame, ball: Ball, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(partial counts ``node, n``, star edges ``a, b``) of ``fps(fp, n)``.

    ``n`` of a node is how many rows hold the fingerprints it links with.
    """

    def emit(batches):
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            fp, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for s in range(0, len(fp), 2048):
                part = fp[s : s + 2048]
                keys = ball.variants(part)
                w = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, w).view(np.int64)), pa.array(np.repeat(n[s : s + 2048], w))], schema=schema)

    rows = fps.select("fp", "n").mapInArrow(emit, "key long, fp long, n long")
    met = stored(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(bucket_mapper(ball, block), _PART_DDL), "simhash-links")
    tiles = tile_pairs(met.where("payload is not null").select("key", "chunk", "payload")).mapInArrow(tile_mapper(ball), _PART_DDL)
    found = met.where("node is not null").select("node", "n", "root").union(tiles.where("node is not null").select("node", "n", "root"))
    return found.select("node", "n"), found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, blocks: int = 3, shingle: int = 4, seed: int = 42, block: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, n_near, component_id, kept`` per input row.

    Fingerprints link at ``radius`` or fewer differing bits.  Equal ones are
    grouped before anything is emitted.  Null and empty texts have fingerprint
    zero and link like any other.  ``n_near`` counts rows, so a repeated row
    counts its copies; ``component_id`` is the smallest non-null id reachable
    (null where a component has only null ids) and ``kept`` marks the one row
    with that id (the first by row number where ids repeat).  Only the two
    named columns are read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    printed = stored(rows.mapInArrow(fingerprint_mapper(shingle, seed), "doc_id long, fp long").withColumn("rid", F.monotonically_increasing_id()), "simhash-prints")
    fps = stored(printed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid")).alias("low")), "simhash-distinct")
    counts, edges = fingerprint_links(fps, Ball(radius, blocks), block)
    per_fp = counts.groupBy(F.col("node").alias("fp")).agg(F.sum("n").alias("near"))
    roots = components(edges).withColumnRenamed("node", "fp")
    known = stored(fps.join(roots, "fp", "left").join(per_fp, "fp", "left").select("fp", "low", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.coalesce("root", "fp").alias("root")), "simhash-known")
    least = known.groupBy("root").agg(F.min("low").alias("first"))
    final = known.join(least, "root").select("fp", "n_near", "first")
    return printed.join(final, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", F.col("first.doc_id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))
