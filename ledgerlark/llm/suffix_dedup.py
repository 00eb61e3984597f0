"""Repeated-substring removal by prefix-free parsing.

A rolling hash picks triggers: in every window of ``length`` bytes the ``k``-gram
with the least hash.  Consecutive windows with one trigger form a phrase, so
every window lies in exactly one phrase, and equal windows have equal triggers
at equal places.  The parse of the corpus is its list of phrases; equal phrases
collapse to one dictionary entry with its occurrences in reading order.  All but
the first occurrence of a phrase are repeats as a whole once their bytes are
found equal.  Where one trigger has several dictionary phrases, the suffix array
of that part of the dictionary is built: suffixes in byte order to the depth of
``length``, which is all that a repeat of that length can tell.  Equal suffixes
are put in corpus order through the places of their phrases in the parse.

Hashes only bring together what may be equal; every removal rests on bytes.
What travels is 40 bytes a phrase (one for about 35 bytes of text, fewer where
text repeats within a task), the bytes of phrases that occur again or whose
trigger is shared, and each document twice in compressed form.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored, utf8

_B = 0x9E3779B97F4A7C15
_BASE, _INVERSE = np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))
_PIECE = 1 << 19  # windows hashed at a time
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _TABLES.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _TABLES[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _prefix(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(b)), out=out[1:])
    return out


def _spans_hash(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of bytes lo..hi, equal for equal bytes wherever they stand."""
    return (p[hi] - p[lo]) * _powers(_INVERSE, len(p))[lo]


def phrases(b: np.ndarray, length: int, k: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """(trigger hash, phrase hash, first window, windows, trigger's offset) of
    each phrase of one text, in order; nothing for texts below ``length``.
    ``bits`` shortens the hashes, to make them collide in tests."""
    if len(b) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    out, w = [], length - k + 1
    for s in range(0, len(b) - length + 1, _PIECE):
        part = b[s : s + _PIECE + length - 1]
        p = _prefix(part)
        h = _mix((p[k:] - p[:-k]) * _powers(_INVERSE, len(p))[: len(p) - k])
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(h) // w)
        grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(h)] = key
        grid = grid.reshape(rows, w)
        before = np.minimum.accumulate(grid, axis=1).reshape(-1)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        at = (np.minimum(after[: len(h) - w + 1], before[w - 1 : len(h)]) & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.concatenate([lo, [len(at)]]))
        a = at[lo]
        g = _mix(_spans_hash(p, lo, lo + n - 1 + length) + (n * 128 + a - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out.append((h[a], g, lo + s, n, a - lo))
    h, g, lo, n, off = (np.concatenate(c) for c in zip(*out))
    cut = np.uint64(64 - bits)
    return (h >> cut, g >> cut, lo, n, off) if bits < 64 else (h, g, lo, n, off)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``text`` at each of ``a`` equal those at ``b``."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), 4096):
        n = size[s : s + 4096]
        at = np.cumsum(n) - n
        j = np.arange(int(n.sum())) - np.repeat(at, n)
        differ = text[np.repeat(a[s : s + 4096], n) + j] != text[np.repeat(b[s : s + 4096], n) + j]
        out[s : s + 4096] = np.add.reduceat(differ, at) == 0
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; touching ones become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.concatenate([at[1:], [len(end)]]) - 1]


_ROW = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("pk", pa.int64())])
_ROW_DDL = "k long, h long, g long, doc long, pk long"


def _parsed(batches, length: int, k: int, bits: int, many: int = 200_000):
    """(h, g, doc, first window, windows, offset, place of the first window in
    the joined bytes) arrays of about ``many`` phrases, and those bytes."""
    held, texts, count, at = [], [], 0, 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, doc in enumerate(ids):
            raw = utf8(batch.column(1)[i].as_py())
            if len(raw) < length:
                continue
            h, g, lo, n, off = phrases(np.frombuffer(raw, np.uint8), length, k, bits)
            held.append((h, g, np.full(len(h), doc, np.int64), lo, n, off, lo + at))
            texts.append(raw)
            count += len(h)
            at += len(raw)
            if count >= many:
                yield [np.concatenate(c) for c in zip(*held)], b"".join(texts)
                held, texts, count, at = [], [], 0, 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)], b"".join(texts)


def parse_mapper(length: int, k: int, hot: np.ndarray, bits: int = 64):
    """One row a phrase.  Of phrases that repeat byte for byte among those held
    at a time the first goes on; the others are repeats already and leave as
    merged intervals (``pk`` negative: ``g`` start, ``-pk`` length)."""

    def run(batches):
        for (h, g, doc, lo, n, off, at), text in _parsed(batches, length, k, bits):
            text = np.frombuffer(text, np.uint8)
            order = np.lexsort((lo, doc, g, h))
            o_n, o_at = n[order], at[order]
            same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]) & (o_n[1:] == o_n[:-1])])
            hit = np.flatnonzero(same)
            same[hit] = same_bytes(text, o_at[hit], o_at[hit - 1], o_n[hit] - 1 + length)
            again, first = order[same], order[~same]
            first.sort()
            key = h[first].copy()
            heavy = np.isin(key, hot)
            key[heavy] = _mix(key[heavy] + (g[first][heavy] & np.uint64(255)) * np.uint64(_B))
            cols = [key, h[first], g[first], doc[first], lo[first] << 14 | n[first] << 7 | off[first]]
            if len(again):
                ids = doc[again]
                order = again[np.argsort(ids, kind="stable")]
                cut = np.flatnonzero(np.diff(doc[order])) + 1
                rows = []
                for p in np.split(order, cut):
                    s, e = merged(lo[p], lo[p] + n[p] - 1 + length)
                    rows.append((np.full(len(s), doc[p[0]]), s, e - s))
                d, s, size = (np.concatenate(c) for c in zip(*rows))
                spread = _mix(d.astype(np.uint64) * np.uint64(_B))
                cols = [np.concatenate([x, y]) for x, y in zip(cols, (spread, spread, s.astype(np.uint64), d, -size))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols], schema=_ROW)

    return run


def hot_mapper(length: int, k: int, bits: int = 64):
    """Triggers that hold over a thousandth of the phrases at hand, and the total."""

    def run(batches):
        for (h, *_), _ in _parsed(batches, length, k, bits):
            v, c = np.unique(h, return_counts=True)
            big = c * 1000 > len(h)
            yield pa.RecordBatch.from_arrays([pa.array(v[big].view(np.int64)), pa.array(c[big].astype(np.int64))], names=["h", "n"])

    return run


_MET = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])
_MET_DDL = "doc long, start long, size long, n int, off int, h long, g long"


def dictionary_mapper(length: int, hot: np.ndarray):
    """Rows sorted by (k, h, g, doc, pk).  Intervals pass through (``size``); all
    occurrences of a phrase that has several ask for their bytes (``n`` and
    ``h``), and so does one of each phrase of a shared trigger (``n`` alone)."""
    hot = hot.view(np.int64)

    def run(batches):
        wait = None  # the first phrase of a trigger that may be its only one
        last = None  # the row before, whose successor is not known yet
        for batch in _with_end(batches):
            out: list = []  # (doc, start, size or None, n, off, h, g)
            if batch is not None:
                _, h, g, doc, pk = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                gone = pk < 0
                out.append((doc[gone], g[gone], -pk[gone], None, None, None, None))
                rows = np.stack([c[~gone] for c in (h, g, doc, pk)])
            else:
                rows = np.zeros((4, 0), np.int64)
            new_h, new_g = np.ones(rows.shape[1], bool), np.ones(rows.shape[1], bool)
            if rows.shape[1]:
                new_h[1:] = rows[0, 1:] != rows[0, :-1]
                new_g[1:] = new_h[1:] | (rows[1, 1:] != rows[1, :-1])
                if last is not None:
                    new_h[0] = rows[0, 0] != last[0][0]
                    new_g[0] = new_h[0] or rows[1, 0] != last[0][1]
            if last is not None:
                rows = np.column_stack([last[0], rows])
                new_h, new_g = np.append(last[1], new_h), np.append(last[2], new_g)
            if batch is not None and len(new_h):
                next_new = new_g[1:]
                last = rows[:, -1], new_h[-1], new_g[-1]
                rows, new_h, new_g = rows[:, :-1], new_h[:-1], new_g[:-1]
            else:
                next_new, last = np.append(new_g[1:], True)[: len(new_g)], None
            twin = ~new_g | ~next_new
            out.append((*_asked(rows[:, twin]), rows[0, twin], rows[1, twin]))
            c = np.flatnonzero(new_g)
            firsts, opens = rows[:, c], new_h[c]
            if wait is not None:
                firsts, opens = np.column_stack([wait, firsts]), np.append(True, opens)
            if len(opens):
                shared = ~opens
                shared[:-1] |= ~opens[1:]
                shared |= np.isin(firsts[0], hot)
                wait = firsts[:, -1] if opens[-1] and not shared[-1] else None
                out.append((*_asked(firsts[:, shared]), None, None))
            cols = []
            for i, f in enumerate(_MET):
                cols.append(pa.concat_arrays([pa.array(part[i].astype(f.type.to_pandas_dtype())) if part[i] is not None else pa.nulls(len(part[0]), f.type) for part in out]))
            yield pa.RecordBatch.from_arrays(cols, schema=_MET)

    return run


def _with_end(batches):
    """Non-empty batches, then None."""
    for batch in batches:
        if len(batch):
            yield batch
    yield None


def _asked(rows: np.ndarray):
    """(doc, start, no size, windows, offset) of phrase rows."""
    return rows[2], rows[3] >> 14, None, rows[3] >> 7 & 127, rows[3] & 127


def trigger_mapper(length: int, k: int, bits: int):
    """Every phrase as a request with its trigger, none collapsed."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for (h, _, doc, lo, n, off, _), _ in _parsed(batches, length, k, bits):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(h.view(np.int64))], schema=schema)

    return run


_WIN = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("body", pa.binary()), ("h", pa.int64())])
_WIN_DDL = "key long, doc long, start long, body binary, h long"


def fetch_mapper(length: int, k: int):
    """Bytes of requested phrases.  Occurrences of one phrase go whole, keyed by
    their hashes, with ``h``.  Others go in two halves: windows whose trigger
    stands in their first half share the bytes after it, the others the bytes
    before it, and the hash of the shared bytes is the key."""
    half = (length - k + 1) // 2
    sign = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches):
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            rows: list[list] = [[], [], [], [], []]
            for doc, packed, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = unpack(packed)
                for q in asked:
                    lo, n, off, h = q["start"], q["n"], q["off"], q["h"]
                    if h is not None:
                        parts = ((lo, lo + n, sign((h * _B + q["g"]) % (1 << 64))),)
                    else:
                        a, cut = lo + off, max(0, min(n, off - half))
                        parts = [(first, last, sign(xxhash.xxh64_intdigest(raw[left:right], a == left))) for first, last, left, right in ((lo, lo + cut, a - half - 1, a + k), (lo + cut, lo + n, a, a + length - half)) if first < last]
                    for first, last, key in parts:
                        for c, v in zip(rows, (key, doc, first, raw[first : last - 1 + length], h)):
                            c.append(v)
                if len(rows[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _WIN)], schema=_WIN)
                    rows = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _WIN)], schema=_WIN)

    return run


def suffix_array(text: np.ndarray, starts: np.ndarray, length: int, *before: np.ndarray, run: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, and whether each agrees with its
    predecessor in ``length`` bytes.

    Groups ``before[0]`` come first, then bytes to the depth of ``length``;
    suffixes equal to that depth follow the other keys of ``before``.  About
    ``run`` suffixes are spelt out at a time, after a sort by their first bytes.
    """
    group, *ties = before
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    head = min(length, 8)
    word = np.zeros((len(starts), 8), np.uint8)
    word[:, 8 - head :] = view[starts, :head]
    word = word.view(">u8").reshape(-1).astype(np.uint64)
    order = np.lexsort((word, group))
    g, w = group[order], word[order]
    new = np.flatnonzero((g[1:] != g[:-1]) | (w[1:] != w[:-1])) + 1
    same = np.zeros(len(order), bool)
    a = 0
    while a < len(order):  # whole groups of equal first bytes at a time
        at = np.searchsorted(new, a + run)
        b = int(new[at]) if at < len(new) else len(order)
        part = order[a:b]
        suffix = np.ascontiguousarray(view[starts[part]]).view(f"S{length}").reshape(-1)
        sub = np.lexsort((*(t[part] for t in reversed(ties)), suffix, group[part]))
        order[a:b] = part = part[sub]
        suffix = suffix[sub]
        same[a + 1 : b] = (group[part][1:] == group[part][:-1]) & (suffix[1:] == suffix[:-1])
        a = b
    return order, same


def repeated_windows(group: np.ndarray, doc: np.ndarray, start: np.ndarray, bodies: list[bytes], length: int):
    """Intervals of windows that occur in the same group at an earlier place.

    The bodies are the group's part of the dictionary.  Its suffix array puts
    equal windows next to each other, in corpus order by the bodies' places.
    """
    size = np.array([len(b) for b in bodies], np.int64)
    n = size - length + 1
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(bodies)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pos = start[row] + j
    order, same = suffix_array(np.frombuffer(b"".join(bodies), np.uint8), base[row] + j, length, group[row], doc[row], pos)
    marked = np.sort(order[same])
    r, q = row[marked], pos[marked]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1)]) if len(r) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(r)]])[: len(first)] - 1
    return doc[r[first]], q[first], q[last] - q[first] + length


_SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("h", pa.int64())])
_SPAN_DDL = "doc long, start long, size long, h long"


def _spans(doc, start, size, h=None):
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, start, size)), pa.array(h, pa.int64()) if h is not None else pa.nulls(len(doc), pa.int64())], schema=_SPAN)


def window_mapper(length: int, many: int = 3_000):
    """Rows sorted by (key, doc, start).

    Occurrences of one phrase (``h``) are repeats if their bytes are those of the
    occurrence before; one that differs gives its trigger away as ``h``, no
    interval.  Others are compared in complete groups, single rows dropped.
    """

    def compare(key, doc, start, bodies):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        keep = np.flatnonzero(np.bincount(group)[group] > 1)
        none = np.zeros(0, np.int64)
        return _spans(*(repeated_windows(group[keep], doc[keep], start[keep], [bodies[i] for i in keep.tolist()], length) if len(keep) else (none,) * 3))

    def run(batches):
        held: list = [np.zeros(0, np.int64)] * 3 + [[]]
        before = (None, None)
        for batch in batches:
            for s in range(0, len(batch), many):
                part = batch.slice(s, many)
                whole = np.array(part.column(4).is_valid())
                if whole.any():
                    at = pa.array(np.flatnonzero(whole))
                    key, doc, start, h = (part.column(i).take(at).to_numpy() for i in (0, 1, 2, 4))
                    body = part.column(3).take(at).to_pylist()
                    met = np.concatenate([[key[0] == before[0]], key[1:] == key[:-1]])
                    same = np.array([m and b == a for m, a, b in zip(met.tolist(), [before[1], *body], body)], bool)
                    before = key[-1], body[-1]
                    size = np.array([len(b) for b in body], np.int64)
                    yield _spans(doc[same], start[same], size[same])
                    odd = met & ~same
                    if odd.any():
                        yield _spans(doc[odd], start[odd], size[odd], h[odd])
                    part = part.take(pa.array(np.flatnonzero(~whole)))
                if not len(part):
                    continue
                held = [np.concatenate([x, part.column(i).to_numpy()]) for i, x in enumerate(held[:3])] + [held[3] + part.column(3).to_pylist()]
                key = held[0]
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if cut:
                    yield compare(*[c[:cut] for c in held])
                    held = [c[cut:] for c in held]
        if len(held[0]):
            yield compare(*held)

    return run


def _free(spark) -> None:
    """Let Spark drop shuffle files of steps whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, doc: str, text: str, length: int, k: int, hot_rows: int, hot_group: int, bits: int = 64) -> DataFrame:
    """``doc, start, size``: intervals (they may overlap) whose union is removed."""
    spark = docs.sparkSession
    rows = pick(docs, doc=doc, text=text).where(F.octet_length("text") >= length)
    counts = rows.mapInArrow(hot_mapper(length, k, bits), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_rows)
    hot = np.array(sorted(r["h"] for r in counts.collect()), np.int64).view(np.uint64)
    parsed = rows.mapInArrow(parse_mapper(length, k, hot, bits), _ROW_DDL)
    met = stored(parsed.repartition("k").sortWithinPartitions("k", "h", "g", "doc", "pk").mapInArrow(dictionary_mapper(length, hot), _MET_DDL), "phrases")
    _free(spark)
    found = _compared(rows, met.where("n is not null").select("doc", "start", "n", "off", "h", "g"), length, k, hot_group)
    spans = met.where("size is not null").select("doc", "start", "size").union(found.where("h is null").select("doc", "start", "size"))
    doubt = found.where("h is not null").select("h").distinct()
    if doubt.limit(1).count():  # phrases whose hashes collide: all windows of their triggers are compared
        every = rows.mapInArrow(trigger_mapper(length, k, bits), "doc long, start long, n int, off int, h long").join(doubt, "h", "left_semi")
        none = F.lit(None).cast("long")
        spans = spans.union(_compared(rows, every.select("doc", "start", "n", "off", none.alias("h"), none.alias("g")), length, k, hot_group).select("doc", "start", "size"))
    return spans


def _compared(rows: DataFrame, requests: DataFrame, length: int, k: int, hot_group: int) -> DataFrame:
    """``doc, start, size, h`` found among the requested phrases by their bytes."""
    spark = rows.sparkSession
    asked = requests.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "off", "h", "g")).alias("asked"))
    wins = packed(rows).join(asked, "doc").select("doc", "body", "asked").mapInArrow(fetch_mapper(length, k), _WIN_DDL)
    wins = stored(wins, "windows")
    _free(spark)
    sizes = wins.where("h is null").groupBy("key").count()
    crowded = stored(sizes.where(F.col("count") > hot_group).select("key"), "crowded")
    quiet, spans = wins, None
    if crowded.limit(1).count():
        busy = F.col("h").isNull() & F.col("crowd").isNotNull()
        marked = wins.join(crowded.withColumn("crowd", F.lit(1)), "key", "left")
        quiet = marked.where(~busy).drop("crowd")
        spans = _crowded_spans(marked.where(busy), length)
    found = quiet.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(window_mapper(length), _SPAN_DDL)
    return stored(found if spans is None else found.unionByName(spans, allowMissingColumns=True), "repeats")


def _crowded_spans(wins: DataFrame, length: int, salts: int = 32) -> DataFrame:
    """The same for crowded keys, window by window: the first place of each
    window by a group-by with partial minima, then all other places.  A window
    repeated without end is joined in ``salts`` parts."""
    each = wins.select("doc", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("body") - (length - 1)), lambda i: F.substring("body", i, F.lit(length)))).alias("j", "w"), "start")
    each = each.select("w", "doc", (F.col("start") + F.col("j")).alias("start"))
    least = each.groupBy("w").agg(F.min(F.struct("doc", "start")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "low", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(salts)).cast("int"))
    return salted.join(least, ["w", "salt"]).where(F.struct("doc", "start") != F.col("low")).select("doc", "start", F.lit(length).cast("long").alias("size"))


def packed(rows: DataFrame) -> DataFrame:
    """``doc, body``: UTF-8 of each text, compressed for the shuffle."""
    schema = pa.schema([("doc", pa.int64()), ("body", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(utf8(t)) for t in batch.column(1).to_pylist()], pa.binary())], schema=schema)

    return rows.select("doc", "text").mapInArrow(run, "doc long, body binary")


def cut_mapper():
    schema = pa.schema([("doc", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, kept, at, gone = unpack(body), hashlib.sha256(), 0, []
                if spans:
                    s, e = merged(np.array([x["start"] for x in spans], np.int64), np.array([x["start"] + x["size"] for x in spans], np.int64))
                    for a, b in zip(s.tolist(), e.tolist()):
                        kept.update(raw[at:a])
                        gone.append({"start": a, "end": b})
                        at = b
                kept.update(raw[at:])
                for c, v in zip(out, (gone, len(raw), sum(x["end"] - x["start"] for x in gone), kept.hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(out, list(schema)[1:])]], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int = 32, hot_rows: int = 4_000_000, hot_group: int = 50_000, bits: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` per input row.

    A byte goes if a string of ``length`` bytes covers it that also starts
    earlier: in a smaller id, or earlier in the same text.  ``spans`` are the
    maximal removed runs (byte offsets, end exclusive) and ``kept_sha256`` is
    of the bytes left.  Null is empty; texts below ``length`` bytes keep all.
    Rows with a repeated or null id are told apart and ordered by id (null
    last), then by text (null first).  An empty table gives an empty result.
    Only the two named columns are read.  Triggers with over ``hot_rows`` phrases
    are spread by phrase, keys with over ``hot_group`` dictionary phrases go
    window by window; results are the same.  ``bits`` shortens the phrase hashes:
    collisions cost time, no result changes.
    """
    if not k <= length <= k + 95:
        raise ValueError("length must be between k and k + 95")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if odd:
        rows = stored(rows.orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")).withColumn("doc", F.monotonically_increasing_id()), "numbered")
    else:
        rows = rows.withColumn("doc", F.col("doc_id"))
    spans = repeated_spans(rows, "doc", "text", length, k, hot_rows, hot_group, bits)
    per = stored(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans")), "spans")
    _free(docs.sparkSession)
    cut = packed(rows).join(per, "doc", "left").select("doc", "body", "spans").mapInArrow(cut_mapper(), "doc long, spans array<struct<start:long,end:long>>, n_bytes long, n_removed long, kept_sha256 string")
    if odd:
        cut = cut.join(rows.select("doc", "doc_id"), "doc")
    else:
        cut = cut.withColumn("doc_id", F.col("doc"))
    return cut.select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256")
