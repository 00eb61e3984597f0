"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Every vector lives in the cell of its nearest centroid ``h`` and visits those
cells of smaller number ``c`` that could hold a partner.  A partner y at home in
c has y.(c-h) >= 0, so x within the angle t of y has x.(h-c) <= sin(t)|h-c|.  A
pair within a cell is met there, a pair of two cells where the larger one's row
visits the smaller one, and visitors are not compared with each other: each pair
is met once, none is lost, and where vectors do not cluster the work is that of
comparing all of a label, never more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import stars, sums
from .common import components, pick, stored


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows ``x``; empty cells take the worst-placed row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        sim = x @ c.T
        at = sim.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        size = np.linalg.norm(new, axis=1)
        for j in np.flatnonzero(size < 1e-9):
            new[j], size[j] = x[sim.max(axis=1).argmin()], 1.0
        c = new / size[:, None]
    return c


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision, whatever their size."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells_of(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, boolean (rows, cells): which cells each unit row visits).

    Squared distances of centroids are rounded, to zero where they all but
    coincide; 1e-12 more keeps them from falling short.
    """
    sim = x @ c.T
    home = sim.argmax(axis=1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)) + 1e-12)[home]
    reach = math.sqrt(1 - cosine * cosine) if cosine > 0 else 2.0
    near = sim[np.arange(len(x)), home][:, None] - sim <= reach * gap + 1e-9
    return home, near & (np.arange(len(c)) < home[:, None])


def linked(ra: np.ndarray, rb: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean (rows of a, rows of b): cosine >= ``cosine`` in double precision.

    Products within 1e-9 of the threshold are decided by exactly rounded sums,
    of rows brought near 1 by powers of two so that no square leaves the range.
    """
    sim = unit(ra) @ unit(rb).T
    hit = sim >= cosine
    for i, j in zip(*np.nonzero(np.abs(sim - cosine) < 1e-9)):
        a, b = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tolist() for v in (ra[i], rb[j]))
        dot = math.fsum(x * y for x, y in zip(a, b))
        hit[i, j] = dot / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b)) >= cosine
    return hit


_PART = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("dims", pa.int32()), ("tag", pa.int64()), ("cell", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("lead", pa.bool_()), ("payload", pa.binary())])
_PART_DDL = "node long, n long, root long, dims int, tag long, cell int, part int, seq int, lead boolean, payload binary"


class Block:
    """Rows of one cell: whether they visit, ids, weights and vectors."""

    def __init__(self, visit, ids, n, raw):
        self.visit, self.ids, self.n, self.raw = visit, ids, n, raw

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, a: int, b: int) -> Block:
        return Block(self.visit[a:b], self.ids[a:b], self.n[a:b], self.raw[a:b])

    def pack(self) -> bytes:
        """Bytes of the block; vectors in the precision they came in."""
        head = np.array([len(self), self.raw.shape[1], self.raw.dtype.itemsize], np.int64)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, self.ids, self.n, self.raw, self.visit))

    @staticmethod
    def unpack(b: bytes) -> Block:
        m, d, width = (int(v) for v in np.frombuffer(b, np.int64, 3))
        at, parts = 24, []
        for kind, count in ((np.int64, m), (np.int64, m), (np.float32 if width == 4 else np.float64, m * d), (bool, m)):
            parts.append(np.frombuffer(b, kind, count, at))
            at += parts[-1].nbytes
        ids, n, raw, visit = parts
        return Block(visit, ids, n, raw.reshape(m, d))


def compare(x: Block, y: Block | None, cosine: float, step: int = 512):
    """(node, partners' rows, root) of the links between two blocks of a cell, or
    within one (``y`` None), ``step`` rows at a time.  A cell's residents come
    first, so only those of ``x`` have partners in ``y``."""
    same, y = y is None, y if y is not None else x
    x = x.cut(0, len(x) - int(x.visit.sum()))
    nodes, counts, tops, stops = [], [], [], []
    ry = y.raw.astype(np.float64)
    for s in range(0, len(x), step):
        part = x.cut(s, s + step)
        hit = linked(part.raw.astype(np.float64), ry, cosine)
        if same:
            hit &= np.arange(len(y))[None] > np.arange(s, s + len(part))[:, None]
        i, j = np.nonzero(hit)
        if len(i):
            a, b = part.ids[i], y.ids[j]
            node, n = sums(np.concatenate([a, b]), np.concatenate([y.n[j], part.n[i]]))
            nodes.append(node)
            counts.append(n)
            for o, v in zip((tops, stops), stars(a, b)):
                o.append(v)
    if not nodes:
        return (np.zeros(0, np.int64),) * 3
    node, n = sums(np.concatenate(nodes), np.concatenate(counts))
    return node, n, stars(np.concatenate(tops), np.concatenate(stops))[1]


def _found(node, n, root):
    cols = [node, n, root, *[pa.nulls(len(node), f.type) for f in list(_PART)[3:]]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _PART)], schema=_PART)


def cell_mapper(cosine: float, block: int):
    """Compare within cells; rows (dims, tag, cell, visit, rep, n, vec) are sorted.

    A cell of fewer than two ``block`` rows inside this partition is done here,
    its two chunks with each other too.  Larger ones, and the partition's first
    and last, which may go on in another, leave in chunks that meet chunk by
    chunk elsewhere.
    """

    def chunks(key, blk, seq, out):
        parts = [blk.cut(s, s + block) for s in range(0, len(blk), block)]
        for i, c in enumerate(parts):
            yield _found(*compare(c, None, cosine))
            for other in [] if out else parts[i + 1 :]:
                yield _found(*compare(c, other, cosine))
            if out:
                row = [None, None, None, *key, TaskContext.get().partitionId(), seq, bool((~c.visit).any()), c.pack()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PART)], schema=_PART)
                seq += 1

    def run(batches):
        key, held, size, seq, first = None, [], 0, 0, True

        def whole():
            return Block(*(np.concatenate(c) for c in zip(*held)))

        for batch in batches:
            if not len(batch):
                continue
            dims, tag, cell = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (tag[1:] != tag[:-1]) | (cell[1:] != cell[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                now = (int(dims[a]), int(tag[a]), int(cell[a]))
                if now != key:
                    if held:
                        yield from chunks(key, whole(), seq, first or seq > 0)
                        first = False
                    key, held, size, seq = now, [], 0, 0
                part = batch.slice(a, b - a)
                raw = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(b - a, -1)
                raw = raw.view(np.float32 if raw.shape[1] == 4 * now[0] else np.float64)
                held.append((part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(), part.column(5).to_numpy(), raw))
                size += b - a
                while size >= 2 * block:
                    blk = whole()
                    yield from chunks(key, blk.cut(0, block), seq, True)
                    rest = blk.cut(block, len(blk))
                    held, size, seq = [(rest.visit, rest.ids, rest.n, rest.raw)], len(rest), seq + 1
        if held:
            yield from chunks(key, whole(), seq, True)

    return run


def tile_mapper(cosine: float):
    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _found(*compare(Block.unpack(left), Block.unpack(right), cosine))

    return run


def tiles(met: DataFrame) -> DataFrame:
    """Pairs ``left, right`` of different chunks of one cell, of which the left
    holds a resident.  Numbers come from the chunks' places alone; a payload
    travels to each of its pairs, hashed by cell and pair, so none crowds a task."""
    keys = ["dims", "tag", "cell"]
    chunk = met.where("payload is not null")
    place = chunk.select(*keys, "part", "seq")
    w = Window.partitionBy(*keys)
    place = place.select("*", (F.row_number().over(w.orderBy("part", "seq")) - 1).alias("at"), F.count(F.lit(1)).over(w).alias("of")).where("of > 1")
    body = chunk.select(*keys, "part", "seq", "lead", "payload").join(place, [*keys, "part", "seq"])
    left = body.where("lead and at < of - 1").select(*keys, F.col("at").alias("i"), F.explode(F.sequence(F.col("at") + 1, (F.col("of") - 1).cast("int"))).alias("j"), F.col("payload").alias("left"))
    right = body.where("at > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("at") - 1)).alias("i"), F.col("at").alias("j"), F.col("payload").alias("right"))
    return left.join(right, [*keys, "i", "j"]).select("left", "right")


def matrices(column: pa.Array):
    """(row numbers, matrix) for each length of the lists in an Arrow column."""
    size = np.diff(column.offsets.to_numpy())
    flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def placed_cells(good: DataFrame, centroids: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """``dims, tag, cell, visit, rep, n, vec``: each vector at home and on its visits."""
    shared = good.sparkSession.sparkContext.broadcast(centroids)
    schema = pa.schema([("dims", pa.int32()), ("tag", pa.int64()), ("cell", pa.int32()), ("visit", pa.bool_()), ("rep", pa.int64()), ("n", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, len(b), 1024)):
            for at, raw in matrices(batch.column(3)):
                home, visits = cells_of(unit(raw.astype(np.float64)), shared.value[raw.shape[1]], cosine)
                visits[np.arange(len(at)), home] = True
                row, cell = np.nonzero(visits)
                body = np.array([r.tobytes() for r in raw], object)[row]
                take = pa.array(at[row])
                cols = [np.full(len(row), raw.shape[1], np.int32), batch.column(0).take(take), cell.astype(np.int32), cell != home[row], *(batch.column(i).take(take) for i in (1, 2)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=schema)

    return good.select("tag", "rep", "n", "vec").mapInArrow(run, "dims int, tag long, cell int, visit boolean, rep long, n long, vec binary")


def cell_count(rows: int, max_cells: int) -> int:
    """Cells for ``rows`` vectors of the largest label: the cube root, so that
    visits (at most half the cells a row) and products shrink together."""
    return max(1, min(max_cells, math.ceil(rows ** (1 / 3) - 1e-9)))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.93, max_cells: int = 1024, fit_rows: int = 20_000, block: int = 2048, stats: dict | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per input row; all links, exactly.

    Rows compare only when labels are equal and not null (``label_col=None``:
    always) and dimensions agree.  Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing.  Equal vectors collapse
    before the cells.  Centroids are fitted on at most ``fit_rows`` distinct
    vectors chosen by hash; every row is indexed.  There are as many cells as
    the cube root of the largest label, ``max_cells`` at most (all are broadcast);
    a cell beyond ``block`` rows is compared in tiles, so no bound loses a pair.
    Rows with a repeated id link as separate rows; ``component_id`` is the
    smallest id reachable and ``kept`` marks one row with it.  A null id is above
    every other.  An empty table gives an empty result.  ``stats`` receives the
    cells by dimension and a table of the placed rows, for measurements.
    """
    raw = pick(vectors, vec_id=id_col, vec=vector_col, **({"label": label_col} if label_col else {}))
    kind = raw.schema["label"].dataType if label_col else T.IntegerType()
    tag = F.lit(0).cast("long") if not label_col else F.col("label").cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    kept_type = raw.schema["vec"].dataType.simpleString()
    vec = F.col("vec") if kept_type == "array<float>" else F.col("vec").cast("array<double>")
    wide = F.col("vec").cast("array<double>")
    fine = F.coalesce((F.size(wide) > 0) & ~F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(wide, lambda v: v != 0), F.lit(False))
    base = raw.select(F.col("vec_id").cast("long"), tag.alias("tag"), vec.alias("vec"), fine.alias("fine"), F.monotonically_increasing_id().alias("rid"))
    plain = F.transform("vec", lambda v: v + F.lit(0.0).cast("float" if kept_type == "array<float>" else "double"))  # -0 becomes 0
    base = base.withColumn("vec", F.when(F.col("fine") & F.col("tag").isNotNull(), plain)).drop("fine")
    same = lambda seed: F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(seed), "vec"))
    base = stored(base.withColumns({"h1": same(1), "h2": same(2), "dims": F.when(F.col("vec").isNotNull(), F.size("vec"))}), "vectors")
    # Equal vectors are those of equal 128-bit digests; the vectors themselves travel once.
    keys = ["tag", "dims", "h1", "h2"]
    low = F.struct(F.col("vec_id").isNull().alias("void"), "vec_id", "rid")
    groups = stored(base.where("vec is not null").groupBy(*keys).agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n"), F.min(low).alias("low")), "vectors-distinct")
    good = base.select(F.col("rid").alias("rep"), "tag", "vec").join(groups.select("rep", "n", "dims"), "rep")
    centroids = {}
    for r in groups.groupBy("tag", "dims").count().groupBy("dims").agg(F.max("count").alias("m")).collect():
        chosen = groups.where(F.col("dims") == r["dims"]).orderBy("h1", "rep").limit(fit_rows).select("rep")
        sample = good.join(F.broadcast(chosen), "rep", "left_semi").select("rep", "vec").toArrow().sort_by("rep")
        x = unit(np.array(sample["vec"].to_pylist(), float))
        centroids[r["dims"]] = spherical_kmeans(x, cell_count(r["m"], max_cells))
    placed = stored(placed_cells(good, centroids, cosine), "vector-cells", "none")
    if stats is not None:
        stats |= {"cells": {d: len(c) for d, c in centroids.items()}, "placed": placed}
    by_cell = placed.repartitionByRange("dims", "tag", "cell", "visit", "rep").sortWithinPartitions("dims", "tag", "cell", "visit", "rep")
    met = stored(by_cell.mapInArrow(cell_mapper(cosine, block), _PART_DDL), "vector-links")
    across = tiles(met).mapInArrow(tile_mapper(cosine), _PART_DDL)
    found = stored(met.where("node is not null").select("node", "n", "root").union(across.select("node", "n", "root")), "vector-stars")
    near = found.groupBy(F.col("node").alias("rep")).agg(F.sum("n").alias("near"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = stored(groups.join(near, "rep", "left").join(roots, "rep", "left").select(*keys, "low", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")), "vectors-known")
    final = known.join(known.groupBy("root").agg(F.min("low").alias("first")), "root").select(*keys, "n_links", "first")
    return base.select("vec_id", "rid", *keys).join(final, keys, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("first").isNull(), F.col("vec_id")).otherwise(F.col("first.vec_id")).alias("component_id"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
    )


#: DuckDB: brute force over each label, then reachability.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id,
       (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(r.y) FROM reach r WHERE r.x = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(r.y) FROM reach r WHERE r.x = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""
