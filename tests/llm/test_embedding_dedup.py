import math
import random

import numpy as np
import pytest

from ledgerlark.llm import embedding_dedup as e


def brute(rows, cosine=0.93):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))

    n = len(rows)
    near = [[j for j in range(n) if j != i and good(*rows[i][1:]) and good(*rows[j][1:]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out, at = [], 0
    for c in range(12):
        center = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 12))):
            out.append((at, (center + rng.normal(size=8) * 0.25).tolist(), c % 3))
            at += 1
    out += [(at, out[0][1], 0), (at + 1, out[0][1], 0), (at + 2, out[0][1], 1), (at + 3, [2 * x for x in out[0][1]], 0), (at + 4, None, 0), (at + 5, [0.0] * 8, 0), (at + 6, [float("nan")] + [1.0] * 7, 0), (at + 7, [float("inf")] + [1.0] * 7, 0), (at + 8, [None] + [1.0] * 7, 0), (at + 9, out[0][1], None), (at + 10, [], 0), (at + 11, [1.0, 0.0], 0), (at + 12, [1.0, 0.01], 0), (at + 13, [-0.0, 1.0], 0), (at + 14, [0.0, 1.0], 0)]
    random.Random(2).shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"max_cells": 1}, {"block": 3}, {"block": 1, "max_cells": 2}])
def test_links_equal_brute_force(spark, rows, options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    out = e.embedding_dedup(df, **options).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("cells", [1, 3])
def test_cells_between_one_and_two_blocks(spark, cells):
    # many labels, so that most cells lie within a partition and are not its first or last
    rng = np.random.default_rng(8)
    rows = []
    for label in range(60):
        for _ in range(label % 9 + 1):
            rows.append((len(rows), (np.ones(3) + rng.normal(size=3) * 0.15).tolist(), label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = e.embedding_dedup(df, block=4, max_cells=cells).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute(rows)


def pair_at(rng, cosine, dims):
    x = rng.normal(size=dims)
    x /= np.linalg.norm(x)
    y = rng.normal(size=dims)
    y -= x * (x @ y)
    return x, cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_every_pair_at_the_threshold_meets_once():
    rng = np.random.default_rng(1)
    c = e.spherical_kmeans(e.unit(rng.normal(size=(300, 6))), 12)
    for _ in range(500):
        (hx, hy), (vx, vy) = e.cells_of(np.stack(pair_at(rng, 0.93, 6)), c, 0.93)
        assert hx == hy or bool(vx[hy]) != bool(vy[hx])


def test_pairs_meet_where_centroids_all_but_coincide():
    rng = np.random.default_rng(3)
    for size in (3e-9, 1e-8, 3e-8) * 50:
        h = e.unit(rng.normal(size=(1, 6)))[0]
        w = rng.normal(size=6)
        w -= h * (h @ w)
        w /= np.linalg.norm(w)
        c = e.unit(np.stack([h - w * size / 2, h + w * size / 2]))
        t = math.acos(0.9300001)
        x, y = (math.cos(a) * h + math.sin(a) * w for a in (0.9 * t, -0.1 * t))
        (hx, hy), (vx, vy) = e.cells_of(np.stack([x, y]), c, 0.93)
        assert hx == hy or bool(vx[hy]) != bool(vy[hx])


def test_pairs_at_the_threshold_link_whatever_their_size():
    a, b = np.array([[3.0, 4.0]]), np.array([[4.0, 3.0]])
    for k in (-1000, -300, 0, 300, 1000):
        assert e.linked(a * 2.0**k, b * 2.0**k, 0.96).all() and e.linked(a * 2.0**k, b, 0.96).all()


def test_pairs_at_the_threshold_link(spark):
    # 3-4-5 triangles: the cosine is 0.96 exactly, and 24/25 divides evenly in sums
    rows = [(1, [3.0, 4.0], 1), (2, [4.0, 3.0], 1), (3, [1.0, 0.0], 1), (4, [0.96, 0.28], 1)]
    out = {r["vec_id"]: r["n_links"] for r in e.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.96).collect()}
    assert out == {i: n for i, n, _ in brute(rows, 0.96)} and out[1] and out[3]


def test_more_than_one_cell_at_every_size(table):
    for sf in ("sf0.001", "sf0.01"):
        stats = {}
        v = table("embeddings", sf)
        rows = e.embedding_dedup(v, stats=stats).count()
        homes = stats["placed"].where("not visit")
        assert rows == v.count() and stats["cells"][64] > 1 and homes.select("cell").distinct().count() == stats["cells"][64]
        assert homes.count() == homes.select("rep").distinct().count()
    assert [e.cell_count(m, 1024) for m in (1, 8, 59, 5681, 10**9, 10**12)] == [1, 2, 4, 18, 1000, 1024]


def test_without_labels_clashing_names_and_empty(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v, _ in rows[:20]], "vec_id long, v array<double>, rep int, tag int")
    out = e.embedding_dedup(df, vector_col="v", label_col=None).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute([(i, v, 0) for i, v, _ in rows[:20]])
    assert e.embedding_dedup(df.where("false"), vector_col="v", label_col=None).count() == 0


def test_driver_table(table):
    v = table("embeddings")
    out = e.embedding_dedup(v).collect()
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in v.collect()])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == want
