import random

import numpy as np
import pytest
import xxhash

from ledgerlark.llm import simhash as s
from ledgerlark.llm.common import components


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_fingerprint_equals_plain(odd_rows, table):
    texts = [r[1] for r in odd_rows if not r[1] or len(r[1]) < 5000] + [r["text"] for r in table("documents").limit(30).collect()]
    for t in texts:
        assert s.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("radius,blocks", [(4, 3), (4, 1), (3, 3), (2, 2), (4, 4), (1, 1)])
def test_every_near_pair_meets_in_its_home(radius, blocks):
    ball, rng = s.Ball(radius, blocks), random.Random(radius * 10 + blocks)
    for _ in range(120):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), rng.randint(1, radius)):
            b ^= 1 << i
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        home = ball.home(x, y)
        assert home[0] == ball.home(y, x)[0]
        assert home[0] in ball.variants(x)[0] and home[0] in ball.variants(y)[0]


def brute(fps, ids):
    n = len(fps)
    near = [[j for j in range(n) if j != i and bin(fps[i] ^ fps[j]).count("1") <= 4] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((ids[j] for j in seen if ids[j] is not None), default=None)
    return [len(x) for x in near], comp


@pytest.mark.parametrize("block", [4096, 3])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(block)
    fps = []
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            x = center
            for i in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << i
            fps.append(x)
    fps += [0, 0, 1, (1 << 63), (1 << 63) | 3]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    counts, edges = s.fingerprint_links(df, s.Ball(), block)
    got = {r["node"]: r["n"] for r in counts.groupBy("node").agg(F.sum("n").alias("n")).collect()}
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    near, _ = brute(fps, list(range(len(fps))))
    for i, x in enumerate(signed):
        assert got.get(x, 0) + sum(y == x for y in signed) - 1 == near[i]
    _, comp = brute(fps, signed)
    for x, c in zip(signed, comp):
        same = {y for y, d in zip(signed, comp) if d == c}
        assert len({roots.get(y, y) for y in same}) == 1


def test_documents_equal_brute_force(odd, odd_rows, table, none):
    for df in (odd, table("documents")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        fps = [s.fingerprint(t) for _, t in rows]
        near, comp = brute(fps, [i for i, _ in rows])
        want = sorted((str(i), f"{f:016x}", n, str(c)) for (i, _), f, n, c in zip(rows, fps, near, comp))
        out = s.simhash_dedup(df).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["n_near"], str(r["component_id"])) for r in out) == want
        assert sum(r["kept"] for r in out) == len({(c, f) if c is None else c for c, f in zip(comp, fps)})
    assert s.simhash_dedup(none).count() == 0


def test_components_by_contraction(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)] + [(500, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {r["node"]: r["root"] for r in components(df).collect()}
    got = {r["node"]: r["root"] for r in components(df, small=0).collect()}
    assert got == want and got[60] == 0 and 500 not in got
