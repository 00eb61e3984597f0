import hashlib
import random

import numpy as np
import pytest

from ledgerlark.llm import suffix_dedup as s


def brute(rows, length=100):
    seen, out = set(), {}
    for key, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        gone = gone[: len(b)]
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = [{"start": int(a), "end": int(z)} for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        out[key] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(50, 400))) for _ in range(25)]
    docs = [(i, "".join(rng.choice(base)[rng.randint(0, 60) : rng.randint(100, 400)] + rng.choice(["x", "", "yy"]) for _ in range(rng.randint(0, 6)))) for i in range(110)]
    return docs + [(110, None), (111, ""), (112, "a" * 1000), (113, "ab" * 700), (114, "a" * 99), (115, "a" * 100), (116, docs[3][1]), (117, "b" * 3000 + "a" * 300)]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 4}, {"hot_group": 3}, {"hot_rows": 3, "hot_group": 2}, {"k": 8}, {"bits": 3}, {"bits": 8, "hot_group": 5}])
def test_equals_brute_force(spark, rows, options):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], [x.asDict() for x in r["spans"]], r["kept_sha256"]) for r in s.suffix_dedup(df, **options).collect()}
    assert got == brute(rows)


def test_phrases_hold_every_window_once(rows):
    for _, text in rows:
        b = np.frombuffer((text or "").encode(), np.uint8)
        h, g, lo, n, off = s.phrases(b, 100, 32)
        assert np.array_equal(np.concatenate([np.arange(a, a + c) for a, c in zip(lo, n)] or [np.arange(0)]), np.arange(max(0, len(b) - 99)))
        assert ((off >= 0) & (lo + off + 32 <= lo + 100)).all()


def test_long_texts_are_cut_into_pieces(monkeypatch, rows):
    monkeypatch.setattr(s, "_PIECE", 64)
    b = np.frombuffer(rows[117][1].encode() + rows[5][1].encode(), np.uint8)
    _, _, lo, n, _ = s.phrases(b, 100, 32)
    assert np.array_equal(np.concatenate([np.arange(a, a + c) for a, c in zip(lo, n)]), np.arange(len(b) - 99))


@pytest.mark.parametrize("run", [1, 7, 10_000])
def test_suffix_array_is_in_byte_order(run):
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"ab\x00\xff", np.uint8), 400)
    starts = rng.permutation(391)
    group, place = rng.integers(0, 3, 391), rng.permutation(391)
    order, same = s.suffix_array(text, starts, 10, group, place, run=run)
    key = lambda i: (group[i], text[starts[i] : starts[i] + 10].tobytes(), place[i])
    assert order.tolist() == sorted(range(391), key=key)
    assert same.tolist() == [False] + [key(a)[:2] == key(b)[:2] for a, b in zip(order, order[1:])]


def test_windows_of_a_group_repeat_by_bytes():
    bodies = [b"a" * 100, b"b" * 100, b"a" * 100, b"b" * 101]
    d, q, z = s.repeated_windows(np.zeros(4, np.int64), np.arange(4), np.zeros(4, np.int64), bodies, 100)
    assert sorted(zip(d.tolist(), q.tolist(), z.tolist())) == [(2, 0, 100), (3, 0, 101)]


def test_repeated_and_null_ids(odd, odd_rows, none):
    order = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = s.suffix_dedup(odd).collect()
    assert len(out) == len(odd_rows)
    want = brute([((i, r[0]), r[1]) for i, r in enumerate(order)])
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in out if r["doc_id"] is not None) == sorted((str(k[1]), v[0], v[1], v[3]) for k, v in want.items() if k[1] is not None)
    assert sum(r["n_removed"] for r in out) == sum(v[1] for v in want.values())
    assert s.suffix_dedup(none).count() == 0


def test_driver_table(table):
    docs = table("documents")
    got = {r["doc_id"]: r["kept_sha256"] for r in s.suffix_dedup(docs).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    assert got == {k: v[3] for k, v in want.items()}
