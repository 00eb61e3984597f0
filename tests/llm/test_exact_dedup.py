import hashlib
import random

import pytest

from ledgerlark.llm import exact_dedup as x


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(x.normalise(text), []).append(doc)
    return groups


def test_directory_splits_until_within_capacity():
    rng = random.Random(3)
    load = [rng.randint(0, 9) for _ in range(64)]
    d = x.Directory(load, 20, 6)
    assert len(d.slots) == 1 << d.depth
    for number, (first, local) in enumerate(d.buckets):
        cells = range(first, first + (1 << (6 - local)))
        assert {d.bucket(c) for c in cells} == {number}
        assert sum(load[c] for c in cells) <= 20 or local == 6
    assert sorted(f for f, _ in d.buckets) == [f for f, _ in d.buckets]


def test_overfull_cell_stays_whole():
    d = x.Directory([0, 500, 0, 0], 10, 2)
    assert d.depth == 2 and d.bucket(1) != d.bucket(0)


def test_directory_doubles_as_cells_come_in():
    d = x.Directory([0] * 8, 10, 3)
    steps = []
    for cell in (0, 7, 1, 1, 6):
        d.insert(cell, 6)
        steps.append((d.depth, len(d.first)))
    assert steps == [(0, 1), (1, 2), (3, 4), (3, 4), (3, 6)]
    assert [d.load[d.bucket(c)] for c in (0, 1, 6, 7)] == [6, 12, 6, 6]


def test_owners_take_ranges_of_like_load():
    d = x.Directory([5] * 64, 5, 6)
    owner = d.owners(4)
    assert owner.tolist() == sorted(owner.tolist()) and {(owner == k).sum() for k in range(4)} == {16}
    assert x.Directory([0] * 4, 5, 2).owners(3).tolist() == [0]


def test_compression_does_not_decide(spark):
    import pyarrow as pa
    import zstandard

    text = b"some text " * 50
    bodies = [zstandard.ZstdCompressor(write_checksum=n).compress(text) for n in (False, True)]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([1, 2]), pa.array(bodies, pa.binary())], names=["hkey", "rep", "body"])
    assert bodies[0] != bodies[1]
    assert next(x.chain_owner([batch])).to_pydict() == {"rep": [1, 2], "cls": [1, 1], "chain": [0, 0]}


@pytest.mark.parametrize("options", [{"capacity": 300, "max_depth": 6}, {"capacity": 300, "max_depth": 6, "local_bytes": 0, "salts": 3}, {"capacity": 1, "max_depth": 1, "local_bytes": 900}, {}])
def test_groups_nulls_and_repeated_rows(odd, odd_rows, options):
    out = x.exact_dedup(odd, **options).collect()
    groups = brute((r[0], r[1]) for r in odd_rows)
    assert len(out) == len(odd_rows)
    kept = {}
    for r in out:
        kept.setdefault(r["text_sha256"], []).append(r)
    assert len(kept) == len(groups)
    for text, ids in groups.items():
        got = kept[hashlib.sha256(text).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert {r["group_size"] for r in got} == {len(ids)} and {r["keep_id"] for r in got} == {top}
        assert sum(r["kept"] for r in got) == 1 and next(r for r in got if r["kept"])["doc_id"] == top


def test_hash_collisions_share_a_chain_not_a_group(spark):
    rows = [(i, f"text {i % 4}") for i in range(20)]
    out = x.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hash_of=lambda b: 7).collect()
    assert {r["group_size"] for r in out} == {5} and len({r["chain"] for r in out}) == 4 and len({r["bucket"] for r in out}) == 1


def test_empty_table(none):
    assert x.exact_dedup(none).count() == 0
