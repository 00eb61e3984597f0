import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import packing
from ledgerlark.llm.bpe import Codec
from ledgerlark.llm.registry import tokenizer_file


def best_fit_decreasing(counts, size):
    """One piece at a time, for comparison."""
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((size if fit is None else fit) - length)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 12), max_size=14))
def test_plan_places_every_piece_without_gaps(counts):
    slots, opened = packing.plan(counts, 32)
    use = {}
    for length, n in counts.items():
        mine = sorted(s for s in slots if s[0] == length)
        for rank in range(n):
            _, first, seq, at = [s for s in mine if s[1] <= rank][-1]
            use.setdefault(seq + rank - first, []).append((at, length))
    for parts in use.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 32
    total = sum(k * n for k, n in counts.items())
    assert len(use) == opened and opened >= -(-total // 32)
    assert opened <= best_fit_decreasing(counts, 32) + 1


def test_pack_odd_rows(odd, odd_rows, none):
    path, size = tokenizer_file(), 64
    out = packing.pack(odd, path, size).collect()
    codec = Codec(path)
    want = []
    for doc, text, *_ in odd_rows:
        ids = codec.model.encode(text or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), size):
            part = ids[p : p + size]
            want.append((doc, p // size, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    use = {}
    for r in out:
        use.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in use.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    assert packing.pack(none, path).count() == 0


def test_query_equals_the_library_and_fills_sequences(spark):
    """The query over a whole table at 4096 tokens a sequence."""
    from ledgerlark.llm import registry

    sf, size = "/root/testdata/sf0.001", 4096
    out = registry.op5_best_fit_packing(spark, sf).collect()
    model = Codec(tokenizer_file()).model
    want, counts = [], {}
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), size):
            part = ids[p : p + size]
            counts[len(part)] = counts.get(len(part), 0) + 1
            want.append((doc, p // size, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    use = {}
    for r in out:
        use.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in use.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    assert len(use) <= best_fit_decreasing(counts, size)
