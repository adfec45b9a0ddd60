"""Arrow helpers on slices, nulls and empty arrays."""

import pyarrow as pa
import pyarrow.compute as pc

from quantfold.llm.common import large, merged, ragged_take, slices, words

TEXTS = ["Zero", None, "One  TWO", "", " \n", "Éa\x0bB", "x" * 50, None]


def test_large_starts_at_zero():
    for kind in (pa.string(), pa.large_string()):
        for at in range(len(TEXTS) + 1):
            a = large(pa.array(TEXTS, kind).slice(at))
            assert a.to_pylist() == [t or "" for t in TEXTS[at:]]
            assert pc.ascii_lower(a).to_pylist() == ["".join(c.lower() if c.isascii() else c for c in t or "") for t in TEXTS[at:]]
    assert large(pa.array([b"a", None]).slice(1)).to_pylist() == [b""]


def test_words():
    for at in range(len(TEXTS)):
        offsets, flat = words(large(pa.array(TEXTS).slice(at)))
        got = [flat.to_pylist()[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        assert got == [(t or "").replace("\x0b", " ").split() for t in TEXTS[at:]]


def test_slices_and_merged_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["i", "text"])
    for limit in (1, 7, 60, 1000):
        cut = list(slices(iter([batch, batch]), "text", limit))
        assert [i for b in cut for i in b.column("i").to_pylist()] == [*range(len(TEXTS))] * 2
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= limit for b in cut)
        assert [i for t in merged(iter([batch, batch]), "text", limit) for i in t["i"].to_pylist()] == [*range(len(TEXTS))] * 2


def test_ragged_take():
    import numpy as np

    assert ragged_take(np.array([3, 0, 1]), np.array([2, 0, 3]), np.arange(10)).tolist() == [3, 4, 1, 2, 3]
