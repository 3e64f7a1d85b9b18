"""Texts with more symbols than a packed position has room for."""

import hashlib
import random

import numpy as np
import pytest

from packetloom.llm import hashing, suffix_dedup as suffix


@pytest.mark.parametrize("w", [1, 7, 69])
@pytest.mark.parametrize("bits", [7, 9])
def test_argmin_in_slices_is_that_of_the_whole(monkeypatch, w, bits):
    monkeypatch.setattr(hashing, "PLACE_BITS", bits)
    # Low bits are zero and values repeat, so ties are decided by the place alone.
    h = np.random.default_rng(w).integers(0, 40, 3000).astype(np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]
    assert hashing.sliding_argmin(h, w).tolist() == want


def test_argmin_beyond_16_mib():
    n, w = (1 << 24) + 200, 69
    got = hashing.sliding_argmin(np.arange(n, dtype=np.uint64)[::-1] << np.uint64(25), w)
    assert np.array_equal(got, np.arange(w - 1, n))


def test_repeats_beyond_16_mib_are_cut(spark):
    r = random.Random(5)
    passage = " ".join("".join(r.choices("abcdef", k=5)) for _ in range(60))
    long = np.random.default_rng(1).integers(97, 123, (1 << 24) + 500, dtype=np.uint8).tobytes().decode() + " " + passage
    docs = spark.createDataFrame([(1, passage), (2, long)], "doc_id long, text string")
    got = {x["doc_id"]: tuple(x) for x in suffix.digest(suffix.suffix_dedup(docs)).collect()}
    kept = hashlib.sha256(long[: -len(passage)].encode()).hexdigest()
    assert got[2] == (2, len(long), len(passage), 1, kept)
    assert got[1][2] == 0
