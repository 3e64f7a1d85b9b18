import random

import numpy as np
import pytest

from packetloom.llm import near_dedup as near


def brute(docs, words, share):
    def grams(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: grams(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            met = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * met >= share * (len(sets[a]) + len(sets[b]) - met):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 5)))
    docs, n = {}, 0
    for size, copies, edits in ((300, 40, 5), (120, 25, 4), (60, 5, 2), (40, 3, 1), (200, 30, 12)):
        base = [word() for _ in range(size)]
        for c in range(copies):
            w = list(base)
            for _ in range(r.randrange(edits + 1) if c else 0):
                w[r.randrange(size)] = word()
            docs[n] = " ".join(w)
            n += 1
    chain = [word() for _ in range(100)]
    for c in range(12):  # each like the next, the ends not alike
        w = [f"c{c}x{i}" if i < 3 * c else x for i, x in enumerate(chain)]
        docs[n] = " ".join(w)
        n += 1
    for t in ("", None, " \n", "one", "One", "one two", "one two three", "ONE two  three", "one two three four", "é É", "É é"):
        docs[n] = t
        n += 1
    for _ in range(30):
        docs[n] = " ".join(word() for _ in range(r.randrange(1, 60)))
        n += 1
    ids = list(docs)
    r.shuffle(ids)
    return dict(zip(ids, docs.values(), strict=True))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("block", "unit"), [(400, 20_000), (7, 10**9), (7, 2), (7, 0)])
def test_near_dedup_equals_all_pairs(spark, seed, block, unit, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = corpus(seed)
    rows = [(i, t, 3, "x") for i, t in docs.items()] + [(5, docs[5], 9, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component string").repartition(6)
    got = near.near_dedup(df, unit=unit).collect()
    want = brute(docs, 4, 80)
    assert len(got) == len(rows)
    bad = [(r, want[r[0]]) for r in got if want[r[0]] != tuple(r)[1:]]
    assert not bad, bad[:5]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, near.near_dedup(odd).collect()), key=str) == sorted([(None, 2, None, True), (None, 2, None, True), (4, 2, None, False), (None, 0, None, True)], key=str)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 200), (300, 250)]
    got = dict(map(tuple, near.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 200, 200: 200, 250: 200}


def test_sketch_fills_and_estimates():
    with np.errstate(over="ignore"):
        r = np.random.default_rng(1)
        for n in (1, 2, 30, 1000):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[: n // 2], r.integers(0, 1 << 63, n - n // 2, dtype=np.uint64)])
            s = near.sketch(np.repeat([0, 1], n), np.concatenate([a, b]), 2, 1024)
            assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
            want = len(set(a) & set(b)) / len(set(a) | set(b))
            assert abs((s[0] == s[1]).mean() - want) < 0.1
