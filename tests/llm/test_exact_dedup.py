import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import substring_dedup as words, suffix_dedup as suffix


def brute_bytes(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(t[p : p + length])
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def brute_words(docs, window):
    split = {i: t.split() for i, t in docs.items()}
    seen = Counter(tuple(w[p : p + window]) for w in split.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcé", k=r.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    line = " ".join(word() for _ in range(9)) + "\n"
    docs = {}
    for i in range(60):
        body = [" ".join(word() for _ in range(r.randrange(80))) for _ in range(3)]
        if i % 3 == 0:
            body.insert(r.randrange(3), passage[r.randrange(40) : r.randrange(200, 400)])
        if i % 4 == 0:
            body.insert(1, line * r.randrange(1, 9))
        docs[i * 3] = " ".join(body)
    docs[500] = docs[501] = docs[9]
    docs[502] = "a" * 700
    docs[503] = "ab \n" * 300
    docs[504], docs[505], docs[506] = "", "short", " \t\n"
    docs[507] = "x" * 99 + "\0" + "y" * 150 + "\0" * 130
    docs[None] = docs[12]
    return docs


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    docs = corpus(request.param)
    rows = [(i, t, "clash", 7) for i, t in docs.items()] + [(9, docs[9], "again", 7), (600, None, None, None)]
    docs = {i: (t or "").encode() for i, t in (docs | {600: None}).items()}
    return docs, spark.createDataFrame(rows, "doc_id long, text string, first string, run int").repartition(7)


def check(got, want):
    assert all(want[r[0]] == tuple(r)[1:] for r in got), [(r, want[r[0]]) for r in got if want[r[0]] != tuple(r)[1:]][:3]
    assert sorted(Counter(r[0] for r in got).items(), key=str) == sorted(Counter([*want, 9]).items(), key=str)


@pytest.mark.parametrize("hot", [10**9, 10_000, 2])
def test_suffix_dedup(case, hot):
    check(suffix.digest(suffix.suffix_dedup(case[1], block=5000, hot=hot)).collect(), brute_bytes(case[0], 100))


@pytest.mark.parametrize(("batches", "fanout"), [(words.BATCHES, words.FANOUT), (1, 2), (5, 2), (4, 100)])
def test_substring_dedup(case, batches, fanout):
    check(words.digest(words.substring_dedup(case[1], n_batches=batches, fanout=fanout)).collect(), brute_words(case[0], 35))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.suffix_dedup(empty).count() == 0
    assert words.substring_dedup(empty).count() == 0


def test_index_is_opened_again(spark, tmp_path):
    docs = {i: t for i, t in corpus(3).items() if i is not None}
    part = lambda k: spark.createDataFrame([(i, t) for i, t in docs.items() if i % 4 == k], "doc_id long, text string")
    folder, found = f"file://{tmp_path}/index", []
    for k in range(4):
        index = words.FingerprintIndex(spark, folder, fanout=2)
        assert [x for x, _ in index.runs] == [[], [0], [1], [1, 0]][k]
        found += [h for h in index.add(part(k)).collect() if h["repeated"]]
        index.close()
    assert [x for x, _ in index.runs] == [2]  # more batches than the fan-out: runs were merged, the old ones are gone
    assert sorted(n for n in index._names() if n.startswith("level")) == [index.runs[0][1]]
    whole = words.FingerprintIndex(spark)
    want = [h for h in whole.add(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect() if h["repeated"]]
    assert {(h["doc_id"], h["first"]) for h in found} == {(h["doc_id"], h["first"]) for h in want}
    with pytest.raises(ValueError):
        words.FingerprintIndex(spark, folder, window=9)


def test_history_is_merged_without_an_exchange(spark, tmp_path):
    index = words.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=10)
    for k in range(3):
        index.add(spark.createDataFrame([(i, t) for i, t in corpus(3).items() if i is not None and i % 3 == k], "doc_id long, text string"))
    names = [n for _, n in index.runs]
    new, index.runs = index._read(names[2]), index.runs[:2]
    for df in (index.compared(new), index.merged(names)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") >= 3, plan


def morse(n, a, b):
    """Strings that a polynomial modulo 2**64 cannot tell apart from n = 10 on, whatever its base."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 11])
def test_strings_that_collide_modulo_powers_of_two(spark, n):
    r = random.Random(n)
    x, y = morse(n, "a", "b")
    tail = [" ".join("".join(r.choices("cdefgh", k=6)) for _ in range(60)) for _ in range(2)]
    one, two = " ".join([x] + ["same"] * 40), " ".join([y] + ["same"] * 40)
    long_ = [" ".join(w) for w in morse(n, ["v"], ["w"])]
    texts = {1: one, 2: two, 3: long_[0], 4: long_[1], 5: x + " " + tail[0], 6: y + " " + tail[0], 7: tail[1]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    raw = {i: t.encode() for i, t in texts.items()}
    assert {r[0]: tuple(r)[1:] for r in words.digest(words.substring_dedup(df)).collect()} == brute_words(raw, 35)
    assert {r[0]: tuple(r)[1:] for r in suffix.digest(suffix.suffix_dedup(df)).collect()} == brute_bytes(raw, 100)


@pytest.mark.parametrize("v", [7, 32])
def test_difference_cover(v):
    d = suffix.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("seed", range(6))
def test_bucket_sort_is_the_suffix_order(seed):
    r = random.Random(seed)
    length = 100
    strings = ["".join(r.choices("ab" if seed % 2 else "a", k=r.randint(100, 260))).encode() for _ in range(12)]
    strings += [strings[0] + b"b" * 5, strings[1]]
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(s + bytes(suffix.V) for s in strings), np.uint8)
    begin = np.cumsum(sizes + suffix.V) - sizes - suffix.V
    left = np.zeros(len(text), np.int64)
    for b, n in zip(begin, sizes):
        left[b : b + n] = np.arange(n, 0, -1)
    starts = np.flatnonzero(left >= length)
    got = set(suffix.repeated_starts(text, left, starts, length, int(sizes.max())).tolist())
    seen, want = set(), set()
    raw = text.tobytes()
    for p in starts.tolist():
        if raw[p : p + length] in seen:
            want.add(p)
        seen.add(raw[p : p + length])
    assert got == want
