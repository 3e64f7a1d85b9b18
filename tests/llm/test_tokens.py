import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models

from packetloom.llm import bpe, token_count, token_output

ODD = ["", " ", "Hello, World's end!!  It'll 'S x1y2", "a\x1cb\x85c\xa0d e", "ΑΣ Σα ΣΣ İ ǅ é é ñ Å", "<|endoftext|>x <|startoftext|> <|endoftext|", "日本語 テスト 👍🏽 ﬁ ½ ²", "aaaaaaaaaaaaaaaaaaaaaaaaaaab" * 20, "\n\n  \t x\r\n", "\u0000 ﻿ ​", "'s's''t'd", "###$$$ %%%&&&", "x" * 300, "antidisestablishmentarianism" * 5, "▁a ▁▁ b"]


def texts(n=300):
    r = random.Random(5)
    parts = ["the", "tion", "re", "er", "#", "é", "ß", "12", "'ll", "\n", " ", " ", "  ", "Ω", "🙂", "ing", "A", "Z", "́"]
    return ODD + ["".join(r.choices(parts, k=r.randrange(60))) for _ in range(n)]


def test_backtracking_bpe_equals_the_library():
    path = P.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), bpe.Encoder(path)
    strings = bpe.OffsetTable([s.encode() + b" " for s in e.strings])
    for x in texts():
        ids = np.frombuffer(e.encode(x), np.int32)
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x
        assert strings.join(ids).decode() == t.decode(ids.tolist(), skip_special_tokens=False), x


def test_bpe_query_rows(spark):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(texts(20))] + [(None, "null id"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, x, "z", 1) for i, x in rows], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    want = [(i, ids := t.encode(x or "", add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for i, x in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.digest(bpe.decode(bpe.encode(docs.limit(0), path), path), path).count() == 0


@pytest.mark.parametrize("counts", [[], [0], [1], [3, 0, 4, 5], [1000, 1, 7]])
def test_variable_length_code_round_trip(counts):
    counts = np.array(counts, np.int64)
    n = int(counts.sum())
    r = np.random.default_rng(n)
    v = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, c, data, d = token_output.pack(v, counts)
    assert token_output.unpack(control, data, counts).tolist() == v.tolist()
    parts = zip(token_output._cut(control, c), token_output._cut(data, d), counts, np.split(v, np.cumsum(counts)[:-1]) if len(counts) else [])
    assert all(token_output.unpack(x, y, np.array([k])).tolist() == w.tolist() for x, y, k, w in parts)


def test_token_files(spark):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i * 7 % 500, x) for i, x in enumerate(texts(200))] + [(None, "null id"), (9999, None), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, start int").repartition(5)
    got = token_output.digest(token_output.token_output(docs, path, block=64)).collect()
    want = {}
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert token_output.token_output(docs.limit(0), path).count() == 0


def test_count_only_viterbi_equals_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    vocabulary = token_count.pieces(path)
    t = Tokenizer(models.Unigram([("\x00unknown", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    counter = token_count.Counter(vocabulary)
    want = {}
    for i, x in enumerate(texts()):
        ids = t.encode("▁" + x.replace(" ", "▁"), add_special_tokens=False).ids if x else []
        want[i] = (len(ids), sum(k == 0 for k in ids))
        assert counter.count(x) == want[i], x
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts())] + [(-1, None)], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in token_count.token_counts(docs, path).collect()}
    assert got == want | {-1: (0, 0)}


def test_cut_into_pre_tokens_equals_the_library():
    path = P.path("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), token_output.tokenizer(path)
    r = random.Random(9)
    parts = ["it's", "'ll", "'", "''", " '", "'r", "'re", "'ves", "'S", "l'", "x", "Ab", "é", "ñü", "ß", "×", "÷", "¡", "²", "7", "42", ".", "!?", "_", " ", "  ", "\n", "\n ", " \n", "\t", "\x0b", "\r\n", "\x01", "\x7f", "ɏ", "ɐ", "日", "’"]
    texts_ = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(4000)] + texts(50) + ["", " ", "'", "'s", "a'", "'l"]
    raw = [x.encode() for x in texts_]
    with np.errstate(over="ignore"):
        got = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]), "<i4")
    for x, g in zip(texts_, got, strict=True):
        assert np.frombuffer(g, "<i4").tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("n", [3, 4, 10, 11])
def test_pre_tokens_are_known_by_their_bytes(n):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    texts_ = [a, b, a + " " + b, "x" * 15, "x" * 16, "x" * 15 + " x", "y" * 8, "y" * 7 + "z"] * 2
    raw = [x.encode() for x in texts_]
    own = token_output.Tokenizer(path)
    with np.errstate(over="ignore"):
        for _ in range(2):
            got = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]), "<i4")
            for x, g in zip(texts_, got, strict=True):
                assert np.frombuffer(g, "<i4").tolist() == t.encode(x, add_special_tokens=False).ids, x
        own._keys[1] ^= np.uint64(1)  # as if all mixtures were those of other pre-tokens
        got = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]), "<i4")
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts_]
