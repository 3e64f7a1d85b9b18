"""Each stage against brute force on its own input, and the whole against the stages."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from packetloom.llm import queries

from .test_exact_dedup import brute_words
from .test_near_dedup import brute as brute_near

DIR = "/root/testdata/sf0.001"


def split(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()


def shingles(t, n=5):
    w = split(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs.collect()]
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        rows = docs.collect()
        out.append(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == schema.names
        docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    return out


def test_classifier_keeps_clean_documents(spark, steps):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1]}
    clean = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert all(r in steps[0] for r in steps[1])


def test_near_dedup_stage(steps):
    want = brute_near({r["doc_id"]: r["text"] for r in steps[1]}, 5, 80)
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(i for i, x in want.items() if x[2])


def test_substring_stage(steps):
    want = brute_words({r["doc_id"]: (r["text"] or "").encode() for r in steps[2]}, 35)
    before = {r["doc_id"]: r["text"] for r in steps[2]}
    for r in steps[3]:
        _, removed, digest = want[r["doc_id"]]
        if removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == before[r["doc_id"]]
    assert len(steps[3]) == len(steps[2])


def test_decontamination_stage(spark, steps):
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in steps[3] if any(x and len(x & shingles(r["text"])) * 100 >= 80 * len(x) for x in items)}
    assert sorted(r["doc_id"] for r in steps[4]) == sorted({r["doc_id"] for r in steps[3]} - bad)


def test_bpe_stage(steps):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in steps[4]}
    assert len(steps[5]) == len(texts)
    for r in steps[5]:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_one_after_the_other(spark, steps):
    assert sorted(map(tuple, queries.pipeline(spark, DIR).collect())) == sorted(map(tuple, steps[5]))
    assert np.all([r["doc_id"] is not None for r in steps[5]])


def test_odd_documents_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "xx", "s", 5)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{DIR}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 3
    empty = spark.createDataFrame([], spark.read.parquet(f"{DIR}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DIR)
    assert empty.count() == 0


def test_rows_that_share_a_doc_id_keep_their_own_texts(spark):
    r = np.random.default_rng(5)
    text = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(n))
    a, b, c = text(60), text(60), text(80)
    rows = [(1, a), (2, a), (2, b), (3, c[:300] + " " + b), (3, c), (None, text(50))]
    docs = spark.createDataFrame([(*x, "en", 1, 2, 3, 4) for x in rows], "doc_id long, text string, lang string, _row int, _gone int, _id int, _text int")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, DIR)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or 0, x["text"]) for x in kept.collect()) == sorted((x[0] or 0, x[1]) for x in rows if x != (2, a))
    cut = corpus_pipeline.substring_stage(spark, kept, DIR)
    want = brute_words({i: x["text"].encode() for i, x in enumerate(kept.collect())}, 35)
    assert cut.count() == 5 and sum(len(x["text"].split()) for x in cut.collect()) == sum(n - gone for n, gone, _ in want.values())
    assert corpus_pipeline.decontamination_stage(spark, cut, DIR).count() == 5
