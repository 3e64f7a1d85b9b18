"""The classifier's worst stretch and its limits."""

import math
import random

import pytest

from packetloom.llm import quality_model

from .test_filters import brute_kneser_ney


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_worst_stretch_equals_brute_force(spark, most):
    r = random.Random(3)
    make = lambda: "".join(r.choices(["the ", "ab", "é", "c d", "\n", "xyz"], k=r.randrange(1, 60)))
    texts = [make() for _ in range(60)]
    queries = texts[:5] + [make() + "Q#" + make(), "ab", "", None, "日本 the"]
    model = quality_model.shards(quality_model.train(spark.createDataFrame([(t,) for t in texts], "text string")), most)
    assert (len(model) > 1) == (most == 300)
    asked = spark.createDataFrame(list(enumerate(queries)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["_worst"] for x in quality_model.score(asked, model).collect()}
    for i, t in enumerate((q or "").encode() for q in queries):
        # -log p of each byte, from the perplexities of the text's beginnings.
        total = [n * math.log(p) for n, p in enumerate(brute_kneser_ney([x.encode() for x in texts], [t[:n] for n in range(len(t) + 1)]))]
        steps = [round(min((b - a) * quality_model.GRAIN, 255)) for a, b in zip(total, total[1:])]
        n = min(5, len(t))
        want = max((sum(steps[k : k + n]) for k in range(len(t) - n + 1)), default=0) / quality_model.GRAIN / max(n, 1)
        assert math.log(got[i]) == pytest.approx(want, abs=0.1 + 1e-6), queries[i]


def test_few_foreign_words_in_a_long_document_reject_it(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(2000):
        weights = [r.random() ** 3 + 0.01 for _ in range(5)]  # documents differ in their mean
        word = lambda: "".join(r.choices(["th", "er", "an", "in", "on"], weights, k=r.randrange(1, 4)))  # noqa: B023, E731
        words, toxic = [word() for _ in range(300)], i % 10 == 0
        for _ in range(2 * toxic):
            words[r.randrange(300)] = r.choice(["moron", "scum", "clown", "idiot"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    out = quality_model.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ok = {x["doc_id"]: x["accepted"] for x in out.collect()}
    assert sum(not ok[i] for i in range(0, 2000, 10)) >= 0.95 * 200
    assert sum(ok[i] for i in range(2000) if i % 10) >= 0.98 * 1800


def test_an_outlier_does_not_set_the_limit_of_a_small_language(spark):
    r = random.Random(9)
    word = lambda parts: "".join(r.choices(parts, k=r.randrange(1, 4)))
    text = lambda parts, odd=0.0: " ".join(word(parts) + "$%" * (r.random() < odd) for _ in range(80))
    large, small = ["th", "er", "an", "in", "on"], ["sch", "ung", "eit", "ver", "ich"]
    rows = [(i, text(large), "en", 1) for i in range(1500)] + [(2000 + i, text(small), "de", 1) for i in range(150)]
    rows += [(3000 + i, text(small, 0.5), "de", 0) for i in range(40)]
    # A trusted document of junk, held out by its hash.
    junk = spark.createDataFrame([(" ".join("".join(r.choices("#*@^~0123456789", k=6)) for _ in range(60)),) for _ in range(40)], "text string")
    rows.append((4000, junk.where(f"pmod(xxhash64(text), {quality_model.HELD_OUT}) = 0").first()[0], "de", 1))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    out = quality_model.quality(docs, spark.createDataFrame([(x[0], x[3], 0) for x in rows], "doc_id long, quality int, toxic int"))
    ok = {x["doc_id"]: x["accepted"] for x in out.collect()}
    assert sum(not ok[3000 + i] for i in range(40)) >= 36
    assert sum(ok[2000 + i] for i in range(150)) >= 0.97 * 150
    assert sum(ok[i] for i in range(1500)) >= 0.98 * 1500


def test_clean_documents_of_all_languages_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = quality_model.quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), labels)
    clean = [x["accepted"] for x in out.join(labels.where("quality = 1 and toxic = 0"), "doc_id").collect()]
    assert sum(clean) >= 0.97 * len(clean)
