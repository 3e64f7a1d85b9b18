"""Short benchmark items in many long documents."""

import random

import pytest

from packetloom.llm import decontamination


def test_short_items_are_found_in_long_documents(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    items = {n: [word() for _ in range(n)] for n in (1, 4, 5, 6, 7, 8, 12, 20)}
    rows = []
    for d in range(160):
        body, n = [word() for _ in range(400)], (5, 6, 7, 8, 12, 20)[d % 6]
        x = r.randrange(400)
        rows.append((d, n, " ".join(body[:x] + items[n] + body[x:])))
    docs = spark.createDataFrame(rows, "doc_id long, n long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontamination.contained(docs.select("doc_id", "text"), bench)
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == [(d, n) for d, n, _ in rows]
    assert decontamination.without_contaminated(docs, bench).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_planted_item_is_found(spark, seed):
    """300 planted items of each length would be 12,000 documents; the lengths share 900 documents of 400 words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    items, docs = [], []
    for d in range(900):
        body = [word() for _ in range(400)]
        for n in r.sample(range(1, 41), 14):
            x = r.randrange(len(body))
            w = [word() for _ in range(n)]
            items.append((len(items), d, n, " ".join(w)))
            body[x:x] = w
        docs.append((d, body))
    rows = [(d, " ".join(b)) for d, b in docs]
    grams = {d: {tuple(b[i : i + 5]) for i in range(len(b) - 4)} for d, b in docs}
    want = set()
    for i, d, n, t in items:
        w = t.split()
        mine = {tuple(w[k : k + 5]) for k in range(max(1, n - 4))}
        if len(mine & grams[d]) * 100 >= 80 * len(mine):  # later items may have cut this one
            want.add((d, i))
    got = decontamination.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, _, t in items], "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want
