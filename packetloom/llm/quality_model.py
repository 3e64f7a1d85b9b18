"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text.

Symbols are UTF-8 bytes, five to an n-gram, which serves all languages with
one vocabulary.  Training: n-gram counts of all trusted documents, summed in
Spark; the lower orders count distinct left neighbours; discounts come from the
numbers of n-grams seen once to four times; probabilities and back-off weights
come from joins of the count tables, which are sharded by key.  Scoring: the
finished table is cut into shards by the byte before the last, which all
look-ups of one occurrence share; every shard is small enough to be sent to the
executors, where each block of documents joins its distinct n-grams with it.
The text itself is not shuffled.

Decision: a document's perplexity must not exceed a quantile of trusted documents
of its language and size class that had no part in training (garbled), and that
of its worst stretch, the five bytes in a row of least probability, must not
either: a few words that trusted text does not have vanish in the mean of a long
document.  Nor may its perplexity fall below a quantile of all trusted documents
(repetitive), those of training included, as what the model has seen and copies
of it are no surprise to it.
One rule holds at all sizes: a language's quantiles are those of its own
documents and of PRIOR further ones that are distributed as all languages
together, each around its own median; a size class has its own and PRIOR ones of
its language.  So many documents speak for themselves, few lean on the rest.
A language without any takes the quantiles of all documents as they are.

Cases: an empty or null text has perplexity 1 and is kept, as there is nothing
to judge; a null lang is a language of its own; null and repeated doc_ids are
fine; without trusted documents everything is kept.  Documents come back with
all their columns; ``perplexity`` and ``accepted`` are added, replacing columns
of those names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import bits_of, blocks, bloom, bytes_of, in_bloom, lean, ship, table

ORDER, SYMBOLS, START = 5, 256, 2
LOW, HIGH = 0.001, 0.995
#: One trusted document in so many (by the hash of its text) is held out of training for the quantiles.
HELD_OUT = 4
#: The wider distribution counts as so many documents of a stratum: of so many the upper quantile leaves out one.
PRIOR = 200
#: Steps per nat of a byte's -log p in the search for the worst stretch (one byte each, so at most 25.5).
GRAIN = 10.0
#: Bytes of text that are worked on at a time.
BYTES = 1 << 19
#: Rows of a model shard (12 bytes each).
SHARD = 1_500_000
_U = np.uint64
#: Tags above the five bytes of a key: n for an n-gram, 8 + n for the weight of an n-byte history.
TAG = 40


def ngrams(buf: np.ndarray, ends: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, packed, and the byte's text."""
    size = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), size)
    inner = np.arange(len(buf)) - np.repeat(ends - size, size)
    key = buf.astype(_U)
    for j in range(1, order):
        before = np.full(len(buf), START, _U)
        before[j:] = buf[:-j] if j < len(buf) else []
        before[inner < j] = START
        key |= before << _U(8 * j)
    return key, text


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is in ids (distinct).  A bit table drops most others before the shuffle."""
    spark = docs.sparkSession
    bits, words = bloom(ids)
    shared = spark.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(in_bloom(b, bits, shared.value))).select(range(b.num_columns - 2))

    return docs.withColumns(bits_of(key)).mapInArrow(lean(run), docs.schema).join(ids.toDF(key).hint("merge"), key, "left_semi")


def count_ngrams(docs: DataFrame) -> DataFrame:
    """key, c of all n-grams of the texts, each summed per block before the shuffle."""

    def run(batches):
        keys: list = []
        counts: list = []
        held = 0

        def total():
            k = np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[first], np.add.reduceat(np.concatenate(counts)[order], first)

        for b in batches:
            buf, ends = bytes_of(b.column(0))
            for i, j, lo, hi in blocks(ends, BYTES):
                if hi > lo:
                    k, c = np.unique(ngrams(buf[lo:hi], ends[i:j] - lo)[0], return_counts=True)
                    keys.append(k)
                    counts.append(c)
                    held += len(k)
                    if held > 2_000_000:
                        k, c = total()
                        keys, counts, held = [k], [c], len(k)
                        if held > 1_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "c"])
                            keys, counts, held = [], [], 0
        if keys:
            k, c = total()
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "c"])

    return docs.select("text").mapInArrow(lean(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


#: Discounts stay this far from 0 and from the count, so every probability is positive.
LEAST = 0.05


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n = dict(counts.where("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, LEAST), k - LEAST) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def train(docs: DataFrame) -> DataFrame:
    """key, value: log probabilities of seen n-grams and log back-off weights, all orders."""
    counts = {ORDER: table(count_ngrams(docs), "ngrams")}
    for n in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (8 * n)) - 1)
        counts[n] = table(counts[n + 1].select(F.col("key").bitwiseAND(mask).alias("key")).groupBy("key").agg(F.count("*").alias("c")), "ngrams")
    out, lower = [], None
    for n in range(1, ORDER + 1):
        d = discounts(counts[n])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[n].withColumn("history", F.shiftrightunsigned("key", 8))
        weights = rows.groupBy("history").agg(F.sum("c").alias("all"), F.sum(off).alias("freed")).withColumn("weight", F.col("freed") / F.col("all"))
        p = rows.join(weights, "history")
        if lower is None:
            p = p.withColumn("below", F.lit(1 / SYMBOLS))
        else:
            p = p.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
        lower = table(p.select("key", ((F.col("c") - off) / F.col("all") + F.col("weight") * F.col("below")).alias("p")), "probabilities")
        out.append(lower.select(F.col("key").bitwiseOR(F.lit(n << TAG)).alias("key"), F.log("p").alias("value")))
        out.append(weights.select(F.col("history").bitwiseOR(F.lit((8 + n - 1) << TAG)).alias("key"), F.log("weight").alias("value")))
    model = out[0]
    for x in out[1:]:
        model = model.union(x)
    return table(model, "model")


def shards(model: DataFrame, most: int = SHARD) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Broadcast (bytes before the last that it serves, sorted keys, values) for each shard.

    Keys of single bytes and of the empty history belong to every shard.
    """
    spark, key = model.sparkSession, F.col("key")
    tag = F.shiftrightunsigned(key, TAG)
    byte = F.when((tag == 1) | (tag == 8), -1).when(tag >= 8, key.bitwiseAND(F.lit(255))).otherwise(F.shiftrightunsigned(key, 8).bitwiseAND(F.lit(255)))
    rows = model.withColumn("byte", byte)
    sizes = dict(rows.groupBy("byte").count().collect())  # at most 257 rows
    groups: list[list[int]] = [[]]
    held = sizes.pop(-1, 0)
    size = held
    for b, n in sorted(sizes.items()):
        if groups[-1] and size + n > most:
            groups.append([])
            size = held
        groups[-1].append(b)
        size += n
    out = []
    for g in groups:
        t = rows.where(F.col("byte").isin([-1, *g])).select("key", F.col("value").cast("float").alias("value")).toArrow()
        serves = np.zeros(256, bool)
        serves[g] = True
        key_, value = t.column(0).to_numpy(), t.column(1).to_numpy()
        del t
        order = np.argsort(key_)
        out.append((serves, key_[order], value[order]))
    seen = np.zeros(256, bool)
    for s, _, _ in out:
        seen |= s
    out[0][0][~seen] = True
    return [spark.sparkContext.broadcast(x) for x in out]


def log_probabilities(keys: np.ndarray, shard) -> np.ndarray:
    """log p(last byte | four bytes before) of packed n-grams."""
    _, table_, values = shard
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))

    def find(k):
        at = np.searchsorted(table_, k)
        at[at == len(table_)] = 0
        return at, table_[at] == k

    for n in range(ORDER, 0, -1):
        if not len(todo) or not len(table_):
            break
        k = keys[todo] & ((1 << (8 * n)) - 1)
        at, hit = find(k | (n << TAG))
        out[todo[hit]] += values[at[hit]]
        todo, k = todo[~hit], k[~hit]
        at, hit = find((k >> 8) | ((8 + n - 1) << TAG))
        out[todo[hit]] += values[at[hit]]
    out[todo] -= math.log(SYMBOLS)
    return out


def worst_stretches(steps: np.ndarray, ends: np.ndarray, length: int = ORDER) -> np.ndarray:
    """The greatest sum of ``length`` values in a row of each text; a shorter text is one stretch."""
    size = np.diff(np.concatenate([[0], ends]))
    total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    at = np.arange(1, len(steps) + 1)
    sums = total[at] - total[np.maximum(at - length, np.repeat(ends - size, size))]
    out = np.zeros(len(ends), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.maximum.reduceat(sums, (ends - size)[some])
    return out


def score(docs: DataFrame, model: list) -> DataFrame:
    """docs with ``perplexity`` and ``_worst`` (that of the worst stretch); every other column is passed through.

    ``model``: broadcast shards.  Between them a byte of ``_steps`` for each byte
    of text goes along, as a stretch has bytes of several shards.
    """
    docs = docs.drop("perplexity", "_worst").withColumns({"_ll": F.lit(0.0), "_worst": F.lit(0).cast("long"), "_steps": F.lit(b"")})
    place = docs.columns.index("text")
    for number, shared in enumerate(model):

        def run(batches, shared=shared, first=number == 0, last=number == len(model) - 1):
            serves = shared.value[0]
            for b in batches:
                buf, ends = bytes_of(b.column(place))
                ll = b.column(b.num_columns - 3).to_numpy().copy()
                steps = np.zeros(len(buf), np.uint8) if first else bytes_of(b.column(b.num_columns - 1))[0].copy()
                for i, j, lo, hi in blocks(ends, BYTES):
                    if hi == lo:
                        continue
                    keys, text = ngrams(buf[lo:hi], ends[i:j] - lo)
                    mine = slice(None)
                    if not serves.all():
                        mine = serves[(keys >> _U(8)).astype(np.uint8)]
                        keys, text = keys[mine], text[mine]
                    distinct, which = np.unique(keys.view(np.int64), return_inverse=True)
                    logs = log_probabilities(distinct, shared.value)
                    ll[i:j] += np.bincount(text, weights=logs[which], minlength=j - i)
                    steps[lo:hi][mine] = np.clip(np.rint(-logs * GRAIN), 0, 255).astype(np.uint8)[which]
                if last:
                    worst, kept = worst_stretches(steps, ends), pa.array([b""] * b.num_rows, pa.binary())
                else:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    worst, kept = np.zeros(b.num_rows, np.int64), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(steps)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(ll), pa.array(worst), kept], schema=b.schema)

        docs = docs.mapInArrow(lean(run), docs.schema)
    size = F.octet_length("text")
    stretch = F.least(size, F.lit(ORDER))
    perplexity = {"perplexity": F.when(size > 0, F.exp(-F.col("_ll") / size)).otherwise(1.0), "_worst": F.when(size > 0, F.exp(F.col("_worst") / GRAIN / stretch)).otherwise(1.0)}
    return docs.withColumns(perplexity).drop("_ll", "_steps")


STEPS = 2000.0


def weighted_quantile(bins: np.ndarray, weights: np.ndarray, share: float) -> int:
    """The least bin that reaches the share of the weight."""
    order = np.argsort(bins, kind="stable")
    run = np.cumsum(weights[order])
    return int(bins[order][min(np.searchsorted(run, share * run[-1] * (1 - 1e-12)), len(bins) - 1)])


LIMITS = "_lang string, _size int, bin long"


def limits(scored: DataFrame, of: str, share: float, prior: float = PRIOR) -> tuple[DataFrame, int | None]:
    """Quantile of the log of column ``of`` (in 1/2000) for each language (_size -1) and size class; that of all documents."""
    # At most one row for each stratum and step.
    bins = table(scored.withColumn("bin", F.round(F.log(of) * STEPS).cast("long")).groupBy("_lang", "_size", "bin").count(), "bins")
    middle = bins.groupBy("_lang").agg(F.expr("cast(percentile(bin, 0.5, count) as long)").alias("middle"))
    bins = table(bins.join(middle, "_lang"), "bins")
    # One row for each step.
    whole = bins.groupBy("bin").agg(F.sum("count").alias("count")).orderBy("bin").toPandas()
    if not len(whole):
        return scored.sparkSession.createDataFrame([], LIMITS), None
    around = bins.groupBy((F.col("bin") - F.col("middle")).alias("bin")).agg(F.sum("count").alias("count")).orderBy("bin").toPandas()
    shape, part = around["bin"].to_numpy(), around["count"].to_numpy(np.float64)
    part *= prior / part.sum()

    def of_language(rows):
        import pandas as pd

        b, n = rows["bin"].to_numpy(), rows["count"].to_numpy(np.float64)
        all_, weight = np.concatenate([b, shape + rows["middle"].iloc[0]]), np.concatenate([n, part])
        out = [(-1, weighted_quantile(all_, weight, share))]
        for size in sorted(set(rows["_size"])):
            mine = (rows["_size"] == size).to_numpy()
            out.append((size, weighted_quantile(np.concatenate([b[mine], all_]), np.concatenate([n[mine], weight * (prior / weight.sum())]), share)))
        return pd.DataFrame([(rows["_lang"].iloc[0], *x) for x in out], columns=["_lang", "_size", "bin"])

    every = weighted_quantile(whole["bin"].to_numpy(), whole["count"].to_numpy(np.float64), share)
    return table(bins.groupBy("_lang").applyInPandas(of_language, LIMITS), "limits"), every


def quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, prior: float = PRIOR) -> DataFrame:
    """docs with ``perplexity`` and ``accepted``; columns of these names are replaced, all others kept as they are."""
    ship(docs.sparkSession)
    docs = docs.drop("perplexity", "accepted")
    names = docs.columns
    docs = docs.toDF(*(n if n in ("doc_id", "text", "lang") else f"c{i}" for i, n in enumerate(names)))  # no name of ours can clash
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    trusted = table(only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), ids), "trusted")
    if trusted.isEmpty():
        return docs.withColumns({"perplexity": F.lit(1.0), "accepted": F.lit(True)}).toDF(*names, "perplexity", "accepted")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    model = shards(train(trusted.where(~held)))
    strata = lambda df: df.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_size": F.least(F.floor(F.log2(F.greatest(F.octet_length("text"), F.lit(1)))), F.lit(14)).cast("int")})
    known = table(strata(score(trusted.withColumn("_held", held), model).where("octet_length(text) > 0")).select("_lang", "_size", "_held", "perplexity", "_worst"), "known")
    out = strata(score(docs, model))
    ok = F.lit(True)
    for k, (of, sample, share) in enumerate((("perplexity", known, low), ("perplexity", known.where("_held"), high), ("_worst", known.where("_held"), high))):
        t, every = limits(sample, of, share, prior)
        # One row for each language (and size class): a few dozen.
        out = out.join(t.where("_size >= 0").select("_lang", "_size", F.col("bin").alias(f"_fine{k}")), ["_lang", "_size"], "left")
        out = out.join(t.where("_size < 0").select("_lang", F.col("bin").alias(f"_coarse{k}")), "_lang", "left")
        limit = F.coalesce(f"_fine{k}", f"_coarse{k}", F.lit(every).cast("long"))
        bin_ = F.round(F.log(of) * STEPS).cast("long")
        ok = ok & F.coalesce(bin_ >= limit if k == 0 else bin_ <= limit, F.lit(True))
    ok = (F.octet_length("text") <= 0) | F.col("text").isNull() | ok
    return out.withColumn("accepted", ok).select(*docs.columns, "perplexity", "accepted").toDF(*names, "perplexity", "accepted")
