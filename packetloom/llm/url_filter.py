"""URL filter: host and path rules, then a character language-model ratio.

Rules decide where one fits.  The other URLs are judged by two Markov models of
characters, one of accepted and one of rejected URLs (those that the rules
decide, without the parts that the rules look at).  Each model mixes the orders 0 to 3: the weight of an order falls with the
number of different successors its history has (Witten-Bell), so histories of little
evidence lean on shorter ones.  The score is the difference of the two log
likelihoods per character.  A held-out part of the accepted URLs calibrates the
cut: at most ``false_rejects`` of them may lie below it, and the cut is never above 0.

Counts are summed in Spark over all URLs.  With 48 character classes a model has at
most 48**4 cells, which bounds what is collected and broadcast.

Cases: null and URLs without ``://`` have an empty host and path and are
allowed unless the models object; without URLs of both kinds all of the rest
are allowed; rows are independent, ids of any kind pass through.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import blocks, bytes_of, lean, ship

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FALSE_REJECTS = 0.01
HELD_OUT = 5

CLASSES, ORDER = 48, 4
_BEGIN, _OTHER = 0, CLASSES - 1
_CLASS = np.full(256, _OTHER, np.int64)
for _i, _c in enumerate(string.ascii_lowercase):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 1 + _i
_CLASS[[ord(c) for c in string.digits]] = 27
for _i, _c in enumerate("./-_?=&#:%+~@,;!$'()"):
    _CLASS[ord(_c)] = 28 + _i if 28 + _i < _OTHER else _OTHER


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase), "path": path})


def by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host and path of the longest that fits) and ruled (its verdict)."""
    rule = ruled = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    none = F.lit(None).cast("string")
    return pages.withColumns({"rule": none if rule is None else rule, "ruled": none if ruled is None else ruled})


def essence(url: str = "url") -> Column:
    """What the models read: the host without its top-level label, the path after its first segment, and the rest.

    Rules look at the parts left out; with them the models would only learn the rules again.
    """
    host = F.regexp_replace("host", r"\.?[^.]*$", "")
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(?:/[^/?#]*)?(.*)$", 1)
    return F.concat(host, F.lit(" "), rest)


def cells(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character, the cell of its three predecessors and itself; and its text."""
    size = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), size)
    inner = np.arange(len(buf)) - np.repeat(ends - size, size)
    symbol = _CLASS[buf]
    cell = symbol.copy()
    for j in range(1, ORDER):
        before = np.full(len(buf), _BEGIN, np.int64)
        if j < len(buf):
            before[j:] = symbol[:-j]
        before[inner < j] = _BEGIN
        cell += before * CLASSES**j
    return cell, text


def log_model(counts: np.ndarray) -> np.ndarray:
    """log p(symbol | three before) of all cells from their counts."""
    p = np.full((1, CLASSES), 1 / CLASSES)
    for n in range(1, ORDER + 1):
        c = counts.reshape(-1, CLASSES**n).sum(axis=0).reshape(-1, CLASSES).astype(np.float64)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p, (c.shape[0] // p.shape[0], 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p).ravel().astype(np.float32)


def url_filter(pages: DataFrame, rules=RULES, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    spark = pages.sparkSession
    ship(spark)
    # A held-out URL is one in HELD_OUT by the hash of its text, so copies stay together.
    known = by_rules(parts(pages.select("page_id", "url")), rules).withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0).withColumn("url", essence())
    counted = pa.schema([("ruled", pa.string()), ("cell", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = {"allow": np.zeros(CLASSES**ORDER, np.int32), "block": np.zeros(CLASSES**ORDER, np.int32)}
        for b in batches:
            for verdict, t in total.items():
                part = b.filter(pa.compute.equal(b.column(1), verdict))
                if part.num_rows:
                    buf, ends = bytes_of(part.column(0))
                    for i, j, lo, hi in blocks(ends, 1 << 20):
                        np.add.at(t, cells(buf[lo:hi], ends[i:j] - lo)[0], 1)
        for verdict, t in total.items():
            seen = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(seen), pa.string()), pa.array(seen), pa.array(t[seen].astype(np.int64))], schema=counted)

    rows = known.where("ruled is not null and not held").select("url", "ruled").mapInArrow(lean(count), "ruled string, cell long, n long").groupBy("ruled", "cell").agg(F.sum("n").alias("n")).toPandas()
    models = []
    for verdict in ("allow", "block"):
        c = np.zeros(CLASSES**ORDER)
        mine = rows[rows["ruled"] == verdict]
        c[mine["cell"].to_numpy(np.int64)] = mine["n"].to_numpy(np.float64)
        models.append(log_model(c) if len(mine) else None)
    if None in [None if m is None else 1 for m in models]:
        return known.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    ratio = spark.sparkContext.broadcast(models[0] - models[1])
    place = known.columns.index("url")

    def score(batches):
        for b in batches:
            buf, ends = bytes_of(b.column(place))
            out = np.zeros(b.num_rows)
            for i, j, lo, hi in blocks(ends, 1 << 20):
                if hi > lo:
                    cell, text = cells(buf[lo:hi], ends[i:j] - lo)
                    out[i:j] = np.bincount(text, weights=ratio.value[cell], minlength=j - i) / np.maximum(np.bincount(text, minlength=j - i), 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "score"])

    scored = known.mapInArrow(lean(score), known.withColumn("score", F.lit(0.0)).schema)
    # Scores in steps of 1/1000 and between -20 and 20: a bounded number of rows.
    step = F.greatest(F.least(F.floor(F.col("score") * 1000), F.lit(20_000)), F.lit(-20_000))
    held = scored.where("held and ruled = 'allow'").groupBy(step.alias("step")).count().toPandas().sort_values("step")
    cut = 0.0
    if len(held):
        below = held["count"].cumsum().to_numpy()
        ok = np.flatnonzero(below <= false_rejects * below[-1])
        cut = min(0.0, (int(held["step"].iloc[ok[-1]]) + 1) / 1000 if len(ok) else int(held["step"].iloc[0]) / 1000)
    method = F.when(F.col("score") < cut, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
