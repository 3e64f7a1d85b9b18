"""Runs of equal windows, the shared core of the two exact dedup operators.

A run is a stretch of consecutive windows that have the same anchor (see
hashing.anchors).  Two equal windows always have equal anchors, so comparing
the runs of one anchor finds every equal pair, with one row for some dozens of
windows instead of one for each.  Runs whose whole texts agree form a class.
A class is known by three keys: the hash of its anchor and both functions of the
whole run (see hashing.py), some 183 bits; the bytes themselves are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .hashing import SECOND, anchors, mix, word_bounds, word_hashes
from .shared import batch, blocks, bytes_of, ids_of, lean

RUNS = "anchor long, run long, check long, doc_id long, first long, shape int"
_RUNS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("shape", pa.int32())])
ORDER = ["anchor", "run", "check", "doc_id", "first"]


def find_runs(docs: DataFrame, length: int, k: int, words: bool) -> DataFrame:
    """Runs of all windows of ``length`` bytes (or words) of every document.

    ``shape`` is the number of windows.  Runs that agree within one Arrow batch
    are settled before the shuffle: the first goes on as itself, the others
    under keys of their own, so a passage that stands in a third of all
    documents adds one row for each batch to its key.  ``shape`` is the number
    of windows plus PLACE times the anchor's place in the first one, all times 4,
    plus that state.
    """

    def scan(batches):
        np.seterr(over="ignore")
        for b in batches:
            buf, ends = bytes_of(b.column(1))
            ids = ids_of(b.column(0))
            found = []
            for i, j, lo, hi in blocks(ends):
                part, e = buf[lo:hi], ends[i:j] - lo
                other = None
                if words:
                    s, t, text = word_bounds(part, e)
                    part, other, e = word_hashes(part, s, t), word_hashes(part, s, t, by=SECOND), np.searchsorted(text, np.arange(j - i), side="right")
                t, a, n, place, key, run, check = anchors(part, e, length, k, other)
                if len(t):
                    start = np.concatenate([[0], e[:-1]])
                    found.append((key, run, check, ids[i:j][t], a - start[t], n + PLACE * place))
            if found:
                yield batch(_RUNS, *combine(*(np.concatenate(c) for c in zip(*found, strict=True))))

    return docs.mapInArrow(lean(scan), RUNS)


PLAIN, HEAD, LATER = 0, 1, 2
PLACE = 256


def combine(key, run, check, doc, first, shape):
    """Settle runs that agree: the first is a HEAD, the others are LATER under a key of their own."""
    both = mix(key) ^ run ^ check
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    some = np.zeros(len(order), bool)
    some[1:] |= same
    some[:-1] |= same
    some = order[some]
    state = np.full(len(key), PLAIN, np.int32)
    if len(some):
        some = some[np.lexsort([first[some], doc[some], check[some], run[some], key[some]])]
        again = np.zeros(len(some), bool)
        again[1:] = (key[some[1:]] == key[some[:-1]]) & (run[some[1:]] == run[some[:-1]]) & (check[some[1:]] == check[some[:-1]])
        head = some[np.maximum.accumulate(np.where(again, 0, np.arange(len(some))))]
        again &= (doc[some] != doc[head]) | (first[some] != first[head])
        later, head = some[again], head[again]
        state[head], state[later] = HEAD, LATER
        key = key.copy()
        key[later] = mix(key[later] ^ mix(doc[later].view(np.uint64) * np.uint64(31) + first[later].astype(np.uint64)))
    return key.view(np.int64), run.view(np.int64), check.view(np.int64), doc, first, 4 * shape.astype(np.int32) + state


def state_of() -> Column:
    return F.col("shape").bitwiseAND(F.lit(3))


def compare_runs(runs: DataFrame, both: bool) -> DataFrame:
    """doc_id, first, shape (without the state), repeated, opened: runs that are settled or need a look.

    A ``repeated`` run is one of which each window starts earlier too (``both``:
    anywhere else too).  An ``opened`` one is the first run of a class whose
    anchor has other classes: its windows may be shared with those in part.
    Occurrences with the same doc_id and offset count as one.  Both windows use
    one exchange by anchor (none where the runs are dealt by it already) and one
    sort; Spark spills the rows of an anchor that are too many for memory.
    """
    ends = (Window.unboundedPreceding, Window.unboundedFollowing)
    group = Window.partitionBy("anchor").orderBy(*ORDER[1:]).rowsBetween(*ends)
    cls = Window.partitionBy(*ORDER[:3]).orderBy("doc_id", "first").rowsBetween(*ends)
    end = lambda f, names, w: {f"_{x}_{n}": g(n).over(w) for x, g in (("a", F.first_value), ("z", F.last_value)) for n in names if f or x == "a"}
    # Nothing is computed below the windows: a projection there would hide how a union of dealt runs is dealt.
    rows = runs.withColumns(end(True, ("run", "check"), group)).withColumns(end(both, ("doc_id", "first"), cls))
    state = state_of()
    several = (F.col("_a_run") != F.col("_z_run")) | (F.col("_a_check") != F.col("_z_check"))
    other = (F.col("doc_id") != F.col("_a_doc_id")) | (F.col("first") != F.col("_a_first"))
    if both:
        repeated = (F.col("_a_doc_id") != F.col("_z_doc_id")) | (F.col("_a_first") != F.col("_z_first")) | (state != PLAIN)
    else:
        repeated = other | (state == LATER)
    opened = several & ~other & (state != LATER)
    return rows.select("doc_id", "first", F.shiftright("shape", 2).alias("shape"), repeated.alias("repeated"), opened.alias("opened")).where("repeated or opened")


def windows_of(shape):
    return shape % PLACE


def ranges_of(hits: DataFrame, length: int) -> DataFrame:
    """The symbols that repeated runs cover."""
    return hits.where("repeated").select("doc_id", "first", (F.col("first") + windows_of(F.col("shape")) + (length - 1)).alias("last"))


def spans_by_document(ranges: DataFrame) -> DataFrame:
    """One row for each document with the distinct [first, last) ranges to remove, sorted and unmerged.

    There are at most as many as windows begin in the document; ``covered`` merges them.
    """
    return ranges.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def covered(n: int, spans) -> np.ndarray:
    """Which of n symbols the ranges cover; ranges are clipped to n."""
    if spans is None or not len(spans):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(spans[:, 0], n), 1)
    np.add.at(edge, np.minimum(spans[:, 1], n), -1)
    return np.cumsum(edge[:n]) > 0
