"""Suffix-array dedup by difference-cover blockwise construction.

The suffixes of all documents are dealt into buckets and one bucket at a time
is sorted.  A bucket holds suffixes that share the anchor of their first 100
bytes and what stands around it, so strings of 100 equal bytes always meet.  Whole runs of suffixes
that agree are settled by comparing keys; the rest is sorted as text: by the
first V bytes, then ties by the ranks of a difference-cover sample.  For any
two positions i, j some shift d < V puts both i+d and j+d in the sample, so a
tie of any length costs one comparison of precomputed ranks, and the memory in
use is that of one block of buckets.

Order and cases: documents are ordered by doc_id, positions by offset.  A null
text counts as empty, a null doc_id as the least id.  Rows that share a
doc_id count as one document: its positions are no repeats of themselves, and
each row gets the document's result.  A text under the length keeps all bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .hashing import FIRST, equal_slices
from .runs import PLACE, compare_runs, covered, find_runs, ranges_of, spans_by_document, windows_of
from .shared import NULL_ID, batch, documents, lean, table

LENGTH, GRAM = 100, 32
#: Bytes of bucket text that are sorted at a time.
BLOCK = 1 << 21


def difference_cover(v: int) -> np.ndarray:
    """Residues modulo v of which every residue is a difference (greedy)."""
    cover, have = [0], {0}
    while len(have) < v:
        best = max(range(v), key=lambda x: (len({d % v for c in cover for d in (x - c, c - x)} - have), -x))
        have |= {d % v for c in cover for d in (best - c, c - best)}
        cover.append(best)
    return np.array(sorted(cover))


V = 32
COVER = difference_cover(V)
_IN = np.zeros(V, bool)
_IN[COVER] = True
#: SHIFT[a, b]: least d with a+d and b+d both in the cover modulo V.
SHIFT = np.array([[next(d for d in range(V) if _IN[(a + d) % V] and _IN[(b + d) % V]) for b in range(V)] for a in range(V)])


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def sample_ranks(words: np.ndarray, left: np.ndarray, deepest: int) -> np.ndarray:
    """Ranks of the sample suffixes, each up to its string's end; -1 elsewhere.

    The first V bytes give the first rank; position i+V is in the sample when i
    is, so ranks of twice the depth come from pairs of ranks.
    """
    n = len(left)
    at = np.flatnonzero(_IN[np.arange(n) % V] & (left > 0))
    keys = [np.minimum(left[at], V), *(words[at + o] for o in range(V - 8, -1, -8))]
    order = np.lexsort(keys)
    new = np.zeros(len(at), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    full = np.full(n + deepest + 2 * V, -1, np.int64)
    full[at] = _dense(order, new)
    depth = V
    while depth < deepest:
        beyond = np.where(left[at] > depth, full[at + depth], -1)
        key = (full[at].astype(np.uint64) << np.uint64(32)) | (beyond + 1).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(len(at), bool)
        new[1:] = s[1:] != s[:-1]
        full[at] = _dense(order, new)
        depth *= 2
    return full


def sort_ties(suffix: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray) -> None:
    """Sort each tied stretch of ``suffix`` in place with cover ranks.

    Batcher's merge exchange runs on all stretches side by side; a comparison
    looks up the two positions' common shift and compares two ranks.
    """
    step = 1
    while len(size) and step < size.max():
        live = size > step
        begin, size = begin[live], size[live]
        total = int(size.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        limit, base = np.repeat(size, size), np.repeat(begin, size)
        k = step
        while k:
            skip = k % step
            pick = (inner >= skip) & ((inner - skip) % (2 * k) < k) & (inner // (2 * step) == (inner + k) // (2 * step)) & (inner + k < limit)
            x = base[pick] + inner[pick]
            y = x + k
            i, j = suffix[x], suffix[y]
            d = SHIFT[i % V, j % V]
            a, b = rank[i + d], rank[j + d]
            swap = (a > b) | ((a == b) & (i > j))
            suffix[x[swap]], suffix[y[swap]] = j[swap], i[swap]
            k //= 2
        step *= 2


def repeated_starts(text: np.ndarray, left: np.ndarray, starts: np.ndarray, length: int, deepest: int) -> np.ndarray:
    """Those of the suffixes ``starts`` whose first ``length`` bytes start earlier in ``starts`` too.

    ``text`` holds strings with V zero bytes after each; ``left`` is what
    remains of the string at each position (0 in the gaps).
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 2 * V, np.uint8)])
    words = np.zeros(n + length + V, np.uint64)
    for o in range(8):
        words = (words << np.uint64(8)) | padded[o : o + len(words)]
    rank = sample_ranks(words, left, deepest)
    heads = [words[starts + o] for o in range(V - 8, -1, -8)]
    order = np.lexsort([starts, *heads])
    tie = np.ones(len(order), bool)
    tie[:1] = False
    for h in heads:
        s = h[order]
        tie[1:] &= s[1:] == s[:-1]
    suffix = starts[order]
    begin = np.flatnonzero(~tie)
    size = np.diff(np.append(begin, len(suffix)))
    many = size > 1
    sort_ties(suffix, begin[many], size[many], rank)
    same = tie.copy()  # longest common prefix with the one before is at least length
    x = np.flatnonzero(same)
    for o in [*range(V, length - 7, 8), length - 8]:
        x = x[words[suffix[x] + o] == words[suffix[x - 1] + o]]
    same[:] = False
    same[x] = True
    group = np.flatnonzero(~same)
    if not len(group):
        return suffix
    least = np.minimum.reduceat(suffix, group)
    least = np.repeat(least, np.diff(np.append(group, len(suffix))))
    return suffix[suffix != least]


_BUCKET = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])
BUCKET = "bucket long, doc_id long, first long, bytes binary"
_RANGE = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RANGE = "doc_id long, first long, last long"
#: A run's suffixes are dealt into this many buckets by the anchor's place in them.
PARTS = 3
#: Buckets of more strings than this are dealt again by whole windows, and those sorted as text.
HOT = 10_000


def _cut(length: int, gram: int):
    """The asked runs as strings.

    Suffixes with the anchor at nearly the same place share more than the
    anchor; the key of all they share is their bucket, so a common short line
    does not gather all its neighbourhoods in one.
    """
    step = -(-(length - gram + 1) // PARTS)
    shared = length - step + 1

    def cut(batches):
        np.seterr(over="ignore")
        for b in batches:
            out = [[], [], [], []]
            for doc, text, asked in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                buf = np.frombuffer(text or b"", np.uint8)
                first, shape = (np.array([r[c] for r in asked], np.int64) for c in ("first", "shape"))
                n, anchor = windows_of(shape), first + shape // PLACE
                fits = first + n - 1 + length <= len(buf)
                first, n, anchor = first[fits], n[fits], anchor[fits]
                prefix = FIRST.prefix(buf)
                for part in range(PARTS):
                    last = np.minimum(first + n - 1, anchor - part * step)
                    begin = np.maximum(first, anchor - part * step - step + 1)
                    x = np.flatnonzero(begin <= last)
                    at = anchor[x] - part * step
                    key = FIRST.slices(prefix, at, at + shared) + np.uint64(part)
                    out[0].append(key.view(np.int64))
                    out[1].append(np.full(len(x), doc))
                    out[2].append(begin[x])
                    out[3].extend(text[i : j + length] for i, j in zip(begin[x].tolist(), last[x].tolist(), strict=True))
            if out[0]:
                yield batch(_BUCKET, *(np.concatenate(c) for c in out[:3]), out[3])

    return cut


_WINDOW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])


def _finest(length: int):
    """Each window of the strings, with its bytes; one that stands earlier in the batch has none.

    Those are compared byte by byte here, so a batch sends each text once.
    """

    def cut(batches):
        np.seterr(over="ignore")
        for b in batches:
            pieces = b.column(3).to_pylist()
            if not pieces:
                continue
            sizes = np.array([len(p) for p in pieces])
            buf = np.frombuffer(b"".join(pieces), np.uint8)
            n = sizes - length + 1
            of = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(sizes) - sizes)[of] + inner
            doc, first = b.column(1).to_numpy()[of], b.column(2).to_numpy()[of] + inner
            key = FIRST.slices(FIRST.prefix(buf), at, at + length)
            order = np.lexsort([first, doc, key])
            again = np.zeros(len(order), bool)
            again[1:] = key[order[1:]] == key[order[:-1]]
            head = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
            again &= (doc[order] != doc[head]) | (first[order] != first[head])
            again &= equal_slices(buf, at[order], at[head], np.full(len(order), length))
            known = np.zeros(len(order), bool)
            known[order] = again
            raw = buf.tobytes()
            yield batch(_WINDOW, key.view(np.int64), doc, first, [None if k else raw[i : i + length] for i, k in zip(at.tolist(), known.tolist(), strict=True)])

    return cut


def settle_windows(strings: DataFrame, length: int) -> DataFrame:
    """Ranges of the windows of ``strings`` that start earlier too, sorted as text by Spark.

    The strings of a bucket of any size are dealt by the windows' own bytes.
    """
    rows = table(strings.mapInArrow(lean(_finest(length)), "key long, doc_id long, first long, bytes binary"), "windows")
    w = Window.partitionBy("key", "bytes").orderBy("doc_id", "first")
    head = rows.where("bytes is not null").withColumns({"_doc": F.first_value("doc_id").over(w), "_at": F.first_value("first").over(w)})
    found = head.where("doc_id <> _doc or first <> _at").select("doc_id", "first").union(rows.where("bytes is null").select("doc_id", "first"))
    return found.select("doc_id", "first", (F.col("first") + length).alias("last"))


def _settle(length: int, block: int):
    """Sort buckets, one block at a time; a bucket is never split between blocks."""

    def sort(bucket, doc, first, pieces):
        many = np.zeros(len(bucket), bool)
        many[1:] = bucket[1:] == bucket[:-1]
        many[:-1] |= many[1:].copy()
        order = np.flatnonzero(many)
        if not len(order):
            return None
        order = order[np.lexsort([first[order], doc[order]])]
        doc, first = doc[order], first[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
        order, doc, first = order[fresh], doc[fresh], first[fresh]
        pieces = [pieces[i] for i in order]
        sizes = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(p + bytes(V) for p in pieces), np.uint8)
        begin = np.cumsum(sizes + V) - (sizes + V)
        of = np.repeat(np.arange(len(sizes)), sizes + V)
        left = np.maximum(begin[of] + sizes[of] - np.arange(len(text)), 0)
        found = np.sort(repeated_starts(text, left, np.flatnonzero(left >= length), length, int(sizes.max())))
        if not len(found):
            return None
        p = of[found]
        cut = np.ones(len(found), bool)
        cut[1:] = (found[1:] != found[:-1] + 1) | (p[1:] != p[:-1])
        f = np.flatnonzero(cut)
        l = np.append(f[1:], len(found)) - 1
        begin_at = first[p[f]] + found[f] - begin[p[f]]
        return batch(_RANGE, doc[p[f]], begin_at, begin_at + (l - f) + length)

    def settle(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(3).nbytes
            if size < block:
                continue
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0  # sorted; the last bucket may go on
            if not end:
                continue
            done, rest = t.slice(0, end), t.slice(end)
            if (r := sort(*(done.column(c).to_numpy() for c in range(3)), done.column(3).to_pylist())) is not None:
                yield r
            held, size = rest.combine_chunks().to_batches(), rest.column(3).nbytes
        if held:
            t = pa.Table.from_batches(held)
            if (r := sort(*(t.column(c).to_numpy() for c in range(3)), t.column(3).to_pylist())) is not None:
                yield r

    return settle


def repeated_ranges(docs: DataFrame, by_id: DataFrame, length: int, gram: int, block: int, hot: int = HOT) -> DataFrame:
    """Byte ranges covered by ``length``-byte strings that start earlier too."""
    hits = table(compare_runs(find_runs(docs, length, gram, words=False), both=False), "runs")
    asked = hits.where("opened").groupBy("doc_id").agg(F.collect_list(F.struct("first", "shape")).alias("asked"))
    buckets = table(by_id.join(asked, "doc_id").select("doc_id", "bytes", "asked").mapInArrow(lean(_cut(length, gram)), BUCKET), "buckets")
    out = ranges_of(hits, length)
    big = table(buckets.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"), "hot")  # at most one of each ``hot`` rows
    if not big.isEmpty():
        out = out.union(settle_windows(buckets.join(big, "bucket", "left_semi").select(*buckets.columns), length))
        buckets = buckets.join(big, "bucket", "left_anti").select(*buckets.columns)
    return out.union(buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_settle(length, block)), RANGE))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary())])


def _remove(batches):
    for b in batches:
        texts = b.column(1)
        out = [[], [], [], []]
        for i, spans in enumerate(b.column(2).to_pylist()):
            buf = np.frombuffer(texts[i].as_py() or b"", np.uint8)
            gone = covered(len(buf), None if spans is None else np.array([(s["first"], s["last"]) for s in spans], np.int64).reshape(-1, 2))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            for c, x in zip(out, (len(buf), int(gone.sum()), [{"first": f, "last": l} for f, l in edge.reshape(-1, 2).tolist()], buf[~gone].tobytes()), strict=True):
                c.append(x)
        yield batch(_RESULT, b.column(0), *out)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed [first, last) byte runs), kept (bytes left)."""
    docs = documents(docs)
    by_id = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("bytes")).repartition("doc_id")
    spans = spans_by_document(repeated_ranges(docs, by_id, length, gram, block, hot))
    out = by_id.join(spans, "doc_id", "left").select("doc_id", "bytes", "spans").mapInArrow(lean(_remove), "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
