"""MinHash near-dedup with fast similarity sketches, banding and exact links.

Sketch: T coordinates.  In round i < T every shingle falls into one bin chosen
by hash i, with the value (i, hash); in round T + b every shingle falls into bin
b.  A coordinate keeps its least value and a document leaves as soon as all its
bins are filled, mostly after ln T rounds of one hash per shingle instead of
T; the last T rounds guarantee that every bin fills.  Coordinates of two
documents agree with the probability of their similarity and concentrate as
independent ones do.  With bands of ROWS coordinates a pair at the threshold is
missed by all BANDS with probability (1 - 0.8**5)**32, about 3e-6.

Groups: documents of equal shingle sets are one class with one representative.
A bucket (one band, one value) isn't expanded into pairs: its members are first
compared with a leader only, then links within one component are needless.  For
buckets with several components the shingles that a document shares with no other
one are counted; they bound its similarity with all of them and leave many out.  The rest is
compared block by block: the intersections of two blocks are one matrix product,
and only pairs that join components come out of it, at most one for a member.  So no link between two components that a bucket holds is lost, and a
group of thousands of near copies costs a few comparisons for each.  Every link is
confirmed on the full shingle sets.

Cases: null or empty text has no shingles and is its own component; a null
doc_id counts as the least id; rows that share a doc_id and text are one
document and all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import FIRST, SECOND, mix, word_bounds, word_hashes
from .shared import NULL_ID, batch, bits_of, blocks, bloom, bytes_of, documents, ids_of, in_bloom, lean, table

WORDS, SHARE = 4, 80
BANDS, ROWS = 32, 5
T = BANDS * ROWS
_U = np.uint64
#: Members of a block, and of a set of buckets that is compared as one.
BLOCK, UNIT = 400, 20_000


def shingles(buf: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (text, hash)."""
    s, e, text = word_bounds(buf, ends)
    h = word_hashes(buf, s, e, lower=True)
    n = np.bincount(text, minlength=len(ends))
    last = np.cumsum(n)
    prefix = FIRST.prefix(h)
    at = np.arange(len(h))
    stop = last[text]
    full = at + words <= stop
    short = (n[text] < words) & (at == stop - n[text])  # the whole sequence
    take = full | short
    t = text[take]
    g = FIRST.slices(prefix, at[take], np.minimum(at[take] + words, stop[take]))
    order = np.lexsort([g, t])
    t, g = t[order], g[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    return t[new], g[new]


def sketch(text: np.ndarray, gram: np.ndarray, n: int, coordinates: int = T) -> np.ndarray:
    """An n x coordinates array; rows of texts without shingles keep the greatest value."""
    full = _U(0xFFFFFFFFFFFFFFFF)
    s = np.full(n * coordinates, full, _U)
    for i in range(2 * coordinates):
        if not len(text):
            break
        h = mix(gram ^ mix(np.array([i + 1], _U)))
        b = (h >> _U(20)) % _U(coordinates) if i < coordinates else np.full(len(h), i - coordinates, _U)
        np.minimum.at(s, text * coordinates + b.astype(np.int64), (h >> _U(10)) | (_U(i) << _U(54)))
        if i < 8 or i % 8 == 0 or i >= coordinates:
            open_ = (s.reshape(n, coordinates) == full).any(axis=1)[text]
            text, gram = text[open_], gram[open_]
    return s.reshape(n, coordinates)


_SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def scan(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (key of the set), bands (hash of each band)."""

    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            buf, ends = bytes_of(b.column(1))
            ids = ids_of(b.column(0))
            for i, j, lo, hi in blocks(ends, 1 << 20):
                rows = j - i
                text, gram = shingles(buf[lo:hi], ends[i:j] - lo, words)
                n = np.bincount(text, minlength=rows)
                stop = np.cumsum(n)
                p = [f.prefix(gram) for f in (FIRST, SECOND)]
                k1, k2 = (f.slices(q, stop - n, stop).view(np.int64) for f, q in zip((FIRST, SECOND), p, strict=True))
                s = sketch(text, gram, rows).reshape(rows, BANDS, ROWS)
                bands = np.broadcast_to(np.arange(BANDS, dtype=_U), (rows, BANDS))
                for r in range(ROWS):
                    bands = mix(bands * _U(0x9E3779B97F4A7C15) ^ s[:, :, r])
                offsets = np.arange(rows + 1, dtype=np.int32) * BANDS
                yield batch(_SCAN, ids[i:j], n, k1, k2, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(bands).view(np.int64).ravel())))

    return docs.mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long, bands array<long>")


#: Members that are compared with one copy of their leader's set.
PART = 500
_SETS = pa.schema([("member", pa.int64()), ("grams", pa.binary())])
_LINKS = pa.schema([("leader", pa.int64()), ("member", pa.int64())])


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """member, grams (sorted distinct hashes) of the documents in ``ids``, and of few others.

    A bit table of bounded size picks them during the scan; no text is shuffled.
    """
    bits, table_ = bloom(ids)
    shared = docs.sparkSession.sparkContext.broadcast(table_)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("member"), "text").withColumns(bits_of("member"))

    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            b = b.filter(pa.array(in_bloom(b, bits, shared.value)))
            buf, ends = bytes_of(b.column(1))
            for i, j, lo, hi in blocks(ends, 1 << 20):
                text, grams = shingles(buf[lo:hi], ends[i:j] - lo, words)
                stop = np.cumsum(np.bincount(text, minlength=j - i)) * 8
                raw = grams.tobytes()
                yield batch(_SETS, b.column(0).slice(i, j - i), [raw[x:y] for x, y in zip([0, *stop.tolist()], stop.tolist(), strict=False)])

    return docs.mapInArrow(lean(run), "member long, grams binary")


def possible(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """rep, alone: how many shingles of each member no other member has.

    They are in no intersection, which bounds the similarity with any member.
    """
    schema = pa.schema([("rep", pa.int64()), ("gram", pa.int64())])
    ids = members.select("rep").distinct()

    def spread(batches):
        for b in batches:
            raw, ends = bytes_of(b.column(1))
            n = np.diff(np.concatenate([[0], ends])) // 8
            yield batch(schema, np.repeat(b.column(0).to_numpy(), n), raw.view(np.int64))

    sets = sets_of(docs, ids, words).join(ids.withColumnRenamed("rep", "member"), "member", "left_semi").distinct()
    once = sets.mapInArrow(lean(spread), "rep long, gram long").groupBy("gram").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).where("n = 1")
    return once.groupBy("rep").agg(F.count("*").alias("alone"))


def confirm(docs: DataFrame, pairs: DataFrame, words: int, share: int) -> DataFrame:
    """Those (leader, member) pairs whose full sets have 100 * intersection >= share * union.

    Each member's set goes to its leaders; a leader's set goes first and is the
    only one that a task holds.
    """
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    salted = pairs.join(parts, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"))
    heads = parts.select("leader", F.col("leader").alias("member"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = table(salted.union(heads), "asked")
    shipped = sets_of(docs, asked.select("member").distinct(), words).distinct().join(asked, "member").select("leader", "part", "member", "grams")

    def compare(batches):
        held, own = None, None
        for b in batches:
            out = []
            for leader, member, grams in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                grams = np.frombuffer(grams.as_py(), _U)
                if leader == member:
                    held, own = leader, grams
                elif held == leader:
                    both = len(own) + len(grams)
                    met = both - len(np.union1d(own, grams))
                    if 100 * met >= share * (both - met):
                        out.append((leader, member))
            yield batch(_LINKS, [x for x, _ in out], [x for _, x in out])

    return shipped.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("member") != F.col("leader"), "member").mapInArrow(lean(compare), "leader long, member long").distinct()


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """node, component (least node reachable) of an undirected graph; ``before``: the result without ``links``.

    Each round contracts the graph along every node's least neighbour, with
    pointer doubling, until no link joins two components.
    """
    cross = links.toDF("a", "b")
    new = cross.select("a").union(cross.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    if before is None:
        label = new
    else:
        label = table(before.union(new.join(before, "node", "left_anti")), "labels")
        for c in ("a", "b"):
            cross = cross.join(label.toDF(c, "to"), c).select(*(F.col("to").alias(x) if x == c else x for x in ("a", "b")))
    cross = table(cross.where("a <> b").distinct(), "links")
    while not cross.isEmpty():
        way = cross.union(cross.select("b", "a")).groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        way = table(way, "way")
        way = table(way.join(way.toDF("to", "next"), "to", "left").select("a", F.coalesce("next", "to").alias("to")), "way")
        label = table(label.join(way.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        for c in ("a", "b"):
            cross = cross.join(way.toDF(c, "to"), c, "left").withColumn(c, F.coalesce("to", c)).select("a", "b")
        cross = table(cross.where("a <> b").distinct(), "links")
    return label


def similar_sizes(a: str, b: str, share: int):
    return (F.col(a) * share <= 100 * F.col(b)) & (F.col(b) * share <= 100 * F.col(a))


def unsettled(docs: DataFrame, members: DataFrame, label: DataFrame, words: int, share: int, unit_size: int) -> DataFrame:
    """unit, rep, component, bands of the members of buckets that hold several components.

    Documents that, without the shingles no other one has, cannot reach the
    share with any other are left out.  A unit is a set of buckets that have
    members in common, or a single bucket where such a set would be large.  That only
    saves comparisons: pairs count if they share a bucket, in either kind of unit.
    """
    now = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def mixed(df):
        several = df.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
        return df.join(several, "band", "left_semi").select("band", "rep", "n", "component")

    now = table(mixed(now), "mixed")
    alone = table(possible(docs, now, words), "alone")
    can = now.join(alone, "rep", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= share * F.col("n"))
    now = table(mixed(table(can, "possible")), "mixed")
    near = now.groupBy("band").agg(F.min("rep").alias("a"))
    unit = components(table(now.join(near, "band").where("rep > a").select("a", F.col("rep").alias("b")).distinct(), "together"))
    size = unit.groupBy(F.col("component").alias("unit")).count()
    now = now.join(unit.toDF("rep", "unit"), "rep").join(size, "unit")
    now = now.select(F.when(F.col("count") > unit_size, F.xxhash64("band")).otherwise(F.col("unit")).alias("unit"), "rep", "component", "band")
    return now.groupBy("unit", "rep", "component").agg(F.collect_set("band").alias("bands"))  # at most BANDS


def compare_all(docs: DataFrame, rest: DataFrame, words: int, share: int) -> DataFrame:
    """(a, b): pairs that connect the components of each unit which confirmed links join.

    A unit is dealt into blocks, each two blocks (or one with itself) are one
    piece of work, and what leaves it is at most one pair for each member.
    """
    rest = table(rest, "rest")
    size = rest.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(size, "unit").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "bands")
    sets = sets_of(docs, rest.select("rep").distinct(), words).distinct()
    work = sets.join(dealt.withColumnRenamed("rep", "member"), "member").select("unit", "i", "j", "own", "member", "component", "grams", "bands")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows):
        own, member, component = (np.array([r[c] for r in rows]) for c in (3, 4, 5))
        i, j = rows[0][1:3]
        if i != j and not (len(set(own.tolist())) == 2):
            return []
        sets_ = [np.frombuffer(r[6], _U) for r in rows]
        n = np.array([len(x) for x in sets_], np.int64)
        _, which, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        common = times > 1
        place = np.cumsum(common) - 1
        of = np.repeat(np.arange(len(rows)), n)[common[which]]
        which = place[which[common[which]]]
        met = np.zeros((len(rows), len(rows)), np.float32)
        for low in range(0, int(common.sum()), 4096):
            part = (which >= low) & (which < low + 4096)
            m = np.zeros((len(rows), 4096), np.float32)
            m[of[part], which[part] - low] = 1
            met += m @ m.T
        linked = 100 * met >= share * (n[:, None] + n[None, :] - met)
        linked &= (own[:, None] != own[None, :]) | (i == j)
        bands, which = np.unique(np.concatenate([np.array(r[7], np.int64) for r in rows]), return_inverse=True)
        of = np.repeat(np.arange(len(rows)), [len(r[7]) for r in rows])
        together = np.zeros((len(rows), len(rows)), bool)
        for low in range(0, len(bands), 4096):
            part = (which >= low) & (which < low + 4096)
            m = np.zeros((len(rows), 4096), np.float32)
            m[of[part], which[part] - low] = 1
            together |= m @ m.T > 0
        linked &= together
        linked |= component[:, None] == component[None, :]
        at = np.arange(len(rows))
        while True:
            least = np.where(linked, at[None, :], len(rows)).min(axis=1)
            least = np.minimum(at, least)
            if (least == at).all():
                break
            at = least
        out = {}
        for x in np.argsort(member):
            out.setdefault((at[x], component[x]), member[x])
        heads = {}
        return [(heads[g], x) for (g, _), x in out.items() if heads.setdefault(g, x) != x]

    def compare(batches):
        held: list = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    if out := links(held):
                        yield batch(schema, [x for x, _ in out], [x for _, x in out])
                    held = []
                held.append(row)
        if held and (out := links(held)):
            yield batch(schema, [x for x, _ in out], [x for _, x in out])

    return work.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "member").mapInArrow(lean(compare), "a long, b long")


def near_dedup(docs: DataFrame, words: int = WORDS, share: int = SHARE, unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    docs = documents(docs)
    rows = table(scan(docs, words), "sets")
    # Exact copies are summed up before the shuffle: one row for each task and set.
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = table(classes, "classes")
    band = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band")
    members = table(band.join(shared, "band"), "members")

    # First the leaders: the least member of each bucket.
    lead = members.groupBy("band").agg(F.min_by(F.struct(F.col("rep").alias("leader"), F.col("n").alias("m")), "rep").alias("l")).select("band", "l.*")
    pairs = members.join(lead, "band").where((F.col("rep") != F.col("leader")) & similar_sizes("n", "m", share)).select("leader", F.col("rep").alias("member")).distinct()
    label = components(table(confirm(docs, table(pairs, "pairs"), words, share), "confirmed"))
    # Then whatever a bucket holds of several components.
    rest = unsettled(docs, members, label, words, share, unit)
    label = components(table(compare_all(docs, rest, words, share), "links"), label)
    part = classes.select("k1", "k2", "rep")
    part = part.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = rows.join(part.select("k1", "k2", "component"), ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))
