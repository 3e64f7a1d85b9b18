"""Substring dedup with a log-structured fingerprint index.

History is kept as immutable runs of window fingerprints, each dealt into the
same number of buckets by key and sorted in each.  A new batch of documents is
fingerprinted, written as such a run, and merge-joined with every older run bucket
by bucket, so no row of the history is shuffled.  What meets is verified; when a level
has ``fanout`` runs they are merged into one of the next level, again bucket by
bucket, so n batches cost O(log n) rewrites of each row.  A merged run keeps the first
row of each class of equal fingerprints, which is all that a later batch can meet.
One fingerprint stands for a run of windows with one anchor (see
runs.py); runs that only share their anchor are verified window by window with
both functions of the window's exact words.

The folder holds a manifest of the runs, so an index is opened again by its folder
in any later session.  A batch is in the index once a manifest names it; what a failed
job left behind is not read.

Cases: a null text has no words, a null doc_id counts as the least id.  Rows
that share a doc_id count as one document: they are no repeats of each other,
and each row gets the document's result.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .hashing import FIRST, SECOND, word_bounds, word_hashes
from .runs import LATER, ORDER, RUNS, _RUNS, combine, compare_runs, covered, find_runs, ranges_of, spans_by_document, state_of, windows_of
from .shared import NULL_ID, batch, documents, lean, scratch, table

WINDOW, GRAM, FANOUT, BATCHES = 35, 8, 2, 3


class FingerprintIndex:
    """Sorted immutable runs below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.folder = folder or scratch(spark, "fingerprints")
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # level, name of the folder
        self._tables: dict[str, str] = {}
        found = [int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json")]
        if found:
            self.version = max(found)
            m = json.loads("".join(r[0] for r in spark.read.text(f"{self.folder}/manifest-{self.version:06d}.json", wholetext=True).collect()))  # one small file
            if (m["window"], m["gram"]) != (window, gram):
                raise ValueError(f"the index has windows of {m['window']} words and anchors of {m['gram']}")
            self.buckets, self.runs = m["buckets"], [tuple(r) for r in m["runs"]]

    def _file_system(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = self._file_system()
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        """Write the next manifest under a name of its own and rename it, which is atomic."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        text = json.dumps({"window": self.window, "gram": self.gram, "buckets": self.buckets, "runs": runs})
        new, draft = path(f"{self.folder}/manifest-{self.version + 1:06d}.json"), path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = self._file_system().create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._file_system().rename(draft, new):
            raise RuntimeError(f"another writer has made manifest {self.version + 1}")
        self.version, self.runs = self.version + 1, runs

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"level{level}-{uuid.uuid4().hex}"
        self._tables[name] = f"packetloom_{name.replace('-', '_')}"
        rows.write.option("path", f"{self.folder}/{name}").option("compression", "zstd").bucketBy(self.buckets, "anchor").sortBy(*ORDER).saveAsTable(self._tables[name])
        return name

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = f"packetloom_{name.replace('-', '_')}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._tables[name]} (anchor BIGINT, run BIGINT, `check` BIGINT, doc_id BIGINT, first BIGINT, shape INT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, run, `check`, doc_id, first) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self._tables[name])

    def compared(self, new: DataFrame) -> DataFrame:
        """What a run has in common with itself and with all older ones (see compare_runs)."""
        rows, keys = new, new.select("anchor")
        for _, name in self.runs:
            rows = rows.union(self._read(name).join(keys.hint("merge"), "anchor", "left_semi").select(*new.columns))
        return compare_runs(rows, both=True)

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch; returns what it and the history now have in common."""
        name = self._write(find_runs(docs, self.window, self.gram, words=True).repartition(self.buckets, "anchor"), 0)
        hits = table(self.compared(self._read(name)), "hits")
        self._commit([*self.runs, (0, name)])
        self.compact()
        return hits

    def compact(self) -> None:
        """Merge the runs of each level that is full into one run of the next."""
        level = 0
        while any(x >= level for x, _ in self.runs):
            full = [n for x, n in self.runs if x == level]
            if len(full) >= self.fanout:
                name = self._write(self.merged(full), level + 1)
                self._commit([r for r in self.runs if r[1] not in full] + [(level + 1, name)])
                for n in full:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(n)}")
                    self._file_system().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}"), True)
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        """The first row of each class of several runs."""
        rows = self._read(names[0])
        for n in names[1:]:
            rows = rows.union(self._read(n))
        least = rows.where(state_of() != LATER).groupBy(*ORDER[:3]).agg(F.min(F.struct("doc_id", "first", "shape")).alias("least"))
        return least.select(*ORDER[:3], "least.*")

    def close(self) -> None:
        """Forget the runs' names in the catalog; the files stay."""
        for t in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables.clear()


def _windows(window: int):
    """Each window of the asked runs, as a run of one window keyed by both functions."""

    def cut(batches):
        np.seterr(over="ignore")
        for b in batches:
            found = []
            for doc, text, asked in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                buf = np.frombuffer(text or b"", np.uint8)
                s, e, _ = word_bounds(buf, np.array([len(buf)]))
                h = [word_hashes(buf, s, e, by=f) for f in (FIRST, SECOND)]
                at = np.unique(np.concatenate([np.arange(r["first"], r["first"] + windows_of(r["shape"])) for r in asked]))
                at = at[at + window <= len(s)]
                if len(at):
                    key, run = (f.slices(f.prefix(x), at, at + window) for f, x in zip((FIRST, SECOND), h, strict=True))
                    found.append((key, run, np.zeros(len(at), np.uint64), np.full(len(at), doc), at, np.ones(len(at), np.int32)))
            if found:
                yield batch(_RUNS, *combine(*(np.concatenate(c) for c in zip(*found, strict=True))))

    return cut


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _remove(batches):
    for b in batches:
        out = [[], [], []]
        texts = b.column(1)
        for i, spans in enumerate(b.column(2).to_pylist()):
            words = (texts[i].as_py() or b"").split()
            gone = covered(len(words), None if spans is None else np.array([(s["first"], s["last"]) for s in spans], np.int64).reshape(-1, 2))
            kept = b" ".join(words if not gone.any() else [words[x] for x in np.flatnonzero(~gone)])
            for c, x in zip(out, (len(words), int(gone.sum()), kept), strict=True):
                c.append(x)
        yield batch(_RESULT, b.column(0), *out)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, n_batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by one space).

    All rows pass through the index in ``n_batches`` batches by doc_id.
    """
    docs = documents(docs)
    index = FingerprintIndex(docs.sparkSession, window=window, gram=gram, fanout=fanout)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches))
    found = [index.add(docs.where(part == i)) for i in range(n_batches)]
    index.close()
    hits = found[0]
    for h in found[1:]:
        hits = hits.union(h)
    by_id = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("bytes")).repartition("doc_id")
    asked = hits.where("opened").groupBy("doc_id").agg(F.collect_set(F.struct("first", "shape")).alias("asked"))
    single = by_id.join(asked, "doc_id").select("doc_id", "bytes", "asked").mapInArrow(lean(_windows(window)), RUNS)
    ranges = ranges_of(hits.union(compare_runs(single, both=True)), window)
    out = by_id.join(spans_by_document(ranges), "doc_id", "left").select("doc_id", "bytes", "spans").mapInArrow(lean(_remove), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
