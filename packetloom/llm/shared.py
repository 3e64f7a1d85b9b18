"""Shared folder, code shipping and Arrow helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.stage import shared_folder

#: Rows of an Arrow batch, unless the session sets a number of its own.
ROWS = 2000
_PACKAGE = Path(__file__).resolve().parent.parent


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, below the cluster's spark.checkpoint.dir (see plans.stage)."""
    return f"{shared_folder(spark)}/packetloom/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    The files are committed by Spark's writer, so a lost executor costs only
    the tasks it was running, and readers on other machines see the data.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package unless their PYTHONPATH has it already."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        # Spark's default is made for rows of numbers; with texts it would hold tens of MB for each batch.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    if str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_packetloom", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "packetloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in _PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    sc._packetloom = True


#: What operators remember in a Python worker between tasks, by operator.
MEMORIES: dict[str, dict] = {}


def memory(owner: str) -> dict:
    return MEMORIES.setdefault(owner, {})


def lean(f, owner: str = ""):
    """A mapInArrow function that gives memory back: workers live on for later tasks.

    Before its work it forgets what other operators remembered, after it the
    allocators return what they hold in reserve.
    """

    def run(batches):
        from packetloom.llm import shared

        for name, kept in shared.MEMORIES.items():
            if name != owner:
                kept.clear()
        try:
            yield from f(batches)
        finally:
            shared.release()

    return run


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(df: DataFrame) -> DataFrame:
    """The two columns the text operators need; all others stay behind."""
    ship(df.sparkSession)
    return df.select("doc_id", "text")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all texts and their end offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(o):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, o[1:] - o[0]


def blocks(ends: np.ndarray, size: int = 1 << 18):
    """Row ranges [i, j) whose texts make up about ``size`` bytes; a longer text is alone."""
    i, n = 0, len(ends)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield i, j, int(base), int(ends[j - 1])
        i = j


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64; null takes the least value, which is kept for it."""
    return pc.fill_null(pc.cast(column, pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


NULL_ID = -(1 << 63)


def bloom(ids: DataFrame, most: int = 1 << 28):
    """Number of bits and words of a bit table that has two bits for each id of a one-column frame.

    It is at most ``most`` bits (32 MB) however many ids there are; with more it lets more others pass.
    """
    n = ids.count()
    bits = min(most, max(1 << 12, 1 << (16 * n).bit_length()))
    c = F.col(ids.columns[0])
    places = [F.pmod(F.xxhash64(c, F.lit(s)), F.lit(bits)) for s in (1, 2)]
    word = ids.select(F.explode(F.array(*places)).alias("b")).selectExpr("shiftright(b, 5) w", "shiftleft(1L, cast(b & 31 as int)) m")
    rows = word.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    table_ = np.zeros(bits // 32 + 1, np.uint32)
    table_[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64).astype(np.uint32)
    return bits, table_


def bits_of(key: str) -> dict:
    """The columns that ``in_bloom`` looks up, to be added last."""
    return {"_a": F.xxhash64(key, F.lit(1)), "_b": F.xxhash64(key, F.lit(2))}


def in_bloom(b: pa.RecordBatch, bits: int, words: np.ndarray) -> np.ndarray:
    """Which rows of a batch may be among the ids; its last two columns are bits_of the key."""
    hit = np.ones(b.num_rows, np.uint32)
    for c in (2, 1):
        at = b.column(b.num_columns - c).to_numpy() & (bits - 1)
        hit &= words[at >> 5] >> (at & 31).astype(np.uint32)
    return (hit & 1).astype(bool)
