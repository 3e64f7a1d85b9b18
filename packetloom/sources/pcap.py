"""Capture files as a Spark data source: ``spark.read.format("pcap").load(path)``.

One partition for each file; a file is read as a stream of packets, so its size
does not matter.  Files must be on a path that the executors can open; for a
store that only Spark reads, use ``from_binary`` on a ``binaryFile`` frame.
"""

from __future__ import annotations

import glob
import struct
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, frame_no long, timestamp_us long, wire_len int, frame binary, error string"
_ARROW = pa.schema([("file", pa.string()), ("frame_no", pa.int64()), ("timestamp_us", pa.int64()), ("wire_len", pa.int32()), ("frame", pa.binary()), ("error", pa.string())])
#: Magic numbers and whether their fractions are nanoseconds.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
ROWS = 1000


def packets(f: BinaryIO) -> Iterator[tuple[int, int, int, bytes | None, str | None]]:
    """frame_no, timestamp_us, wire_len, frame, error; reading stops at the first error."""
    head = f.read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        yield 0, 0, 0, None, "not a capture file"
        return
    order, per_us = MAGIC[head[:4]]
    n = 0
    while True:
        h = f.read(16)
        if not h:
            return
        n += 1
        if len(h) < 16:
            yield n, 0, 0, None, "packet header incomplete"
            return
        sec, frac, kept, wire = struct.unpack(order + "4I", h)
        data = f.read(kept) if kept <= 1 << 24 else b""
        if len(data) < kept:
            yield n, sec * 1_000_000 + frac // per_us, wire, None, "packet data incomplete"
            return
        yield n, sec * 1_000_000 + frac // per_us, wire, data, None


def _batches(name: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for p in packets(f):
        rows.append((name, *p))
        if len(rows) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class PcapReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from _batches(partition.value, f)


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PcapReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def from_binary(files: DataFrame) -> DataFrame:
    """Packets of a ``binaryFile`` frame (columns path, content)."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _batches(path, BytesIO(content))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def numbered(packets: DataFrame) -> DataFrame:
    """Packets of several files with frame_no counted on from file to file, in order of the names."""
    from pyspark.sql import functions as F

    sizes = packets.groupBy("file").agg(F.max("frame_no").alias("n")).orderBy("file").collect()  # one row for each file
    before, rows = 0, []
    for r in sizes:
        rows.append((r["file"], before))
        before += r["n"]
    offsets = packets.sparkSession.createDataFrame(rows, "file string, _before long")
    return packets.join(offsets, "file").withColumn("frame_no", F.col("frame_no") + F.col("_before")).drop("_before").select(*packets.columns)


def tail(spark: SparkSession, folder: str, pattern: str = "*.pcap", files_per_trigger: int = 10) -> DataFrame:
    """Packets of a folder of rotating captures as a stream; files must be moved in when complete."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return from_binary(files)


def sha256(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of capture files."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_pcap(frames: DataFrame, path: str, snaplen: int = 262_144) -> None:
    """One classic capture file from frames in frame_no order (small captures and tests: rows pass through the driver)."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, 1))
        for r in frames.orderBy("frame_no").toLocalIterator():
            f.write(struct.pack("<4I", r["timestamp_us"] // 1_000_000, r["timestamp_us"] % 1_000_000, len(r["frame"]), r["wire_len"]) + bytes(r["frame"]))
