"""Report aggregates: talkers, event types, worker balance, services."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WORKER_FIELDS = ("packets", "bytes")


def top(counts: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k greatest, ties by key."""
    return counts.orderBy(F.desc(value), F.asc(key)).limit(k)


def talkers(packets: DataFrame, k: int = 5) -> DataFrame:
    return top(packets.groupBy(F.col("src_ip").alias("ip")).agg(F.sum(F.col("packet_size").cast("long")).alias("bytes")), "bytes", "ip", k)


def by_type(packets: DataFrame, k: int = 8) -> DataFrame:
    return top(packets.groupBy(F.col("protocol").alias("event_type")).agg(F.count("*").alias("n")), "n", "event_type", k)


def totals(packets: DataFrame) -> DataFrame:
    """Packets, elapsed microseconds of packet time, packets a second (integer)."""
    t = packets.agg(F.count("*").alias("packets"), (F.max("timestamp_us") - F.min("timestamp_us")).alias("elapsed_us"))
    seconds = F.floor(F.col("elapsed_us") / 1_000_000)
    return t.withColumn("pps", F.when(seconds > 0, F.floor(F.col("packets") / seconds)).otherwise(F.col("packets")))


def ticks(packets: DataFrame, seconds: int = 30) -> DataFrame:
    """Packets and bytes per tumbling window of packet time."""
    w = F.floor(F.col("timestamp_us") / (seconds * 1_000_000)) * (seconds * 1_000_000)
    return packets.groupBy(w.alias("tick_us")).agg(F.count("*").alias("packets"), F.sum(F.col("packet_size").cast("long")).alias("bytes"))


def services(packets: DataFrame, ports: DataFrame) -> DataFrame:
    """Adds service: the name of the source port, else of the destination port, else UNKNOWN.

    Of repeated ports the last line counts.  The table has at most 65536 ports,
    which bounds the broadcast.
    """
    names = ports.where(F.col("port").between(0, 65535)).groupBy("port").agg(F.max_by("service", "line_no").alias("service"))
    s = F.broadcast(names.toDF("src_port", "_s"))
    d = F.broadcast(names.toDF("dst_port", "_d"))
    return packets.join(s, "src_port", "left").join(d, "dst_port", "left").withColumn("service", F.coalesce("_s", "_d", F.lit("UNKNOWN"))).drop("_s", "_d")


def worker_balance(packets: DataFrame, workers: int) -> DataFrame:
    """Packets and bytes of each worker when flows are dealt by key; one row with sums and balance (percent)."""
    w = packets.withColumn("worker", F.pmod(F.col("port1") + F.col("port2"), F.lit(workers)))
    each = w.groupBy("worker").agg(F.count("*").alias("packets"), F.sum(F.col("packet_size").cast("long")).alias("bytes"))
    return each.agg(F.count("*").alias("workers"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.floor(F.min("packets") * 100 / F.max("packets")).alias("balance"))


def new_per_tick(flows: DataFrame, seconds: int = 60) -> DataFrame:
    """Flows begun per window and the running total."""
    t = flows.groupBy((F.floor(F.col("first_seen_us") / (seconds * 1_000_000)) * (seconds * 1_000_000)).alias("tick_us")).agg(F.count("*").alias("flows"))
    return t.withColumn("total", F.sum("flows").over(Window.orderBy("tick_us").rowsBetween(Window.unboundedPreceding, 0)))
