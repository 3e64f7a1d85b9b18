"""Bidirectional flows: keys, sessions, running counters, summaries.

All windows share the partitioning by flow key and the order by packet_id, so
Spark plans one exchange and one sort for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.bytes import ip_key

KEY = ("ip1", "port1", "ip2", "port2")
IDLE_US, SWEEP = 120_000_000, 256


def with_flow_key(packets: DataFrame, key=ip_key) -> DataFrame:
    """Adds ip1, port1, ip2, port2: the lower endpoint (address by number, then port) first.

    The protocol is not part of the key: TCP and UDP between the same endpoints
    are one flow.
    """
    src = F.struct(key(F.col("src_ip")).alias("k"), F.col("src_port").cast("int").alias("p"))
    dst = F.struct(key(F.col("dst_ip")).alias("k"), F.col("dst_port").cast("int").alias("p"))
    up = src <= dst
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return packets.withColumns({"ip1": pick("src_ip", "dst_ip"), "port1": pick("src_port", "dst_port"), "ip2": pick("dst_ip", "src_ip"), "port2": pick("dst_port", "src_port")})


def _by_key():
    return Window.partitionBy(*KEY).orderBy("packet_id")


def sessions_by_gap(packets: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Adds session_id: a flow ends when the next packet comes idle_us or more later."""
    w = _by_key()
    gap = F.col("timestamp_us") - F.lag("timestamp_us").over(w)
    return packets.withColumn("_new", F.when(gap >= idle_us, 1).otherwise(0)).withColumn("session_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions_by_sweep(packets: DataFrame, idle_us: int = IDLE_US, every: int = SWEEP) -> DataFrame:
    """Adds session_id by the sweep rule: idle flows end only at every ``every``-th packet.

    A flow breaks between packets i and j if the last sweep before j comes after
    i and at least idle_us later (timestamps do not fall).  The sweep a packet
    sees is found by arithmetic on its number, so this is an equi-join.
    """
    sweeps = packets.where(F.col("packet_id") % every == 0).select(F.col("packet_id").alias("_sweep"), F.col("timestamp_us").alias("_at"))
    w = _by_key()
    p = packets.withColumn("_sweep", F.floor((F.col("packet_id") - 1) / every) * every).join(sweeps, "_sweep", "left")
    broken = (F.col("_sweep") > F.lag("packet_id").over(w)) & (F.col("_at") - F.lag("timestamp_us").over(w) >= idle_us)
    p = p.withColumn("_new", F.when(broken, 1).otherwise(0))
    return p.withColumn("session_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_sweep", "_at")


def running_counters(sessions: DataFrame) -> DataFrame:
    """Adds is_new, flow_packets, flow_tx_bytes, flow_rx_bytes up to and with each packet.

    Sent is what comes from the endpoint of the flow's first packet.
    """
    by = Window.partitionBy(*KEY, "session_id").orderBy("packet_id")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first_value(F.struct("src_ip", "src_port")).over(run)
    s = sessions.withColumn("_sent", F.struct("src_ip", "src_port") == first)
    size = F.col("payload_len").cast("long")
    return s.withColumns(
        {
            "is_new": F.row_number().over(by) == 1,
            "flow_packets": F.count("*").over(run),
            "flow_tx_bytes": F.sum(F.when(F.col("_sent"), size).otherwise(0)).over(run),
            "flow_rx_bytes": F.sum(F.when(F.col("_sent"), 0).otherwise(size)).over(run),
        }
    ).drop("_sent")


def summaries(sessions: DataFrame) -> DataFrame:
    """One row for each flow session; partial aggregates are combined before the shuffle."""
    size = F.col("payload_len").cast("long")
    from_low = (F.col("src_ip") == F.col("ip1")) & (F.col("src_port") == F.col("port1"))
    out = sessions.groupBy(*KEY, "session_id").agg(
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol"), "packet_id").alias("f"),
        F.count("*").alias("packets"),
        F.sum(F.when(from_low, size).otherwise(0)).alias("_low"),
        F.sum(F.when(from_low, 0).otherwise(size)).alias("_high"),
        F.min("timestamp_us").alias("first_seen_us"),
        F.max("timestamp_us").alias("last_seen_us"),
    )
    low_first = (F.col("f.src_ip") == F.col("ip1")) & (F.col("f.src_port") == F.col("port1"))
    return out.select(
        *KEY,
        "session_id",
        "f.src_ip",
        F.col("f.protocol").alias("protocol"),
        "packets",
        F.when(low_first, F.col("_low")).otherwise(F.col("_high")).alias("bytes_sent"),
        F.when(low_first, F.col("_high")).otherwise(F.col("_low")).alias("bytes_received"),
        "first_seen_us",
        "last_seen_us",
    )
