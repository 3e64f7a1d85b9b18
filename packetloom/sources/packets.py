"""Packet tables: derived from the events table, encoded to frames, read from captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bytes import be, ipv4_bytes, raw

#: Server ports by server number modulo 8.
PORTS = (53, 80, 443, 445, 5353, 67, 21, 389)
UDP_PORTS = (53, 67, 5353)
START_US = 1704067200000000


def packets_from_events(events: DataFrame) -> DataFrame:
    """One packet for each event, by integer arithmetic on event_id and user_id."""
    e, c = F.col("event_id"), F.col("user_id")
    s = (c * 7 + F.floor(e / 1600)) % 12
    port = F.element_at(F.array(*map(F.lit, PORTS)), (s % 8 + 1).cast("int"))
    rows = events.select(
        (e + 1).alias("packet_id"),
        (F.lit(START_US) + e * 250000).alias("timestamp_us"),
        c.alias("client"),
        s.alias("server"),
        (e % 3 == 0).alias("rev"),
        F.concat(F.lit("10.0."), F.floor(c / 50), F.lit("."), 1 + c % 50).alias("client_ip"),
        (40000 + c).cast("int").alias("client_port"),
        F.concat(F.lit("192.168.1."), 10 + s).alias("server_ip"),
        port.alias("server_port"),
        (40 + (e * 37) % 1400).cast("int").alias("payload_len"),
    )
    side = lambda a, b: F.when(F.col("rev"), F.col(a)).otherwise(F.col(b))
    protocol = F.when(F.col("server_port").isin(*UDP_PORTS), "UDP").otherwise("TCP")
    return rows.select(
        "packet_id",
        "timestamp_us",
        side("server_ip", "client_ip").alias("src_ip"),
        side("server_port", "client_port").alias("src_port"),
        side("client_ip", "server_ip").alias("dst_ip"),
        side("client_port", "server_port").alias("dst_port"),
        protocol.alias("protocol"),
        "payload_len",
        (F.col("payload_len") + F.when(protocol == "UDP", 42).otherwise(54)).cast("int").alias("packet_size"),
        F.concat(F.lit("02:00:00:00:"), F.lower(F.lpad(F.hex(F.floor(F.col("client") / 256)), 2, "0")), F.lit(":"), F.lower(F.lpad(F.hex(F.col("client") % 256), 2, "0"))).alias("src_mac"),
    )


def load_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"))


def beyond_headers() -> list[Column]:
    """src_ip, src_port, dst_ip, dst_port where a header has no room for them (an octet over 255, a port over 65535), else null."""
    wide = lambda ip: F.exists(F.split(ip, r"\."), lambda x: x.cast("long") > 255)
    return [F.when(wide(x) if x.endswith("ip") else F.col(x) > 65535, F.col(x)).alias(f"wide_{x}") for x in ("src_ip", "src_port", "dst_ip", "dst_port")]


def encode_frames(packets: DataFrame, payload: Column | None = None, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Ethernet II, IPv4, UDP or TCP frames: frame_no, timestamp_us, wire_len, frame, and what is to be kept."""
    body = F.unhex(F.repeat(F.lit("2E"), F.col("payload_len"))) if payload is None else payload
    size = F.octet_length(body)
    mac = F.unhex(F.replace(F.col("src_mac"), F.lit(":"), F.lit("")))
    udp = F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), be(size + 8, 2), raw("0000"))
    seq = F.pmod(F.col("packet_id") * 1000, F.lit(4294967296))
    tcp = F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), be(seq, 4), raw("00000000501802000000" + "0000"))
    is_udp = F.col("protocol") == "UDP"
    transport = F.when(is_udp, udp).otherwise(tcp)
    total = size + F.when(is_udp, 28).otherwise(40)
    ip = F.concat(raw("4500"), be(total, 2), raw("00004000"), raw("40"), F.when(is_udp, raw("11")).otherwise(raw("06")), raw("0000"), ipv4_bytes(F.col("src_ip")), ipv4_bytes(F.col("dst_ip")))
    frame = F.concat(raw("02FFFFFFFFFE"), mac, raw("0800"), ip, transport, body)
    return packets.select(F.col("packet_id").alias("frame_no"), "timestamp_us", F.octet_length(frame).alias("wire_len"), frame.alias("frame"), *keep)
