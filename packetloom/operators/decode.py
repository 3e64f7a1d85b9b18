"""Header decode and packet numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bytes import ipv4_text, ipv6_text, mac_text, slice_, u
from ..plans.stage import numbered
from . import decode_arrow

#: EtherTypes and IP protocol numbers.
VLAN, IPV4, IPV6, ARP = 0x8100, 0x0800, 0x86DD, 0x0806
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58


def staged(df: DataFrame, **columns) -> DataFrame:
    """Adds columns behind a one-row generator, so that later steps refer to them instead of repeating them.

    Projections are otherwise merged and filters pushed through them, and each
    level of a header would double the expressions of the one before.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def decode_frames(frames: DataFrame, native: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds MAC and IP addresses, ports, protocol, sequence number, payload and ``error``.

    One VLAN tag is skipped.  ``protocol`` is null for frames that are no
    TCP, UDP or ICMP; ``error`` says why a frame could not be read.  Frames are
    decoded in Arrow batches, or (``native``) by built-in expressions alone,
    which is several times slower.  Columns named in ``without`` are left out,
    and do not go back from Python.
    """
    if not native:
        return decode_arrow.decode_frames(frames, without)
    size = F.octet_length("frame")
    f = staged(frames, _type=u("frame", 12, 2))
    f = staged(f, _net=F.when(F.col("_type") == VLAN, 18).otherwise(14), _kind=F.when(F.col("_type") == VLAN, u("frame", 16, 2)).otherwise(F.col("_type")))
    net, kind = F.col("_net"), F.col("_kind")
    f = staged(f, _first=u("frame", net, 1))
    version = F.floor(F.col("_first") / 16)
    f = staged(f, _v4=F.coalesce((kind == IPV4) & (version == 4), F.lit(False)), _v6=F.coalesce((kind == IPV6) & (version == 6), F.lit(False)))
    v4, v6 = F.col("_v4"), F.col("_v6")
    f = staged(
        f,
        _head=F.when(v4, (F.col("_first") % 16) * 4).when(v6, 40).cast("int"),
        _end=F.when(v4, net + u("frame", net + 2, 2)).when(v6, net + 40 + u("frame", net + 4, 2)).cast("int"),
        _proto=F.when(v4, u("frame", net + 9, 1)).when(v6, u("frame", net + 6, 1)),
    )
    proto = F.col("_proto")
    f = staged(f, _l4=net + F.col("_head"))
    l4 = F.col("_l4")
    f = staged(f, _tcp_head=F.when(proto == TCP, F.floor(u("frame", l4 + 12, 1) / 16) * 4).cast("int"))
    least = F.when(proto == TCP, 20).when(proto == UDP, 8).when(proto.isin(ICMP, ICMPV6), 8).otherwise(0)
    error = (
        F.when(size < 14, "ethernet header incomplete")
        .when((kind == IPV4) & ((size < net + 20) | (size < l4)), "ipv4 header incomplete")
        .when((kind == IPV4) & (~v4 | (F.col("_head") < 20)), "ipv4 header invalid")
        .when((kind == IPV6) & (size < net + 40), "ipv6 header incomplete")
        .when((kind == IPV6) & ~v6, "ipv6 header invalid")
        .when((v4 | v6) & (size < l4 + least), "transport header incomplete")
        .when((F.col("_tcp_head") < 20) | (size < l4 + F.col("_tcp_head")), "tcp header invalid")
    )
    protocol = F.when(proto == TCP, "TCP").when(proto == UDP, "UDP").when((proto == ICMP) & v4, "ICMP").when((proto == ICMPV6) & v6, "ICMPv6")
    f = staged(f, error=error)
    ok = F.col("error").isNull()
    f = staged(f, protocol=F.when(ok & (v4 | v6), protocol))
    ported = F.col("protocol").isin("TCP", "UDP")
    begin = F.when(F.col("protocol") == "TCP", l4 + F.col("_tcp_head")).when(F.col("protocol") == "UDP", l4 + 8).otherwise(l4)
    out = staged(
        f,
        src_mac=F.when(size >= 14, mac_text("frame", 6)),
        src_ip=F.when(ok & v4, ipv4_text("frame", net + 12)).when(ok & v6, ipv6_text("frame", net + 8)),
        dst_ip=F.when(ok & v4, ipv4_text("frame", net + 16)).when(ok & v6, ipv6_text("frame", net + 24)),
        src_port=F.when(ported, u("frame", l4, 2)).when(F.col("protocol").isNotNull(), 0).cast("int"),
        dst_port=F.when(ported, u("frame", l4 + 2, 2)).when(F.col("protocol").isNotNull(), 0).cast("int"),
        tcp_seq=F.when(F.col("protocol") == "TCP", u("frame", l4 + 4, 4)),
        packet_size=F.col("wire_len").cast("int"),
        payload=F.when(F.col("protocol").isNotNull(), slice_("frame", begin, F.greatest(F.least(F.col("_end"), size) - begin, F.lit(0)))),
    )
    return out.drop("_type", "_net", "_kind", "_first", "_v4", "_v6", "_head", "_end", "_proto", "_l4", "_tcp_head", *without)


def number_packets(decoded: DataFrame) -> DataFrame:
    """packet_id: 1, 2, ... over the decodable packets in frame order."""
    return number_frames(decoded)[0]


def number_frames(decoded: DataFrame, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The decodable packets with their packet_id, and all frames; both are read from one table (``top``: see stage.numbered)."""
    return numbered(decoded, "decoded", "packet_id", "frame_no", [], F.col("protocol").isNull(), top)


def device_first_seen(decoded: DataFrame) -> DataFrame:
    """The first frame of each source MAC address."""
    return decoded.where("src_mac is not null").groupBy("src_mac").agg(F.min("frame_no").alias("frame_no"), F.min_by("timestamp_us", "frame_no").alias("timestamp_us"))


def is_private(ip: str):
    """RFC 1918, loopback, link-local and unique-local addresses."""
    c = F.col(ip)
    return c.rlike(r"^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^127\.|^169\.254\.|^::1$|^f[cd][0-9a-f]{2}:")


def flow_id(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", protocol="protocol"):
    """Directional text of a packet's flow."""
    return F.format_string("%s:%d-%s:%d-%s", src_ip, F.col(src_port).cast("long"), dst_ip, F.col(dst_port).cast("long"), protocol)
