"""Packet filters; each is one predicate, so Catalyst may push it into the scan."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bytes import ip_key


@dataclass(frozen=True)
class Filters:
    """All conditions must hold; unset ones do not count."""

    min_size: int = 0
    max_size: int = 0
    exclude_loopback: bool = True
    exclude_multicast: bool = False
    exclude_broadcast: bool = False
    protocol: str | None = None
    ip: str | None = None
    src_ip: str | None = None
    dst_ip: str | None = None
    exclude_ips: tuple[str, ...] = field(default=())
    port: int | None = None
    src_port: int | None = None
    dst_port: int | None = None
    exclude_ports: tuple[int, ...] = field(default=())
    subnet: str | None = None
    direction: str | None = None


def is_loopback(ip: str) -> Column:
    return F.startswith(ip, F.lit("127.")) | (F.col(ip) == "::1")


def is_multicast(ip: str) -> Column:
    return F.col(ip).rlike(r"^(22[4-9]|23[0-9])\.|^ff[0-9a-f]{2}:")


def in_subnet(ip: str, cidr: str) -> Column:
    """Membership of an IPv4 or IPv6 network; a text that is no network filters nothing.

    IPv4 is an integer range, which needs no function per row beyond the conversion.
    """
    try:
        net = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return F.lit(True)
    if net.version == 6:
        ends = [F.unhex(F.lit("06" + x.packed.hex())) for x in (net.network_address, net.broadcast_address)]
        return F.contains(ip, F.lit(":")) & ip_key(F.col(ip)).between(*ends)
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    low = int(net.network_address)
    return F.coalesce(number.between(low, low + net.num_addresses - 1), F.lit(False))


def predicate(f: Filters) -> Column:
    from .decode import is_private

    both = lambda a, b, test: test(a) | test(b)
    out = F.lit(True)
    if f.min_size > 0:
        out &= F.col("packet_size") >= f.min_size
    if f.max_size > 0:
        out &= F.col("packet_size") <= f.max_size
    if f.exclude_loopback:
        out &= ~both("src_ip", "dst_ip", is_loopback)
    if f.exclude_multicast:
        out &= ~is_multicast("dst_ip")
    if f.exclude_broadcast:
        out &= F.col("dst_ip") != "255.255.255.255"
    if f.protocol:
        out &= F.lower("protocol") == f.protocol.lower()
    if f.ip:
        out &= both("src_ip", "dst_ip", lambda c: F.col(c) == f.ip)
    if f.src_ip:
        out &= F.col("src_ip") == f.src_ip
    if f.dst_ip:
        out &= F.col("dst_ip") == f.dst_ip
    if f.exclude_ips:
        out &= ~both("src_ip", "dst_ip", lambda c: F.col(c).isin(*f.exclude_ips))
    if f.port:
        out &= both("src_port", "dst_port", lambda c: F.col(c) == f.port)
    if f.src_port:
        out &= F.col("src_port") == f.src_port
    if f.dst_port:
        out &= F.col("dst_port") == f.dst_port
    if f.exclude_ports:
        out &= ~both("src_port", "dst_port", lambda c: F.col(c).isin(*f.exclude_ports))
    if f.subnet:
        out &= both("src_ip", "dst_ip", lambda c: in_subnet(c, f.subnet))
    if f.direction:
        inside, outside = is_private("src_ip"), is_private("dst_ip")
        out &= {"outbound": inside & ~outside, "inbound": ~inside & outside, "internal": inside & outside, "external": ~inside & ~outside}[f.direction]
    return out


def filter_packets(packets: DataFrame, f: Filters) -> DataFrame:
    return packets.where(predicate(f))


def filter_domain(events: DataFrame, part: str) -> DataFrame:
    """Case-sensitive substring of the bound domain; rows without one fail."""
    return events.where(F.contains(F.col("domain"), F.lit(part)))
