"""Texts for people: durations, sizes, flows, names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
TLS_HANDSHAKES = {0: "HelloRequest", 1: "ClientHello", 2: "ServerHello", 4: "NewSessionTicket", 8: "EncryptedExtensions", 11: "Certificate", 12: "ServerKeyExchange", 13: "CertificateRequest", 14: "ServerHelloDone", 15: "CertificateVerify", 16: "ClientKeyExchange", 20: "Finished"}
TLS_RECORDS = {20: "ChangeCipherSpec", 21: "Alert", 22: "Handshake", 23: "ApplicationData", 24: "Heartbeat"}


def decimals(value: Column, divisor: int, places: int) -> Column:
    """value / divisor with fixed decimals, by whole-number arithmetic (half up)."""
    scale = 10**places
    n = F.floor((value * scale * 2 + divisor) / (2 * divisor))
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))


def duration(us: Column) -> Column:
    s = F.floor(us / 1_000_000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(us < 1_000, F.concat(us.cast("string"), F.lit("µs")))
        .when(us < 1_000_000, F.concat(decimals(us, 1_000, 3), F.lit("ms")))
        .when(us < 60_000_000, F.concat(decimals(us, 1_000_000, 1), F.lit("s")))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m % 60, s % 60))
        .otherwise(F.format_string("%dm %ds", m, s % 60))
    )


def size(n: Column) -> Column:
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(decimals(n, 1 << 10, 1), F.lit(" KB"))).when(n < 1 << 30, F.concat(decimals(n, 1 << 20, 1), F.lit(" MB"))).otherwise(F.concat(decimals(n, 1 << 30, 2), F.lit(" GB")))


def flow_line(protocol="protocol", a="ip1", ap="port1", b="ip2", bp="port2", domain=None, packets="packets", total="bytes") -> Column:
    named = F.lit("") if domain is None else F.when(F.col(domain).isNotNull(), F.concat(F.lit(" ("), F.col(domain), F.lit(")"))).otherwise("")
    return F.concat(F.col(protocol), F.lit(" "), F.col(a), F.lit(":"), F.col(ap).cast("string"), F.lit(" → "), F.col(b), F.lit(":"), F.col(bp).cast("string"), named, F.lit(" [pkts="), F.col(packets).cast("string"), F.lit(" bytes="), F.col(total).cast("string"), F.lit("]"))


def printable(c: Column) -> Column:
    return F.regexp_replace(c, "[^ -~]", "?")
