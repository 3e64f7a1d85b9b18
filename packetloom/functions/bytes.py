"""Reading and writing binary headers with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def u(data, offset, n: int) -> Column:
    """Unsigned big-endian integer of n bytes (at most 7) at a 0-based offset; null past the end."""
    piece = F.substring(data, F.lit(offset) + 1 if isinstance(offset, int) else offset + 1, F.lit(n))
    return F.when(F.octet_length(piece) == n, F.conv(F.hex(piece), 16, 10).cast("long"))


def u_le(data, offset, n: int) -> Column:
    """Unsigned little-endian integer."""
    out = u(data, offset, 1)
    for i in range(1, n):
        out = out + u(data, offset + i, 1) * (1 << (8 * i))
    return out


def be(value, n: int) -> Column:
    """n big-endian bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(value.cast("long") if isinstance(value, Column) else F.lit(value).cast("long")), 2 * n, "0"))


def raw(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def join(*parts) -> Column:
    return F.concat(*parts)


def slice_(data, offset, n) -> Column:
    """n bytes at a 0-based offset."""
    pos = F.lit(offset) + 1 if isinstance(offset, int) else offset + 1
    return F.substring(data, pos, F.lit(n) if isinstance(n, int) else n)


def rest(data, offset) -> Column:
    """Everything from a 0-based offset on."""
    c = F.col(data) if isinstance(data, str) else data
    return slice_(c, offset, F.greatest(F.octet_length(c) - offset, F.lit(0)))


def ipv4_text(data, offset) -> Column:
    return F.concat_ws(".", *(u(data, offset + i, 1).cast("string") for i in range(4)))


def ipv6_text(data, offset) -> Column:
    """Canonical text: lower-case groups without leading zeros, the leftmost longest run of zeros as ``::``."""
    groups = [F.lower(F.conv(F.hex(slice_(data, offset + 2 * i, 2)), 16, 16)) for i in range(8)]
    full = F.concat_ws(":", *groups)
    out = full
    for k in range(2, 9):  # the last that applies is the longest
        run = "(?:^|:)0" + ":0" * (k - 1) + "(?::|$)"
        halves = F.split(full, run, 2)
        out = F.when(full.rlike(run), F.concat(halves[0], F.lit("::"), halves[1])).otherwise(out)
    return out


def mac_text(data, offset) -> Column:
    return F.concat_ws(":", *(F.lower(F.hex(slice_(data, offset + i, 1))) for i in range(6)))


def ipv4_bytes(ip) -> Column:
    parts = F.split(ip, r"\.")
    return F.concat(*(be(parts[i].cast("long"), 1) for i in range(4)))


def ipv4_key(ip) -> Column:
    """Sort key of an IPv4 address: family byte and 16 bytes, so addresses order by number and v4 before v6."""
    return F.concat(raw("04"), ipv4_bytes(ip), raw("00" * 12))


def ipv6_key(data, offset) -> Column:
    return F.concat(raw("06"), slice_(data, offset, 16))


def ip_key(ip) -> Column:
    """Sort key of an address text of either family, as ipv4_key and ipv6_key give it."""
    six = F.contains(ip, F.lit(":"))
    part = lambda i: F.regexp_extract(ip, r"(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).try_cast("long")
    dotted = F.contains(ip, F.lit("."))
    plain = F.when(dotted, F.concat(F.regexp_replace(ip, r"[\d.]+$", ""), F.hex(part(1) * 256 + part(2)), F.lit(":"), F.hex(part(3) * 256 + part(4)))).otherwise(ip)
    halves = F.split(F.when(six, plain), "::", 2)
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(groups(0)) - F.size(groups(1)), F.lit(0)))
    digits = F.array_join(F.transform(F.concat(groups(0), zeros, groups(1)), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(six, F.concat(raw("06"), F.unhex(digits))).otherwise(ipv4_key(F.when(~six, ip)))
