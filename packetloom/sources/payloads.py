"""Protocol payloads made from table rows, for round-trip checks and demonstrations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.bytes import be, raw


def text(value) -> Column:
    return F.encode(value if isinstance(value, Column) else F.lit(value), "UTF-8")


def counted(value: Column, n: int = 1) -> Column:
    """A string or bytes behind its length in n bytes."""
    return F.concat(be(F.octet_length(value), n), value)


def le(value: Column, n: int) -> Column:
    return F.concat(*(be(F.pmod(F.floor(value / (1 << (8 * i))), F.lit(256)), 1) for i in range(n)))


def dns_labels(name: Column) -> Column:
    """A name as counted labels with a final zero (labels of at most 63 bytes)."""
    label = F.transform(F.split(name, r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(F.encode(x, "UTF-8"))))
    return F.unhex(F.concat(F.array_join(label, ""), F.lit("00")))


def dns_response(name: Column, ip: Column, ttl: Column, extra: Column | None = None, n_extra: int = 0) -> Column:
    """One question and an address answer whose owner is a pointer to it."""
    head = F.concat(raw("123481800001"), be(F.lit(1 + n_extra), 2), raw("00000000"))
    question = F.concat(dns_labels(name), raw("00010001"))
    answer = F.concat(raw("C00C00010001"), be(ttl, 4), raw("0004"), ip)
    return F.concat(head, question, answer, *([extra] if extra is not None else []))


def dns_record(kind: int, data: Column, ttl: Column) -> Column:
    return F.concat(raw("C00C"), be(F.lit(kind), 2), raw("0001"), be(ttl, 4), be(F.octet_length(data), 2), data)


def tls_client_hello(sni: Column, protocols: Column, resumed: Column, suites: Column) -> Column:
    """A record with server name, ALPN list (array of strings), optional session ticket and cipher suites (array of ints)."""
    name = F.concat(be(F.octet_length(text(sni)) + 3, 2), raw("00"), counted(text(sni), 2))
    listed = F.unhex(F.array_join(F.transform(protocols, lambda p: F.concat(F.lpad(F.hex(F.length(p)), 2, "0"), F.hex(F.encode(p, "UTF-8")))), ""))
    alpn = counted(listed, 2)
    ext = lambda kind, data: F.concat(be(F.lit(kind), 2), counted(data, 2))
    extensions = F.concat(ext(0, name), ext(16, alpn), ext(10, raw("0004001D0017")), ext(11, raw("0100")), F.when(resumed, ext(35, raw("AABBCCDD"))).otherwise(ext(35, F.unhex(F.lit("")))))
    ciphers = F.unhex(F.array_join(F.transform(suites, lambda s: F.lpad(F.hex(s), 4, "0")), ""))
    hello = F.concat(raw("0303"), raw("5A" * 32), raw("00"), counted(ciphers, 2), raw("0100"), counted(extensions, 2))
    shake = F.concat(raw("01"), be(F.octet_length(hello), 3), hello)
    return F.concat(raw("160301"), counted(shake, 2))


def dhcp4(kind: Column, ip: Column, mac: Column, host: Column, requested: Column, vendor: Column) -> Column:
    fixed = F.concat(raw("02010600" + "00" * 12), ip, raw("00" * 8), mac, raw("00" * 10), raw("00" * 192), raw("63825363"))
    option = lambda code, data: F.concat(be(F.lit(code), 1), counted(data, 1))
    return F.concat(fixed, option(53, be(kind, 1)), option(12, text(host)), option(50, requested), option(60, text(vendor)), raw("FF"))


def smb2(command: Column, status: Column, response: Column, body: Column | None = None) -> Column:
    head = F.concat(raw("FE534D424000"), raw("0000"), le(status, 4), le(command, 2), raw("0000"), le(F.when(response, 1).otherwise(0), 4), raw("00" * 44))
    whole = head if body is None else F.concat(head, body)
    return F.concat(raw("00"), counted(whole, 3))


def smb2_tree_connect(path: Column) -> Column:
    wide = F.encode(path, "UTF-16LE")
    return smb2(F.lit(3), F.lit(0), F.lit(False), F.concat(raw("09000000"), le(F.lit(72), 2), le(F.octet_length(wide), 2), wide))


def quic_initial(version: Column, dcid: Column, scid: Column, token_length: Column) -> Column:
    """Long header; the token length is written in the shortest form."""
    var = F.when(token_length < 64, be(token_length, 1)).when(token_length < 16384, be(token_length + 16384, 2)).otherwise(be(token_length + 2147483648, 4))
    return F.concat(raw("C3"), be(version, 4), counted(dcid, 1), counted(scid, 1), var)


def quic_crypto(version: Column, hello: Column, frame_length: Column | None = None) -> Column:
    """An Initial packet that is not protected: padding, a ping and a CRYPTO frame, which may claim another length."""
    frames = F.concat(raw("0000010600"), be((F.octet_length(hello) if frame_length is None else frame_length) + 16384, 2), hello)
    return F.concat(quic_initial(version, raw("0102030405060708"), raw("0A"), F.lit(0)), be(F.octet_length(frames) + 4 + 16384, 2), raw("00000000"), frames)


def asn(tag: str, data: Column) -> Column:
    n = F.octet_length(data)
    return F.concat(raw(tag), F.when(n < 128, be(n, 1)).otherwise(F.concat(raw("82"), be(n, 2))), data)
