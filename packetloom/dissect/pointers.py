"""Dissectors that follow lengths and pointers: Arrow batches through plain Python.

``dissect`` adds one struct column; its field ``error`` says why a payload could
not be read.  Only rows that pass the caller's gate should come here.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.names import DNS_TYPES, KERBEROS_TAGS, LDAP_OPS
from ..plans.stage import small_batches

MAX_RECORDS, MAX_LIST, MAX_JUMPS = 64, 16, 10


class Bad(ValueError):
    """A payload that breaks its protocol: reason and offset."""


def need(data: bytes, at: int, n: int, what: str) -> None:
    if at + n > len(data):
        raise Bad(f"{what} at offset {at} exceeds {len(data)} bytes")


def dns_name(data: bytes, at: int) -> tuple[str, int]:
    """The name at an offset and the offset after it; pointers must go backward."""
    labels, after, jumps, lowest = [], None, 0, at
    while True:
        need(data, at, 1, "name")
        n = data[at]
        if n == 0:
            at += 1
            break
        if n >= 0xC0:
            need(data, at, 2, "name pointer")
            target = (n & 0x3F) << 8 | data[at + 1]
            jumps += 1
            if target >= lowest or jumps > MAX_JUMPS:
                raise Bad(f"name pointer {target} does not go back")
            after = at + 2 if after is None else after
            at = lowest = target
            continue
        need(data, at + 1, n, "label")
        labels.append(data[at + 1 : at + 1 + n].decode(errors="replace"))
        at += 1 + n
    return ".".join(labels), at if after is None else after


def ip4(b: bytes) -> str:
    return ".".join(map(str, b))


def ip6(b: bytes) -> str:
    import ipaddress

    return str(ipaddress.IPv6Address(b))


DNS = "query_name string, is_response boolean, record_type string, ttl long, resolved_ip string, ptr_record string, cname_chain array<string>, mx_records array<string>, ns_records array<string>, txt_records array<string>, srv_records array<string>, bindings array<struct<ip:string,domain:string>>, error string"


def dns(data: bytes) -> dict:
    need(data, 0, 12, "dns header")
    _, flags, qd, an, _, _ = struct.unpack(">6H", data[:12])
    out = {"is_response": bool(flags & 0x8000), "cname_chain": [], "mx_records": [], "ns_records": [], "txt_records": [], "srv_records": [], "bindings": []}
    try:
        _records(data, qd, an, out)
    except (Bad, IndexError) as e:  # what came before the bad record stays, bindings above all
        out["error"] = str(e)
    return out


def _records(data: bytes, qd: int, an: int, out: dict) -> None:
    """Questions and answers into ``out``."""
    at, question = 12, None
    for i in range(qd):
        name, at = dns_name(data, at)
        need(data, at, 4, "question")
        if i == 0:
            question = name
            out |= {"query_name": name, "record_type": DNS_TYPES.get(int.from_bytes(data[at : at + 2]), "UNKNOWN")}
        at += 4
    lists = {5: "cname_chain", 15: "mx_records", 2: "ns_records", 16: "txt_records", 33: "srv_records"}
    for _ in range(min(an, MAX_RECORDS)):
        owner, at = dns_name(data, at)
        need(data, at, 10, "record header")
        kind, _, ttl, size = struct.unpack(">HHIH", data[at : at + 10])
        at += 10
        need(data, at, size, "record data")
        end = at + size
        out.setdefault("ttl", ttl)
        value = None
        if kind in (1, 28):
            if size != (4 if kind == 1 else 16):
                raise Bad(f"address record of {size} bytes at offset {at}")
            ip = ip4(data[at:end]) if kind == 1 else ip6(data[at:end])
            if kind == 1 or "resolved_ip" not in out:
                out |= {"resolved_ip": ip, "record_type": DNS_TYPES[kind]}
            out["bindings"].append({"ip": ip, "domain": owner or question or ""})
        elif kind in (2, 5):
            value = dns_name(data, at)[0]
        elif kind == 12:
            out.setdefault("ptr_record", dns_name(data, at)[0])
        elif kind == 15:
            if size < 3:
                raise Bad(f"MX record of {size} bytes at offset {at}")
            value = dns_name(data, at + 2)[0]
        elif kind == 16:
            texts, x = [], at
            while x < end:
                n = data[x]
                if x + 1 + n > end:
                    texts = None
                    break
                texts.append(data[x + 1 : x + 1 + n].decode(errors="replace"))
                x += 1 + n
            value = None if texts is None else " ".join(texts)
        elif kind == 33:
            if size < 7:
                raise Bad(f"SRV record of {size} bytes at offset {at}")
            p, w, port = struct.unpack(">3H", data[at : at + 6])
            value = f"{p} {w} {port} {dns_name(data, at + 6)[0]}"
        if value is not None and len(out[lists[kind]]) < MAX_LIST:
            out[lists[kind]].append(value)
        at = end


TLS = "sni string, alpn string, alpn_protocols array<string>, session_resumed boolean, early_data boolean, ocsp boolean, ech boolean, legacy_version int, cipher_suites array<int>, extensions array<int>, groups array<int>, point_formats array<int>, ja3 string, version string, error string"


def tls_client_hello(data: bytes) -> dict | None:
    """Fields of a ClientHello with its fingerprint; None for other records."""
    out = _client_hello(data)
    if out is not None:
        out |= {"ja3": hashlib.md5(ja3_text(out).encode()).hexdigest(), "version": NEGOTIATED.get(out["legacy_version"], "UNKNOWN")}
    return out


def _client_hello(data: bytes) -> dict | None:
    need(data, 0, 5, "record header")
    if data[0] != 22 or data[1] != 3:
        return None
    size = int.from_bytes(data[3:5])
    need(data, 5, size, "record")
    need(data, 5, 4, "handshake header")
    if data[5] != 1:
        return None
    end = 9 + int.from_bytes(data[6:9])
    need(data, 9, end - 9, "handshake")
    body = data[:end]
    at = 9
    need(body, at, 35, "client hello")
    out = {"legacy_version": int.from_bytes(body[at : at + 2]), "session_resumed": False, "early_data": False, "ocsp": False, "ech": False, "alpn_protocols": [], "extensions": [], "groups": [], "point_formats": []}
    at += 34
    at += 1 + body[at]
    need(body, at, 2, "cipher suites")
    n = int.from_bytes(body[at : at + 2])
    need(body, at + 2, n, "cipher suites")
    out["cipher_suites"] = [int.from_bytes(body[i : i + 2]) for i in range(at + 2, at + 2 + n - n % 2, 2)]
    at += 2 + n
    need(body, at, 1, "compression")
    at += 1 + body[at]
    if at >= len(body):
        return out
    need(body, at, 2, "extensions")
    stop = at + 2 + int.from_bytes(body[at : at + 2])
    need(body, at + 2, stop - at - 2, "extensions")
    at += 2
    while at < stop:
        need(body[:stop], at, 4, "extension")
        kind, n = int.from_bytes(body[at : at + 2]), int.from_bytes(body[at + 2 : at + 4])
        need(body[:stop], at + 4, n, "extension")
        x = body[at + 4 : at + 4 + n]
        out["extensions"].append(kind)
        if kind == 0 and n >= 5 and x[2] == 0:
            size = int.from_bytes(x[3:5])
            need(x, 5, size, "server name")
            try:
                out["sni"] = x[5 : 5 + size].decode()
            except UnicodeDecodeError:
                raise Bad(f"server name at offset {at + 9} is not UTF-8") from None
        elif kind == 16 and n >= 2:
            i = 2
            while i < n and len(out["alpn_protocols"]) < MAX_LIST:
                need(x, i + 1, x[i], "protocol name")
                out["alpn_protocols"].append(x[i + 1 : i + 1 + x[i]].decode(errors="replace"))
                i += 1 + x[i]
        elif kind == 10:
            out["groups"] = [int.from_bytes(x[i : i + 2]) for i in range(2, n - 1, 2)]
        elif kind == 11:
            out["point_formats"] = list(x[1:])
        out["session_resumed"] |= (kind == 35 and n > 0) or kind == 41
        out["early_data"] |= kind == 42
        out["ocsp"] |= kind == 5
        out["ech"] |= kind == 0xFE0D
        at += 4 + n
    out["alpn"] = out["alpn_protocols"][0] if out["alpn_protocols"] else None
    return out


def ja3_text(hello: dict) -> str:
    """The published JA3 string: version, ciphers, extensions, groups, formats without GREASE."""
    real = lambda xs: "-".join(str(x) for x in xs if x & 0x0F0F != 0x0A0A or x >> 8 != x & 0xFF)
    return ",".join([str(hello["legacy_version"]), real(hello["cipher_suites"]), real(hello["extensions"]), real(hello["groups"]), "-".join(map(str, hello["point_formats"]))])


def ja3(tls: str = "tls") -> Column:
    """The JA3 fingerprint of a dissected ClientHello."""

    def text(v: pd.Series, c: pd.Series, e: pd.Series, g: pd.Series, p: pd.Series) -> pd.Series:
        names = ("legacy_version", "cipher_suites", "extensions", "groups", "point_formats")
        return pd.Series([None if x[0] is None or x[1] is None else ja3_text({n: (int(y) if n == names[0] else [int(z) for z in y]) for n, y in zip(names, x, strict=True)}) for x in zip(v, c, e, g, p, strict=True)])

    text.__annotations__ = {k: pd.Series for k in ("v", "c", "e", "g", "p", "return")}
    return F.md5(F.pandas_udf(text, "string")(*(f"{tls}.{n}" for n in ("legacy_version", "cipher_suites", "extensions", "groups", "point_formats"))))


def asn1(data: bytes, at: int) -> tuple[int, int, int]:
    """Tag, start and end of the element at an offset."""
    need(data, at, 2, "element")
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            raise Bad(f"length of {k} bytes at offset {at}")
        need(data, at, k, "length")
        n, at = int.from_bytes(data[at : at + k]), at + k
    return tag, at, min(at + n, len(data))


KERBEROS = "msg_type string, realm string, principal string, error_code long, error string"


def kerberos(data: bytes) -> dict | None:
    at = 4 if len(data) > 4 and data[0] not in KERBEROS_TAGS and data[4] in KERBEROS_TAGS else 0
    if len(data) <= at or data[at] not in KERBEROS_TAGS:
        return None
    out = {"msg_type": KERBEROS_TAGS[data[at]]}
    stack = [(at, min(len(data), at + 512))]
    while stack:
        at, end = stack.pop()
        if at + 2 > end:
            continue
        tag, begin, stop = asn1(data, at)
        stop = min(stop, end)
        stack.append((stop, end))
        if tag & 0x20:
            stack.append((begin, stop))
        elif tag == 0x1B:
            text = data[begin:stop].decode(errors="replace")
            realm = "." in text and all(c.isupper() or c.isdigit() or c in ".-" for c in text)
            out.setdefault("realm" if realm else "principal", text)
        elif tag == 2 and stop - begin <= 4 and out["msg_type"] == "KRB-ERROR":
            out.setdefault("error_code", int.from_bytes(data[begin:stop]))
    return out


LDAP = "message_id long, op string, bind_dn string, base_dn string, error string"


def ldap(data: bytes) -> dict | None:
    if len(data) < 2 or data[0] != 0x30:
        return None
    _, at, _ = asn1(data, 0)
    tag, begin, stop = asn1(data, at)
    if tag != 2:
        return None
    out = {"message_id": int.from_bytes(data[begin:stop])}
    op, begin, _ = asn1(data, stop)
    out["op"] = LDAP_OPS.get(op, "UNKNOWN")
    if op == 0x60:
        _, _, after = asn1(data, begin)
        tag, b, e = asn1(data, after)
        if tag == 4 and e > b:
            out["bind_dn"] = data[b:e][:256].decode(errors="replace")
    elif op == 0x63:
        tag, b, e = asn1(data, begin)
        if tag == 4 and e > b:
            out["base_dn"] = data[b:e][:256].decode(errors="replace")
    return out


DHCP6 = "msg_type string, client_duid string, assigned_ip string, error string"


def dhcp6(data: bytes) -> dict | None:
    from ..functions.names import DHCP6_TYPES

    if not data or data[0] not in DHCP6_TYPES:
        return None
    out = {"msg_type": DHCP6_TYPES[data[0]]}
    if data[0] in (12, 13):
        return out
    need(data, 0, 4, "dhcpv6 header")
    at = 4
    while at < len(data):
        need(data, at, 4, "option")
        kind, n = struct.unpack(">2H", data[at : at + 4])
        at += 4
        need(data, at, n, "option")
        if kind == 1:
            out["client_duid"] = data[at : at + n].hex(":")
        elif kind == 3 and n >= 12:
            x = at + 12
            while x + 4 <= at + n:
                sub, m = struct.unpack(">2H", data[x : x + 4])
                need(data[: at + n], x + 4, m, "option")
                if sub == 5 and m >= 24:
                    out["assigned_ip"] = ip6(data[x + 4 : x + 20])
                x += 4 + m
        at += n
    return out


def hpack_static() -> dict[int, tuple[str, str]]:
    """The static table of RFC 7541, appendix A."""
    # Fixed values, in their order.
    valued = [(":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https")]
    valued += [(":status", x) for x in ("200", "204", "206", "304", "400", "404", "500")]
    valued += [("accept-charset", ""), ("accept-encoding", "gzip, deflate")]
    names = "accept-language accept-ranges accept access-control-allow-origin age allow authorization cache-control content-disposition content-encoding content-language content-length content-location content-range content-type cookie date etag expect expires from host if-match if-modified-since if-none-match if-range if-unmodified-since last-modified link location max-forwards proxy-authenticate proxy-authorization range referer refresh retry-after server set-cookie strict-transport-security transfer-encoding user-agent vary via www-authenticate"
    return dict(enumerate([*valued, *((n, "") for n in names.split())], 1))


HTTP2 = "method string, scheme string, authority string, path string, status string, error string"


def http2(data: bytes) -> dict | None:
    """Pseudo headers of the first HEADERS frame; literals without Huffman coding."""
    preface = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
    at = len(preface) if data.startswith(preface) else 0
    static, out = hpack_static(), {}
    for _ in range(32):
        if at + 9 > len(data):
            break
        n, kind, flags = int.from_bytes(data[at : at + 3]), data[at + 3], data[at + 4]
        block = data[at + 9 : at + 9 + n]
        at += 9 + n
        if kind != 1:
            continue
        if flags & 8:
            block = block[1 : len(block) - block[0]] if block else block
        if flags & 0x20:
            block = block[5:]
        i = 0

        def integer(bits: int, i: int) -> tuple[int, int]:
            need(block, i, 1, "integer")
            v = block[i] & ((1 << bits) - 1)
            i += 1
            if v == (1 << bits) - 1:
                shift = 0
                while True:
                    need(block, i, 1, "integer")
                    v += (block[i] & 0x7F) << shift
                    shift += 7
                    i += 1
                    if not block[i - 1] & 0x80 or shift > 28:
                        break
            return v, i

        def string(i: int) -> tuple[str | None, int]:
            need(block, i, 1, "string")
            packed = block[i] & 0x80
            n, i = integer(7, i)
            need(block, i, n, "string")
            return None if packed else block[i : i + n].decode(errors="replace"), i + n

        while i < len(block):
            b = block[i]
            if b & 0x80:
                index, i = integer(7, i)
                name, value = static.get(index, (None, None))
            elif b & 0xE0 == 0x20:
                _, i = integer(5, i)
                continue
            else:
                index, i = integer(6 if b & 0x40 else 4, i)
                name = static.get(index, (None,))[0]
                if index == 0:
                    name, i = string(i)
                value, i = string(i)
            if name and value is not None and name.startswith(":"):
                out.setdefault(name[1:], value)
        return out
    return None


QUIC = "sni string, early_data boolean, error string"
# Versions whose first packets have the layout of RFC 9000, longest connection id, bytes searched for frames.
QUIC_LAYOUTS, MAX_CONNECTION_ID, MAX_FRAME_BYTES = (0x00000001, 0x6B3343CF, 0xFF00001D, 0xFF00001C, 0xFF00001B), 20, 4096


def quic_integer(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer and the offset after it; None where the data end before it does."""
    size = 1 << (data[at] >> 6) if at < len(data) else 1
    if at + size > len(data):
        return None, at
    return int.from_bytes(data[at : at + size]) & (1 << 8 * size - 2) - 1, at + size


def quic_initial(data: bytes) -> dict | None:
    """Server name in the CRYPTO data of an Initial packet, early data of a 0-RTT packet.

    Frames are read as they stand.  Protected ones are not decrypted: they give nothing, or
    the error of a CRYPTO frame that exceeds its datagram.  Packets cut short give nothing.
    """
    if len(data) < 6 or data[0] < 0xC0 or int.from_bytes(data[1:5]) not in QUIC_LAYOUTS:
        return None
    kind, at = data[0] >> 4 & 3, 5
    if kind:
        return {"early_data": True} if kind == 1 else None
    for what in ("DCID", "SCID"):
        if at == len(data):
            return None
        if data[at] > MAX_CONNECTION_ID:
            raise Bad(f"{what} of {data[at]} bytes at offset {at}")
        need(data, at + 1, data[at], what)
        at += 1 + data[at]
    token, at = quic_integer(data, at)
    if token is None or at + token > len(data):
        return None
    length, at = quic_integer(data, at + token)
    at += 1 + (data[0] & 3)  # the packet number
    return None if length is None else _crypto(data, at, at + MAX_FRAME_BYTES)


def _crypto(data: bytes, at: int, stop: int) -> dict | None:
    """The first CRYPTO frame; padding and pings are passed over, of other frames one integer."""
    while at < min(stop, len(data)):
        kind, at = data[at], at + 1
        if kind < 2:
            continue
        value, at = quic_integer(data, at)
        if kind == 6 and value is not None:
            value, at = quic_integer(data, at)
        if value is None:
            return None
        if kind == 6:
            need(data, at, value, "CRYPTO frame")
            return {"sni": _bare_hello_name(data[at : at + value])}
    return None


def _bare_hello_name(hello: bytes) -> str | None:
    """The server name of a ClientHello with or without record header, null if it is cut or odd."""
    if hello[:1] != b"\x16":
        hello = b"\x16\x03\x01" + len(hello).to_bytes(2) + hello
    try:
        return ((_client_hello(hello) or {}).get("sni")) or None
    except (Bad, IndexError):
        return None


DISSECTORS: dict[str, tuple[Callable, str]] = {"dns": (dns, DNS), "tls": (tls_client_hello, TLS), "kerberos": (kerberos, KERBEROS), "ldap": (ldap, LDAP), "dhcp6": (dhcp6, DHCP6), "http2": (http2, HTTP2), "quic": (quic_initial, QUIC)}


def dissect(df: DataFrame, name: str, payload: str = "payload") -> DataFrame:
    """Adds a struct column of the dissector's name; any bytes are accepted."""
    small_batches(df.sparkSession)
    parse, fields = DISSECTORS[name]
    struct_type = _parse_datatype_string(fields)
    schema = StructType([*df.schema.fields]).add(name, struct_type)
    place = df.columns.index(payload)
    arrow = to_arrow_schema(schema).field(name).type

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(place).to_pylist():
                try:
                    out.append(None if x is None else parse(bytes(x)))
                except (Bad, IndexError) as e:
                    out.append({"error": str(e)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


SERVER = "version string, cipher int, alpn string, error string"
# Fixed values.
NEGOTIATED = {0x0301: "TLS1.0", 0x0302: "TLS1.1", 0x0303: "TLS1.2", 0x0304: "TLS1.3"}


def tls_server_hello(data: bytes) -> dict | None:
    """Cipher, negotiated version and protocol of a ServerHello."""
    need(data, 0, 9, "record")
    if data[0] != 22 or data[5] != 2:
        return None
    at = 9 + 34
    need(data, at, 1, "session id")
    at += 1 + data[at]
    need(data, at, 3, "cipher suite")
    out = {"cipher": int.from_bytes(data[at : at + 2])}
    at += 3
    if at + 2 > len(data):
        return out
    stop = at + 2 + int.from_bytes(data[at : at + 2])
    need(data, at, stop - at, "extensions")
    at += 2
    while at + 4 <= stop:
        kind, n = int.from_bytes(data[at : at + 2]), int.from_bytes(data[at + 2 : at + 4])
        x = data[at + 4 : min(at + 4 + n, stop)]
        if kind == 43 and n >= 2:
            out["version"] = NEGOTIATED.get(int.from_bytes(x[:2]), "UNKNOWN")
        elif kind == 16 and n > 3:
            out["alpn"] = x[3 : 3 + x[2]].decode(errors="replace")
        at += 4 + n
    return out


CERTIFICATE = "certificates int, subject_cn string, issuer_cn string, sans array<string>, not_after string, self_signed boolean, error string"
_CN, _SAN = bytes.fromhex("550403"), bytes.fromhex("551d11")


def _children(data: bytes, begin: int, end: int):
    while begin < end:
        tag, b, e = asn1(data, begin)
        yield tag, b, e, begin
        begin = e


def _common_name(data: bytes, begin: int, end: int) -> str | None:
    found = None
    for _, b, e, _ in _children(data, begin, end):
        for _, b2, e2, _ in _children(data, b, e):
            parts = list(_children(data, b2, e2))
            if len(parts) == 2 and data[parts[0][1] : parts[0][2]] == _CN:
                found = sanitize(data[parts[1][1] : parts[1][2]].decode(errors="replace"))
    return found


def sanitize(text: str) -> str:
    """Without control characters, others than ASCII as ``?``, 256 characters at most."""
    return "".join(c if c.isascii() else "?" for c in text if c.isprintable() or not c.isascii())[:256]


def certificate(data: bytes) -> dict | None:
    """The first certificate of a TLS Certificate message and how many there are (8 at most are counted)."""
    need(data, 0, 12, "record")
    if data[0] != 22 or data[5] != 11:
        return None
    stop = min(len(data), 12 + int.from_bytes(data[9:12]))
    at, certs = 12, []
    while at + 3 <= stop and len(certs) < 8:
        n = int.from_bytes(data[at : at + 3])
        need(data, at + 3, n, "certificate")
        certs.append(data[at + 3 : at + 3 + n])
        at += 3 + n
    out = {"certificates": len(certs), "sans": []}
    if not certs:
        return out
    c = certs[0]
    _, b, _ = asn1(c, 0)
    _, b, e = asn1(c, b)
    fields = [f for f in _children(c, b, e)]
    fields = fields[1:] if fields and fields[0][0] == 0xA0 else fields
    if len(fields) < 6:
        raise Bad(f"certificate of {len(fields)} fields")
    _, _, issuer, validity, subject = fields[:5]
    out["issuer_cn"] = _common_name(c, issuer[1], issuer[2])
    out["subject_cn"] = _common_name(c, subject[1], subject[2])
    out["self_signed"] = c[issuer[3] : issuer[2]] == c[subject[3] : subject[2]]
    times = list(_children(c, validity[1], validity[2]))
    if len(times) == 2:
        out["not_after"] = c[times[1][1] : times[1][2]].decode(errors="replace")
    for tag, b, e, _ in fields[6:]:
        if tag != 0xA3:
            continue
        _, b, e = asn1(c, b)
        for _, b2, e2, _ in _children(c, b, e):
            parts = list(_children(c, b2, e2))
            if parts and c[parts[0][1] : parts[0][2]] == _SAN:
                _, b3, e3 = asn1(c, parts[-1][1])
                out["sans"] = [sanitize(c[x:y].decode(errors="replace")) for t, x, y, _ in _children(c, b3, e3) if t == 0x82][:MAX_LIST]
    return out


DISSECTORS |= {"server": (tls_server_hello, SERVER), "certificate": (certificate, CERTIFICATE)}


def dissect_each(df: DataFrame, gates: dict[str, tuple[str, Column]], payload: str = "payload") -> DataFrame:
    """Adds a struct column for each gate (column name: dissector, condition) in one Arrow pass.

    A row is read by every dissector whose condition holds; the struct is null otherwise.
    """
    small_batches(df.sparkSession)
    place, old = df.columns.index(payload), len(df.columns)
    df = df.withColumns({f"_{name}": F.coalesce(when, F.lit(False)) for name, (_, when) in gates.items()})
    schema = StructType(df.schema.fields[:old])
    for name, (kind, _) in gates.items():
        schema = schema.add(name, _parse_datatype_string(DISSECTORS[kind][1]))
    arrow = [to_arrow_schema(schema).field(name).type for name in gates]
    parsers = [DISSECTORS[kind][0] for kind, _ in gates.values()]

    def run(batches):
        for b in batches:
            data = b.column(place)
            columns = list(b.columns[:old])
            for i, (parse, type_) in enumerate(zip(parsers, arrow, strict=True)):
                out: list = [None] * b.num_rows
                for at in np.flatnonzero(b.column(old + i).to_numpy(zero_copy_only=False)).tolist():
                    try:
                        out[at] = parse(data[at].as_py() or b"")
                    except (Bad, IndexError) as e:
                        out[at] = {"error": str(e)}
                columns.append(pa.array(out, type=type_))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)
