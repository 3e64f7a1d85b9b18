"""Header decode of whole Arrow batches with numpy; same columns as the expression form in decode.py.

Reading an integer from bytes costs several string functions in SQL, and a frame
has some forty of them.  Here each is one gather over all frames of a batch.
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from ..plans.stage import small_batches

ADDED = "error string, protocol string, src_mac string, src_ip string, dst_ip string, src_port int, dst_port int, tcp_seq long, packet_size int, payload binary"
ERRORS = ("ethernet header incomplete", "ipv4 header incomplete", "ipv4 header invalid", "ipv6 header incomplete", "ipv6 header invalid", "transport header incomplete", "tcp header invalid")
PROTOCOLS = ("TCP", "UDP", "ICMP", "ICMPv6")


def _named(index: np.ndarray, names) -> pa.Array:
    """Strings by index; -1 is null."""
    return pa.DictionaryArray.from_arrays(pa.array(index, pa.int32(), mask=index < 0), pa.array(names, pa.string())).cast(pa.string())


def _texts(values: np.ndarray, valid: np.ndarray, text) -> pa.Array:
    """Texts of the valid rows; each distinct value is formatted once."""
    distinct, which = np.unique(values[valid], axis=0, return_inverse=True)
    index = np.full(len(valid), -1, np.int32)
    index[valid] = which.ravel()
    return _named(index, [text(v) for v in distinct])


def decode(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, wire: np.ndarray, with_payload: bool = True) -> list[pa.Array]:
    n = len(begin)
    padded = np.concatenate([buf, np.zeros(64, np.uint8)])

    def g(offset, k: int) -> np.ndarray:
        """Big-endian integers; -1 past the end of a frame."""
        offset = np.broadcast_to(offset, n)
        ok = offset + k <= size
        at = np.where(ok, begin + offset, 0)
        out = np.zeros(n, np.int64)
        for i in range(k):
            out = out << 8 | padded[at + i]
        return np.where(ok, out, -1)

    def octets(offset, k: int) -> np.ndarray:
        at = np.minimum(begin + np.broadcast_to(offset, n), len(buf))
        return padded[at[:, None] + np.arange(k)]

    kind = g(12, 2)
    vlan = kind == 0x8100
    net = np.where(vlan, 18, 14)
    kind = np.where(vlan, g(16, 2), kind)
    first = g(net, 1)
    v4 = (kind == 0x0800) & (first >> 4 == 4)
    v6 = (kind == 0x86DD) & (first >> 4 == 6)
    ip = v4 | v6
    head = np.where(v4, (first & 15) * 4, 40)
    proto = np.where(v4, g(net + 9, 1), np.where(v6, g(net + 6, 1), -1))
    total = np.where(v4, g(net + 2, 2), np.where(v6, g(net + 4, 2), -1))
    stop = np.where(total >= 0, net + total + np.where(v6, 40, 0), size)
    l4 = np.where(ip, net + head, 0)
    tcp, udp = proto == 6, proto == 17
    icmp4, icmp6 = (proto == 1) & v4, (proto == 58) & v6
    data_at = g(l4 + 12, 1)
    tcp_head = np.where(tcp & (data_at >= 0), (data_at >> 4) * 4, 20)
    least = np.select([tcp, udp, (proto == 1) | (proto == 58)], [20, 8, 8], 0)
    checks = [
        size < 14,
        (kind == 0x0800) & ((size < net + 20) | (ip & (size < l4))),
        (kind == 0x0800) & (~v4 | (head < 20)),
        (kind == 0x86DD) & (size < net + 40),
        (kind == 0x86DD) & ~v6,
        ip & (size < l4 + least),
        tcp & ((tcp_head < 20) | (size < l4 + tcp_head)),
    ]
    error = np.select(checks, range(len(checks)), -1)
    fine = ip & (error < 0)
    protocol = np.where(fine, np.select([tcp, udp, icmp4, icmp6], range(4), -1), -1)
    known, ported = protocol >= 0, (protocol == 0) | (protocol == 1)
    start = np.select([protocol == 0, protocol == 1], [l4 + tcp_head, l4 + 8], l4)
    end = np.maximum(np.minimum(stop, size), start)
    payload: list = []
    if with_payload:
        raw = buf.tobytes()
        payload = [raw[a:b] if k else None for a, b, k in zip((begin + start).tolist(), (begin + end).tolist(), known.tolist(), strict=True)]
    addresses = []
    for at4, at6 in ((net + 12, net + 8), (net + 16, net + 24)):
        x = np.zeros((n, 17), np.uint8)
        x[:, 0] = np.where(v4, 4, 6)
        x[:, 1:5] = octets(at4, 4)
        six = fine & v6
        if six.any():
            x[six, 1:] = octets(at6, 16)[six]
        addresses.append(_texts(x, fine, lambda v: ".".join(map(str, v[1:5])) if v[0] == 4 else str(ipaddress.IPv6Address(v[1:].tobytes()))))
    port = lambda offset: pa.array(np.where(ported, g(l4 + offset, 2), 0), pa.int32(), mask=~known)
    return [
        _named(error.astype(np.int32), ERRORS),
        _named(protocol.astype(np.int32), PROTOCOLS),
        _texts(octets(6, 6), size >= 14, lambda v: v.tobytes().hex(":")),
        *addresses,
        port(0),
        port(2),
        pa.array(g(l4 + 4, 4), pa.int64(), mask=protocol != 0),
        pa.array(wire, pa.int32()),
        pa.array(payload, pa.binary()) if with_payload else pa.nulls(n, pa.binary()),
    ]


def decode_frames(frames: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    small_batches(frames.sparkSession)
    place, wire = frames.columns.index("frame"), frames.columns.index("wire_len")
    every = [*frames.schema.fields, *_parse_datatype_string(ADDED).fields]
    kept = [i for i, f in enumerate(every) if f.name not in without]
    schema = StructType([every[i] for i in kept])
    names = schema.names

    def run(batches):
        for b in batches:
            column = b.column(place)
            column = column.fill_null(b"")
            wide = pa.types.is_large_binary(column.type)
            _, offsets, data = column.buffers()
            o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
            buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
            out = [*b.columns, *decode(buf, o[:-1] - o[0], np.diff(o), b.column(wire).to_numpy(zero_copy_only=False), "payload" not in without)]
            yield pa.RecordBatch.from_arrays([out[i] for i in kept], names=names)

    return frames.mapInArrow(run, schema)
