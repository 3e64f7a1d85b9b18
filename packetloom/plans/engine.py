"""The whole plan: packets to ordered events.

Frames are decoded and numbered into one table.  Payloads that pass the gate of a
dissector (TCP ones after reassembly) go through one Arrow pass into a second
table, from which all protocol events and bindings are read; a third one orders the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dissect import fixed
from ..dissect.pointers import dissect_each
from ..operators import attribution, events, filters, flows, tcp
from ..operators.decode import decode_frames, device_first_seen, flow_id, number_frames
from .config import Config
from .stage import table

#: Ports of the dissectors that have no setting.
DHCP4_PORTS, DHCP6_PORTS, SMB_PORTS, MDNS_PORTS, KERBEROS_PORTS, LDAP_PORTS = (67, 68), (546, 547), (445, 139), (5353,), (88,), (389, 3268)
BASE = ("packet_id", "timestamp_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "payload")


def decoded_packets(frames: DataFrame, c: Config, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all decoded frames, numbered packets after the filters)."""
    if c.packet_limit:
        frames = frames.where(F.col("frame_no") <= c.packet_limit)
    # By the greatest number the ranges are known; a sample would decode all frames once more.
    if top is None:
        top = frames.agg(F.max("frame_no")).first()[0] or 0
    packets, decoded = number_frames(decode_frames(frames, without=("frame",)), top)
    return decoded, filters.filter_packets(packets.withColumn("payload_len", F.octet_length("payload")), c.filters)


def port_in(ports) -> Column:
    return F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)


def gates(c: Config) -> tuple[dict[str, tuple[str, Column]], dict[str, Column]]:
    """Conditions of the dissectors that run in Arrow batches (column: dissector, condition) and of those in expressions."""
    is_tcp, is_udp, g = F.col("protocol") == "TCP", F.col("protocol") == "UDP", c.gates
    tls = is_tcp & (port_in(c.tls_ports) | F.startswith(F.hex(F.substring("payload", 1, 2)), F.lit("1603")))
    h2 = is_tcp & port_in(c.http_ports) & F.startswith(F.hex(F.substring("payload", 1, 14)), F.lit(b"PRI * HTTP/2.0".hex().upper()))
    batches = {
        "dns": (g.dns, "dns", port_in(c.dns_ports)),
        "mdns": (g.mdns, "dns", is_udp & port_in(MDNS_PORTS)),
        "tls": (g.tls, "tls", tls),
        "server": (g.tls, "server", tls & (F.hex(F.substring("payload", 6, 1)) == "02")),
        "http2": (g.http, "http2", h2),
        "dhcp6": (g.dhcp, "dhcp6", is_udp & port_in(DHCP6_PORTS)),
        "initial": (g.quic, "quic", is_udp & port_in(c.quic_ports) & (F.hex(F.substring("payload", 1, 1)) >= "C0")),
        "kerberos": (g.enterprise, "kerberos", port_in(KERBEROS_PORTS)),
        "ldap": (g.enterprise, "ldap", is_tcp & port_in(LDAP_PORTS)),
    }
    plain = {
        "quic": (g.quic, is_udp & port_in(c.quic_ports)),
        "http": (g.http, is_tcp & port_in(c.http_ports)),
        "dhcp": (g.dhcp, is_udp & port_in(DHCP4_PORTS)),
        "smb": (g.smb, is_tcp & port_in(SMB_PORTS)),
        "icmp": (g.icmp, F.col("protocol").isin("ICMP", "ICMPv6")),
    }
    return {k: (kind, when) for k, (on, kind, when) in batches.items() if on}, {k: when for k, (on, when) in plain.items() if on}


def icmp_of_both(df: DataFrame) -> DataFrame:
    """ICMP and ICMPv6 in one column."""
    both = fixed.icmp(fixed.icmp(df, True).withColumnRenamed("icmp", "_six"))
    return both.withColumn("icmp", F.when(F.col("protocol") == "ICMPv6", F.col("_six")).otherwise(F.col("icmp"))).drop("_six")


FIXED = {"quic": fixed.quic, "http": fixed.http1, "dhcp": fixed.dhcp4_fixed, "smb": fixed.smb, "icmp": icmp_of_both}


def only_where(df: DataFrame, add, when: Column) -> DataFrame:
    """A dissector in expressions that sees the payloads of gated rows alone."""
    df = df.withColumn("_whole", F.col("payload")).withColumn("payload", F.when(when, F.col("payload")))
    return add(df).withColumn("payload", F.col("_whole")).drop("_whole")


def payloads(packets: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """(what dissectors read, TCP streams that were given up).

    Segments on a gated port are put in order first: a row carries what its segment
    delivers, retransmitted ones and those that wait carry nothing and go.  A
    segment on another port that begins a TLS record is read as it is.
    """
    batches, plain = gates(c)
    any_ = F.lit(False)
    for when in [*(w for _, w in batches.values()), *plain.values()]:
        any_ = any_ | when
    rows = packets.where("payload_len > 0").where(any_)
    ports = (*c.dns_ports, *c.tls_ports, *c.http_ports, *SMB_PORTS, *KERBEROS_PORTS, *LDAP_PORTS)
    streamed = (F.col("protocol") == "TCP") & port_in(ports)
    stream = F.concat_ws("|", "src_ip", F.col("src_port").cast("string"), "dst_ip", F.col("dst_port").cast("string"))
    keep = tuple(x for x in BASE if x not in ("packet_id", "payload"))
    segments = rows.where(streamed).withColumn("stream", stream).withColumn("seq", F.col("tcp_seq"))
    put = tcp.reassemble(segments, keep=keep)
    whole = put.where("state in ('assembled', 'reset')").select(*(F.col("delivered").alias("payload") if x == "payload" else x for x in BASE), "state")
    every = rows.where(~streamed).select(*BASE, F.lit("whole").alias("state")).unionByName(whole)
    found = dissect_each(every, batches) if batches else every
    for name, when in plain.items():
        found = only_where(found, FIXED[name], when)
    found = table(found.drop("payload"), "payloads")
    return found.where("state <> 'reset'"), found.where("state = 'reset'")


def bindings(rows: DataFrame, c: Config) -> DataFrame:
    """packet_id, ip, domain: addresses that DNS answers, pointer records, leases and announcements name."""
    parts = []
    if c.gates.dns:
        parts.append(rows.select("packet_id", F.explode("dns.bindings").alias("b")).select("packet_id", "b.ip", "b.domain"))
        parts.append(rows.where("dns.is_response and dns.ptr_record is not null").select("packet_id", F.col("src_ip").alias("ip"), F.col("dns.ptr_record").alias("domain")))
    if c.gates.dhcp:
        lease = rows.where("dhcp.msg_type in ('ACK', 'OFFER') and dhcp.assigned_ip is not null")
        parts.append(lease.select("packet_id", F.col("dhcp.assigned_ip").alias("ip"), F.coalesce("dhcp.hostname", "dhcp.client_mac", F.lit("dhcp-device")).alias("domain")))
    if c.gates.mdns:
        parts.append(rows.where("mdns.is_response and mdns.error is null and mdns.record_type in ('A', 'AAAA')").select("packet_id", F.col("src_ip").alias("ip"), F.col("mdns.query_name").alias("domain")))
    out = rows.sparkSession.createDataFrame([], "packet_id long, ip string, domain string")
    for p in parts:
        out = out.unionByName(p)
    return out


#: Protocol names in parse errors.
ERRORS = {"dns": "DNS", "mdns": "mDNS", "tls": "TLS", "server": "TLS", "http2": "HTTP", "dhcp6": "DHCPv6", "initial": "QUIC", "kerberos": "KERBEROS", "ldap": "LDAP"}


def protocol_events(rows: DataFrame, c: Config) -> DataFrame:
    """Events and parse errors of the dissected payloads: one pass, each row gives those it has."""
    batches, plain = gates(c)
    found = []

    def add(when, type_, protocol, name, **values):
        found.append(events.one(F.expr(when), type_, protocol, events.ORDINALS[name], F.col("flow"), **values))

    if "dns" in batches:
        add("dns.query_name is not null and dns.error is null", F.when(F.col("dns.is_response"), "dns.response").otherwise("dns.query"), "DNS", "dns", query_name="dns.query_name", record_type="dns.record_type", resolved_ip="dns.resolved_ip", ttl="dns.ttl", is_response="dns.is_response")
    if "tls" in batches:
        add("tls.sni is not null", "tls.client_hello", "TLS", "tls.client_hello", sni="tls.sni", alpn="tls.alpn", session_resumed="tls.session_resumed", ja3="tls.ja3", tls_version="tls.version")
        add("server.cipher is not null", "tls.server_hello", "TLS", "tls.server_hello", cipher_suites="server.cipher", tls_version="server.version", alpn="server.alpn")
    if "quic" in plain:
        add("quic.version is not null", "quic.sni", "QUIC", "quic.sni", sni="initial.sni", quic_version="quic.version")
    if "http" in plain:
        add("http.method is not null", "http.request", "HTTP", "http.request", method="http.method", uri="http.uri", http_version="http.version", host="http.host", user_agent="http.user_agent", content_type="http.content_type", content_length="http.content_length")
        add("http.status is not null", "http.response", "HTTP", "http.response", status_code="http.status", http_version="http.version", content_type="http.content_type", content_length="http.content_length")
        add("http2.method is not null", "http.request", "HTTP", "http.request", method="http2.method", uri="http2.path", http_version="'HTTP/2'", host="http2.authority")
        add("http2.status is not null", "http.response", "HTTP", "http.response", status_code="http2.status", http_version="'HTTP/2'")
    if "dhcp" in plain:
        add("dhcp.msg_type is not null", "dhcp.message", "DHCP", "dhcp.message", msg_type="dhcp.msg_type", client_mac="dhcp.client_mac", hostname="dhcp.hostname", assigned_ip="dhcp.assigned_ip", requested_ip="dhcp.requested_ip", vendor_class="dhcp.vendor_class")
        add("dhcp6.msg_type is not null", "dhcp.message", "DHCP", "dhcp.message", msg_type="dhcp6.msg_type", client_mac="dhcp6.client_duid", assigned_ip="dhcp6.assigned_ip")
    if "icmp" in plain:
        add("icmp is not null", "icmp.message", "ICMP", "icmp.message", icmp_type="icmp.type", icmp_code="icmp.code", description="icmp.description", src_ip="src_ip", dst_ip="dst_ip")
    if "smb" in plain:
        add("smb is not null", "smb.session", "SMB", "smb.session", command="smb.command", status="smb.status", smb_version="smb.version", src_ip="src_ip", dst_ip="dst_ip")
    if "mdns" in batches:
        add("mdns.query_name is not null and mdns.error is null", "mdns.record", "mDNS", "mdns.record", query_name="mdns.query_name", is_response="mdns.is_response", record_type="mdns.record_type", src_ip="src_ip")
    if c.parse_errors:
        found += [events.one_error(f"{name}.error", ERRORS[name]) for name in batches]
    return events.spread(rows.withColumn("flow", flow_id()), found)


def run(frames: DataFrame, c: Config, top: int | None = None) -> DataFrame:
    """Ordered events of a capture; rows with an ``error`` of the capture itself become events too.

    ``top``, the greatest frame_no if it is known, saves a pass over the frames.
    """
    parts = []
    if "error" in frames.columns:
        parts.append(events.capture_errors(frames))
        frames = frames.where("error is null").drop("error")
    decoded, packets = decoded_packets(frames, c, top)
    keyed = flows.with_flow_key(packets.drop("payload"))
    sessions = flows.sessions_by_gap(keyed, c.idle_us) if c.sessions == "gap" else flows.sessions_by_sweep(keyed, c.idle_us, c.sweep_every)
    counted = flows.running_counters(sessions)
    parts.append(events.device_events(device_first_seen(decoded)))
    rows, given_up = payloads(packets, c)
    places = packets.select(F.col("dst_ip").alias("ip"), "packet_id")
    counted = attribution.as_of(counted.withColumn("ip", F.col("dst_ip")), bindings(rows, c), places=places).drop("ip")
    if c.domain_filter:
        counted = filters.filter_domain(counted, c.domain_filter)
    parts += [events.flow_events(counted, c.flow_updates), protocol_events(rows, c)]
    if c.parse_errors:
        parts.append(events.parse_errors(decoded.withColumn("packet_id", F.col("frame_no")), "FRAME", "error"))
        parts.append(events.parse_errors(given_up.withColumn("reason", F.lit("too many bytes out of order")), "TCP", "reason"))
    return events.ordered(*parts, top=decoded.agg(F.max("frame_no")).first()[0] or 0)
