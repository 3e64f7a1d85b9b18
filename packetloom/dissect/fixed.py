"""Dissectors of fixed layouts and text lines, in built-in expressions only.

Each function takes a frame with a binary ``payload`` and adds one struct column;
the struct is null where the payload is not of the protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bytes import ipv4_text, ipv6_text, mac_text, slice_, u, u_le
from ..functions.names import DHCP4_TYPES, FTP_COMMANDS, HTTP_METHODS, NT_STATUS, QUIC_VERSIONS, RDP_SECURITY, SMB1_COMMANDS, SMB2_COMMANDS, icmp_description, name_of

P = "payload"


def icmp(df: DataFrame, v6: bool = False, tunnel: int = 128) -> DataFrame:
    """type, code, description, and whether an echo carries more than ``tunnel`` bytes."""
    size = F.octet_length(P)
    t, c = u(P, 0, 1), u(P, 1, 1)
    echo = t.isin(128, 129) if v6 else t.isin(0, 8)
    return df.withColumn("icmp", F.when(size >= 4, F.struct(t.alias("type"), c.alias("code"), icmp_description(t, c, v6).alias("description"), (echo & (size - 8 > tunnel)).alias("tunnel"))))


def smb(df: DataFrame) -> DataFrame:
    """version, command, status and response flag behind a NetBIOS session header."""
    magic = F.hex(slice_(P, 4, 4))
    session = (u(P, 0, 1) == 0) & (u(P, 1, 3) > 0)
    two = F.struct(
        F.when((u_le(P, 16, 2) == 0) & (u_le(P, 20, 4) % 2 == 1), "SMB2/3").otherwise("SMB2").alias("version"),
        name_of(u_le(P, 16, 2).cast("int"), dict(enumerate(SMB2_COMMANDS)), "UNKNOWN").alias("command"),
        name_of(u_le(P, 12, 4), {k: v for k, v in NT_STATUS.items()}, "STATUS_UNKNOWN").alias("status"),
        (u_le(P, 20, 4) % 2 == 1).alias("response"),
    )
    one = F.struct(
        F.lit("SMB1").alias("version"),
        name_of(u(P, 8, 1).cast("int"), SMB1_COMMANDS, "UNKNOWN").alias("command"),
        name_of(u_le(P, 9, 4), NT_STATUS, "STATUS_UNKNOWN").alias("status"),
        (F.floor(u(P, 13, 1) / 128) == 1).alias("response"),
    )
    size = F.octet_length(P)
    return df.withColumn("smb", F.when(session & (magic == "FE534D42") & (size >= 24), two).when(session & (magic == "FF534D42") & (size >= 14), one))


def smb_share(df: DataFrame) -> DataFrame:
    """The path of a tree-connect request (UTF-16LE, as ASCII) and whether the share is an administrative one."""
    at, size = u_le(P, 72, 2), u_le(P, 74, 2)
    text = F.regexp_replace(F.decode(slice_(P, F.lit(4) + at.cast("int"), size.cast("int")), "UTF-16LE"), "[^ -~]", "?")
    ok = (F.hex(slice_(P, 4, 4)) == "FE534D42") & (u_le(P, 16, 2) == 3) & (u_le(P, 20, 4) % 2 == 0) & (size > 0)
    return df.withColumn("share", F.when(ok, F.struct(text.alias("path"), F.endswith(text, F.lit("$")).alias("admin"))))


def quic(df: DataFrame) -> DataFrame:
    """Long header: version number and name, packet type, connection ids; short headers only say so."""
    first = u(P, 0, 1)
    long_ = first >= 128
    version = u(P, 1, 4)
    d = u(P, 5, 1).cast("int")
    s = u(P, d + 6, 1).cast("int")
    ok = (F.octet_length(P) >= 6) & (F.floor(first / 64) % 2 == 1)
    token_at = d + 7 + s
    return df.withColumn(
        "quic",
        F.when(
            ok,
            F.struct(
                (~long_).alias("short"),
                F.when(long_, name_of(version, QUIC_VERSIONS, "unknown")).alias("version"),
                F.when(long_ & (version != 0), (F.floor(first / 16) % 4).cast("int")).alias("type"),
                F.when(long_ & (d <= 20), F.lower(F.hex(slice_(P, 6, d)))).alias("dcid"),
                F.when(long_ & (d <= 20) & (s <= 20), F.lower(F.hex(slice_(P, d + 7, s)))).alias("scid"),
                F.when(long_ & (d <= 20) & (s <= 20), varint(P, token_at)).alias("token_length"),
            ),
        ),
    )


def varint(data, offset: Column) -> Column:
    """RFC 9000 variable-length integer at an offset (values of up to 62 bits)."""
    first = u(data, offset, 1)
    kind = F.floor(first / 64)
    low4 = u(data, offset + 4, 4)
    return (
        F.when(kind == 0, first)
        .when(kind == 1, u(data, offset, 2) - (1 << 14))
        .when(kind == 2, u(data, offset, 4) - (1 << 31))
        .when(kind == 3, (u(data, offset, 4) - (3 << 30)) * F.lit(1 << 32) + low4)
    ).cast("long")


def text_of(data=P) -> Column:
    """The payload as text, null when it is not UTF-8."""
    return F.try_validate_utf8(F.col(data).cast("string"))


def header(lines: Column, name: str) -> Column:
    """Value of the first header line of that name (any case)."""
    hit = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(name + ":")))
    return F.nullif(F.trim(F.substr(F.get(hit, F.lit(0)), F.lit(len(name) + 2))), F.lit(""))


def http1(df: DataFrame) -> DataFrame:
    """First line and the usual headers of an HTTP/1 request or response."""
    df = df.withColumn("_text", text_of()).withColumn("_lines", F.split(F.split(F.col("_text"), "\r?\n\r?\n", 2)[0], "\r?\n"))
    first = F.split(F.col("_lines")[0], " ", 3)
    response = F.startswith(first[0], F.lit("HTTP/"))
    request = first[0].isin(*HTTP_METHODS) & (F.size(first) == 3) & (F.length(first[1]) <= 8192)
    status = F.get(first, F.lit(1)).try_cast("int")
    heads = F.slice(F.col("_lines"), 2, 100)
    host = header(heads, "host")
    df = df.withColumn(
        "http",
        F.when(
            request | (response & status.between(100, 599)),
            F.struct(
                F.when(~response, first[0]).alias("method"),
                F.when(~response, first[1]).alias("uri"),
                F.when(response, first[0]).otherwise(F.get(first, F.lit(2))).alias("version"),
                F.when(response, status).alias("status"),
                F.when(response, F.concat(F.floor(status / 100), F.lit("xx"))).alias("status_class"),
                F.when(F.length(host) <= 253, host).alias("host"),
                F.left(header(heads, "user-agent"), F.lit(512)).alias("user_agent"),
                F.left(header(heads, "content-type"), F.lit(256)).alias("content_type"),
                header(heads, "content-length").try_cast("long").alias("content_length"),
                F.left(header(heads, "referer"), F.lit(1024)).alias("referer"),
            ),
        ),
    )
    return df.drop("_text", "_lines")


def ssdp(df: DataFrame) -> DataFrame:
    """Method, search target, device type, USN and location of an SSDP message."""
    df = df.withColumn("_lines", F.split(F.split(text_of(), "\r?\n\r?\n", 2)[0], "\r?\n"))
    heads = F.slice("_lines", 2, 31)
    target = F.coalesce(header(heads, "st"), header(heads, "nt"))
    method = F.nullif(F.split(F.ltrim(F.col("_lines")[0]), r"\s+", 2)[0], F.lit(""))
    return df.withColumn("ssdp", F.when(method.isNotNull(), F.struct(method.alias("method"), target.alias("target"), F.when(F.contains(target, F.lit(":device:")), target).alias("device_type"), header(heads, "usn").alias("usn"), F.left(header(heads, "location"), F.lit(512)).alias("location")))).drop("_lines")


def ftp(df: DataFrame) -> DataFrame:
    """Command (passwords are never kept), response code and passive address of an FTP line."""
    line = F.trim(F.split(text_of(), "\r?\n", 2)[0])
    code = F.when(line.rlike("^[0-9]{3}"), F.left(line, F.lit(3)).cast("int"))
    parts = F.split(line, " ", 2)
    command = F.upper(parts[0])
    known = code.isNull() & command.isin(*FTP_COMMANDS)
    argument = F.trim(F.get(parts, F.lit(1)))
    inner = F.split(F.regexp_extract(line, r"\(([^)]*)\)", 1), r"\s*,\s*")
    numbers = F.transform(inner, lambda x: F.trim(x).try_cast("int"))
    passive = F.when((code == 227) & (F.size(inner) == 6) & ~F.exists(F.slice(numbers, 1, 4), lambda x: x.isNull() | (x < 0) | (x > 255)), F.concat(F.array_join(F.slice(numbers, 1, 4).cast("array<string>"), "."), F.lit(":"), F.coalesce(numbers[4], F.lit(0)) * 256 + F.coalesce(numbers[5], F.lit(0))))
    full = F.when(command == "PASS", "PASS").otherwise(F.concat_ws(" ", command, F.nullif(argument, F.lit(""))))
    return df.withColumn("ftp", F.when(code.isNotNull() | known, F.struct(F.when(known, full).alias("command"), code.alias("code"), (known & command.isin("PASS", "AUTH")).alias("auth"), passive.alias("passive"))))


def rdp(df: DataFrame) -> DataFrame:
    """X.224 connection request or confirm with its negotiation: requested or selected security."""
    kind = F.hex(slice_(P, 5, 1))
    ok = (F.hex(slice_(P, 0, 2)) == "0300") & kind.isin("E0", "D0")
    negotiation = u(P, 11, 1).isin(1, 2) & (F.octet_length(P) >= 19)
    protocols = u_le(P, 15, 4)
    return df.withColumn("rdp", F.when(ok, F.struct((kind == "E0").alias("request"), F.when(negotiation, name_of(protocols.cast("int"), RDP_SECURITY, "MULTI-PROTOCOL")).alias("security"))))


def dhcp4_fixed(df: DataFrame) -> DataFrame:
    """Options walked with one fold over at most 64 entries: a list of (code, at, size)."""
    size = F.octet_length(P)
    step = lambda acc: F.when((acc["at"] >= size) | (u(P, acc["at"], 1) == 255), acc).when(u(P, acc["at"], 1) == 0, F.struct((acc["at"] + 1).alias("at"), acc["found"].alias("found"))).otherwise(
        F.struct((acc["at"] + 2 + F.coalesce(u(P, acc["at"] + 1, 1), F.lit(0)).cast("int")).alias("at"), F.concat(acc["found"], F.array(F.struct(u(P, acc["at"], 1).cast("int").alias("code"), (acc["at"] + 2).alias("at"), F.coalesce(u(P, acc["at"] + 1, 1), F.lit(0)).cast("int").alias("size")))).alias("found"))
    )
    zero = F.struct(F.lit(240).alias("at"), F.array().cast("array<struct<code:int,at:int,size:int>>").alias("found"))
    df = df.withColumn("_o", F.when(size >= 240, F.aggregate(F.sequence(F.lit(1), F.lit(64)), zero, lambda acc, _: step(acc))["found"]))

    def option(code: int) -> Column:
        hit = F.get(F.filter("_o", lambda x: x["code"] == code), F.lit(0))
        return hit

    def data(code: int) -> Column:
        return slice_(P, option(code)["at"], option(code)["size"])

    ok = (size >= 240) & (F.hex(slice_(P, 236, 4)) == "63825363") & (u(P, 2, 1) <= 16)
    assigned = ipv4_text(P, 16)
    msg = F.when(option(53)["size"] == 1, name_of(u(P, option(53)["at"], 1).cast("int"), DHCP4_TYPES, "UNKNOWN"))
    return df.withColumn(
        "dhcp",
        F.when(
            ok,
            F.struct(
                msg.alias("msg_type"),
                F.when((u(P, 1, 1) == 1) & (u(P, 2, 1) == 6), mac_text(P, 28)).alias("client_mac"),
                data(12).cast("string").alias("hostname"),
                F.when(assigned != "0.0.0.0", assigned).alias("assigned_ip"),
                F.when(option(50)["size"] == 4, ipv4_text(P, option(50)["at"])).alias("requested_ip"),
                data(60).cast("string").alias("vendor_class"),
            ),
        ),
    ).drop("_o")


# Dialect revisions.
SMB_DIALECTS = {0x0202: "SMB2.0", 0x0210: "SMB2.1", 0x02FF: "SMB2-wildcard", 0x0300: "SMB3.0", 0x0302: "SMB3.0.2", 0x0311: "SMB3.1.1"}
ND_TYPES = {133: "RS", 134: "RA", 135: "NS", 136: "NA", 137: "REDIRECT"}


def smb_dialect(df: DataFrame) -> DataFrame:
    """The dialect of a negotiate response."""
    ok = (F.hex(slice_(P, 4, 4)) == "FE534D42") & (u_le(P, 16, 2) == 0) & (u_le(P, 20, 4) % 2 == 1) & (F.octet_length(P) >= 74)
    return df.withColumn("dialect", F.when(ok, name_of(u_le(P, 72, 2).cast("int"), SMB_DIALECTS, "SMB2-unknown")))


def smb_ntlm(df: DataFrame) -> DataFrame:
    """Whether a session setup request carries an NTLM authenticate message with a response of 24 bytes or more."""
    at = F.locate("NTLMSSP\x00\x03\x00\x00\x00", F.decode(slice_(P, 68, 512), "ISO-8859-1"))
    begin = (at + 67).cast("int")
    ok = (F.hex(slice_(P, 4, 4)) == "FE534D42") & (u_le(P, 16, 2) == 1) & (u_le(P, 20, 4) % 2 == 0)
    return df.withColumn("ntlm", F.coalesce(ok & (at > 0) & (u_le(P, begin + 20, 2) >= 24), F.lit(False)))


def neighbor(df: DataFrame) -> DataFrame:
    """Neighbor discovery: kind, target address, flags of an advertisement."""
    t = u(P, 0, 1)
    flags = u(P, 4, 1)
    bit = lambda n: (F.floor(flags / n) % 2).cast("string")
    target = F.when(t.isin(135, 136, 137) & (F.octet_length(P) >= 24), ipv6_text(P, 8))
    text = F.when((t == 136) & (F.octet_length(P) >= 24), F.concat(F.lit("R="), bit(128), F.lit(" S="), bit(64), F.lit(" O="), bit(32)))
    return df.withColumn("neighbor", F.when(t.between(133, 137), F.struct(name_of(t.cast("int"), ND_TYPES, "").alias("kind"), target.alias("target"), text.alias("flags"))))


def relay_agent(data: Column) -> Column:
    """Circuit and remote id of a relay agent option (sub-options 1 and 2)."""
    size = F.octet_length(data)
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("circuit"), F.lit(None).cast("string").alias("remote"))

    def step(acc, _):
        kind, n = u(data, acc["at"], 1), u(data, acc["at"] + 1, 1).cast("int")
        value = slice_(data, acc["at"] + 2, F.least(n, F.lit(128))).cast("string")
        fits = (n.isNotNull()) & (acc["at"] + 2 + n <= size)
        return F.struct(F.when(fits, acc["at"] + 2 + n).otherwise(size).cast("int").alias("at"), F.when(fits & (kind == 1), value).otherwise(acc["circuit"]).alias("circuit"), F.when(fits & (kind == 2), value).otherwise(acc["remote"]).alias("remote"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), zero, step)
