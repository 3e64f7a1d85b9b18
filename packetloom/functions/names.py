"""Name tables of protocol numbers (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that results must carry, in numeric order.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3"}
MDNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 47: "NSEC", 255: "ANY"}
DHCP4_TYPES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}
DHCP6_TYPES = {1: "SOLICIT", 2: "ADVERTISE", 3: "REQUEST", 4: "CONFIRM", 5: "RENEW", 6: "REBIND", 7: "REPLY", 8: "RELEASE", 9: "DECLINE", 10: "RECONFIGURE", 11: "INFORMATION-REQUEST", 12: "RELAY-FORW", 13: "RELAY-REPL"}
ICMP4 = {0: "echo-reply", 3: "dest-unreachable", 4: "source-quench", 5: "redirect", 8: "echo-request", 9: "router-advertisement", 10: "router-solicitation", 11: "time-exceeded", 12: "parameter-problem", 13: "timestamp-request", 14: "timestamp-reply", 17: "address-mask-request", 18: "address-mask-reply"}
ICMP4_CODES = {
    3: {0: "net-unreachable", 1: "host-unreachable", 2: "protocol-unreachable", 3: "port-unreachable", 4: "fragmentation-needed", 5: "source-route-failed", 6: "dest-network-unknown", 7: "dest-host-unknown", 9: "dest-network-admin-prohibited", 10: "dest-host-admin-prohibited", 11: "network-unreachable-tos", 12: "host-unreachable-tos", 13: "communication-admin-prohibited"},
    5: {0: "redirect-network", 1: "redirect-host", 2: "redirect-tos-network", 3: "redirect-tos-host"},
    11: {0: "ttl-exceeded-in-transit", 1: "fragment-reassembly-exceeded"},
    12: {0: "pointer-indicates-error", 1: "missing-required-option", 2: "bad-length"},
}
ICMP6 = {1: "dest-unreachable", 2: "packet-too-big", 3: "time-exceeded", 4: "parameter-problem", 128: "echo-request", 129: "echo-reply", 130: "multicast-listener-query", 131: "multicast-listener-report", 132: "multicast-listener-done", 133: "router-solicitation", 134: "router-advertisement", 135: "neighbor-solicitation", 136: "neighbor-advertisement", 137: "redirect", 143: "multicast-listener-report-v2"}
ICMP6_CODES = {
    1: {0: "no-route-to-dest", 1: "communication-admin-prohibited", 2: "beyond-scope-of-source", 3: "address-unreachable", 4: "port-unreachable", 5: "source-failed-ingress-egress", 6: "reject-route-to-dest"},
    3: {0: "hop-limit-exceeded", 1: "fragment-reassembly-exceeded"},
    4: {0: "erroneous-header-field", 1: "unrecognized-next-header", 2: "unrecognized-ipv6-option"},
}
SMB2_COMMANDS = ("NEGOTIATE", "SESSION_SETUP", "LOGOFF", "TREE_CONNECT", "TREE_DISCONNECT", "CREATE", "CLOSE", "FLUSH", "READ", "WRITE", "LOCK", "IOCTL", "CANCEL", "ECHO", "QUERY_DIRECTORY", "CHANGE_NOTIFY", "QUERY_INFO", "SET_INFO", "OPLOCK_BREAK")
SMB1_COMMANDS = {
    0x00: "CREATE_DIRECTORY", 0x01: "DELETE_DIRECTORY", 0x02: "OPEN", 0x03: "CREATE", 0x04: "CLOSE", 0x05: "FLUSH", 0x06: "DELETE", 0x07: "RENAME", 0x08: "QUERY_INFORMATION", 0x09: "SET_INFORMATION", 0x0A: "READ", 0x0B: "WRITE", 0x0C: "LOCK_BYTE_RANGE", 0x0D: "UNLOCK_BYTE_RANGE", 0x0E: "CREATE_TEMPORARY", 0x0F: "CREATE_NEW",
    0x10: "CHECK_DIRECTORY", 0x11: "PROCESS_EXIT", 0x12: "SEEK", 0x13: "LOCK_AND_READ", 0x14: "WRITE_AND_UNLOCK", 0x1A: "READ_RAW", 0x1D: "WRITE_RAW", 0x22: "SET_INFORMATION2", 0x23: "QUERY_INFORMATION2", 0x24: "LOCKING_ANDX", 0x25: "TRANSACTION", 0x27: "IOCTL", 0x2B: "ECHO", 0x2D: "OPEN_ANDX", 0x2E: "READ_ANDX", 0x2F: "WRITE_ANDX", 0x32: "TRANSACTION2", 0x34: "FIND_CLOSE2",
    0x70: "TREE_CONNECT", 0x71: "TREE_DISCONNECT", 0x72: "NEGOTIATE", 0x73: "SESSION_SETUP_ANDX", 0x74: "LOGOFF_ANDX", 0x75: "TREE_CONNECT_ANDX", 0xA0: "NT_TRANSACT", 0xA2: "NT_CREATE_ANDX", 0xA4: "NT_CANCEL", 0xA5: "NT_RENAME", 0xFF: "NO_ANDX_COMMAND",
}
NT_STATUS = {
    0x00000000: "STATUS_SUCCESS", 0x00000103: "STATUS_PENDING", 0x80000005: "STATUS_BUFFER_OVERFLOW", 0x80000006: "STATUS_NO_MORE_FILES", 0xC0000001: "STATUS_UNSUCCESSFUL", 0xC0000002: "STATUS_NOT_IMPLEMENTED", 0xC0000005: "STATUS_ACCESS_VIOLATION", 0xC0000008: "STATUS_INVALID_HANDLE", 0xC000000D: "STATUS_INVALID_PARAMETER", 0xC000000F: "STATUS_NO_SUCH_FILE", 0xC0000011: "STATUS_END_OF_FILE", 0xC0000016: "STATUS_MORE_PROCESSING_REQUIRED",
    0xC0000017: "STATUS_NO_MEMORY", 0xC0000022: "STATUS_ACCESS_DENIED", 0xC0000023: "STATUS_BUFFER_TOO_SMALL", 0xC0000034: "STATUS_OBJECT_NAME_NOT_FOUND", 0xC0000035: "STATUS_OBJECT_NAME_COLLISION", 0xC000006D: "STATUS_LOGON_FAILURE", 0xC000006E: "STATUS_ACCOUNT_RESTRICTION", 0xC000006F: "STATUS_INVALID_LOGON_HOURS", 0xC0000070: "STATUS_INVALID_WORKSTATION", 0xC0000071: "STATUS_PASSWORD_EXPIRED", 0xC0000072: "STATUS_ACCOUNT_DISABLED",
    0xC000009A: "STATUS_INSUFFICIENT_RESOURCES", 0xC00000BB: "STATUS_NOT_SUPPORTED", 0xC00000CC: "STATUS_BAD_NETWORK_NAME", 0xC0000101: "STATUS_DIRECTORY_NOT_EMPTY", 0xC0000103: "STATUS_NOT_A_DIRECTORY", 0xC0000120: "STATUS_CANCELLED", 0xC0000121: "STATUS_CANNOT_DELETE", 0xC0000193: "STATUS_ACCOUNT_EXPIRED", 0xC0000224: "STATUS_PASSWORD_MUST_CHANGE", 0xC0000225: "STATUS_NOT_FOUND", 0xC0000234: "STATUS_ACCOUNT_LOCKED_OUT", 0xC000035C: "STATUS_NETWORK_SESSION_EXPIRED",
}
QUIC_VERSIONS = {0x00000000: "version-negotiation", 0x00000001: "QUIC v1", 0x51303433: "GQUICv43", 0x51303436: "GQUICv46", 0x51303530: "GQUICv50", 0x6B3343CF: "QUIC v2", 0xFF00001A: "draft-26", 0xFF00001B: "draft-27", 0xFF00001C: "draft-28", 0xFF00001D: "draft-29"}
LDAP_OPS = {0x60: "BIND_REQ", 0x61: "BIND_RESP", 0x62: "UNBIND_REQ", 0x63: "SEARCH_REQ", 0x64: "SEARCH_RESULT_ENTRY", 0x65: "SEARCH_RESULT_DONE", 0x66: "MODIFY_REQ", 0x67: "MODIFY_RESP", 0x68: "ADD_REQ", 0x69: "ADD_RESP", 0x6A: "DEL_REQ", 0x6B: "DEL_RESP", 0x6C: "MODIFY_DN_REQ", 0x6D: "MODIFY_DN_RESP", 0x6E: "COMPARE_REQ", 0x6F: "COMPARE_RESP", 0x70: "ABANDON_REQ", 0x73: "SEARCH_RESULT_REF", 0x77: "EXTENDED_REQ", 0x78: "EXTENDED_RESP", 0x79: "INTERMEDIATE_RESP"}
KERBEROS_TAGS = {0x6A: "AS-REQ", 0x6B: "AS-REP", 0x6C: "TGS-REQ", 0x6D: "TGS-REP", 0x6E: "AP-REQ", 0x6F: "AP-REP", 0x7E: "KRB-ERROR"}
RDP_SECURITY = {0: "RDP-STANDARD", 1: "TLS", 2: "CredSSP-NLA", 3: "TLS+CredSSP", 4: "RDSTLS", 8: "CredSSP-EARLY-AUTH"}
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE")
FTP_COMMANDS = ("USER", "PASS", "QUIT", "CWD", "PWD", "LIST", "NLST", "RETR", "STOR", "APPE", "DELE", "MKD", "RMD", "RNFR", "RNTO", "PASV", "PORT", "TYPE", "MODE", "STRU", "NOOP", "SYST", "FEAT", "OPTS", "AUTH", "PBSZ", "PROT", "MLSD", "MLST", "SIZE", "MDTM", "STAT", "ABOR", "HELP")
RISK_WEIGHTS = {"deprecated_version": 20, "version_downgrade": 25, "weak_cipher": 20, "no_forward_secrecy": 15, "self_signed_cert": 30, "expired_cert": 25, "rare_ja3": 10, "ja3_ja3s_mismatch": 15, "geo_asn_mismatch": 20, "suspicious_resumption": 15, "zero_rtt_usage": 10}


def name_of(value: Column, names: dict, default) -> Column:
    """Look-up in a literal map; Catalyst folds the map to a constant."""
    if not names:
        return default if isinstance(default, Column) else F.lit(default)
    pairs = ", ".join(f"{k}{'L' if wide else ''}, '{v}'" for wide in [max(names) > 0x7FFFFFFF] for k, v in names.items())
    table = F.expr(f"map({pairs})")  # one text to parse instead of a call for each entry
    return F.coalesce(F.try_element_at(table, value), default if isinstance(default, Column) else F.lit(default))


def icmp_description(type_: Column, code: Column, v6: bool) -> Column:
    plain, coded = (ICMP6, ICMP6_CODES) if v6 else (ICMP4, ICMP4_CODES)
    both = {t * 256 + c: n for t, codes in coded.items() for c, n in codes.items()}
    return name_of(type_.cast("int") * 256 + code.cast("int"), both, name_of(type_.cast("int"), plain, "unknown"))
