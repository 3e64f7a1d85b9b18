"""Engine configuration: presets, validation, and a digest of every field."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, field, replace

from ..operators.filters import Filters


@dataclass(frozen=True)
class Gates:
    dns: bool = True
    tls: bool = True
    quic: bool = True
    http: bool = True
    dhcp: bool = True
    icmp: bool = True
    smb: bool = True
    mdns: bool = True
    enterprise: bool = True
    discovery: bool = True
    ftp: bool = False


@dataclass(frozen=True)
class Config:
    mode: str = "forensic"
    gates: Gates = field(default_factory=Gates)
    filters: Filters = field(default_factory=Filters)
    sessions: str = "gap"
    idle_us: int = 120_000_000
    sweep_every: int = 256
    packet_limit: int = 0
    flow_updates: bool = True
    parse_errors: bool = True
    domain_filter: str | None = None
    dns_ports: tuple[int, ...] = (53,)
    tls_ports: tuple[int, ...] = (443, 8443, 993, 995, 465)
    quic_ports: tuple[int, ...] = (443, 80)
    http_ports: tuple[int, ...] = (80, 8000, 8008, 8080, 8081, 8888)


#: What each mode changes.
PRESETS = {
    "forensic": Config(gates=Gates(ftp=True)),
    "monitor": Config(mode="monitor", gates=Gates(icmp=False, mdns=False), flow_updates=False, parse_errors=False),
    "stealth": Config(mode="stealth", gates=Gates(icmp=False, http=False, smb=False), flow_updates=False, parse_errors=False),
    "replay": Config(mode="replay", sessions="sweep"),
}
ALIASES = {"light": "monitor", "advanced": "forensic", "minimal": "stealth"}


def preset(name: str, **changes) -> Config:
    return replace(PRESETS[ALIASES.get(name, name)], **changes)


def validate(c: Config) -> tuple[list[str], list[str]]:
    """All errors and all warnings, not just the first."""
    errors, warnings = [], []
    if c.sessions not in ("gap", "sweep"):
        errors.append(f"sessions must be gap or sweep, not {c.sessions}")
    if c.idle_us <= 0:
        errors.append("idle_us must be positive")
    if c.sweep_every <= 0:
        errors.append("sweep_every must be positive")
    if c.packet_limit < 0:
        errors.append("packet_limit must not be negative")
    f = c.filters
    if f.min_size and f.max_size and f.min_size > f.max_size:
        errors.append("min_size is above max_size")
    for name in ("port", "src_port", "dst_port"):
        p = getattr(f, name)
        if p is not None and not 0 < p < 65536:
            errors.append(f"{name} {p} is no port")
    for ports in ("dns_ports", "tls_ports", "quic_ports", "http_ports"):
        if any(not 0 < p < 65536 for p in getattr(c, ports)):
            errors.append(f"{ports} holds a number that is no port")
    if f.direction not in (None, "inbound", "outbound", "internal", "external"):
        errors.append(f"direction {f.direction} is unknown")
    if not any(asdict(c.gates).values()):
        warnings.append("all dissectors are off")
    if c.domain_filter and not c.gates.dns:
        warnings.append("a domain filter without DNS passes nothing")
    return errors, warnings


def text(c: Config) -> str:
    return json.dumps(asdict(c), sort_keys=True, separators=(",", ":"))


def digest(c: Config) -> str:
    """SHA-256 of all fields in a canonical text."""
    return hashlib.sha256(text(c).encode()).hexdigest()


def settings(path: str) -> dict[str, str]:
    """The output_dir of a TOML file, which flags override; no file or an empty value gives nothing.

    Memory is bounded by Spark's own settings, so max_memory_mb and other keys have no effect.
    """
    try:
        with open(path, encoding="utf-8-sig") as f:
            found = tomllib.loads(f.read()).get("output_dir")
    except FileNotFoundError:
        return {}
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"{path}: {e}") from None
    if found is not None and not isinstance(found, str):
        raise ValueError(f"{path}: output_dir is no text")
    return {"output_dir": found} if found else {}
