"""Command line: ``python -m packetloom --pcap 'captures/*.pcap' --output events --mode replay``.

Under spark-submit the session's own settings hold.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .operators.filters import Filters
from .plans import config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("packetloom", description="Packet captures to ordered events.")
    p.add_argument("--pcap", help="capture files (a pattern)")
    p.add_argument("--output", help="folder for the NDJSON files")
    p.add_argument("--config", help="TOML file with output_dir, which --output overrides")
    p.add_argument("--mode", default="forensic", choices=[*config.PRESETS, *config.ALIASES])
    p.add_argument("--limit", type=int, default=0, help="only the first so many packets")
    p.add_argument("--one-file", action="store_true")
    p.add_argument("--flows-csv", help="folder for a CSV summary of the flows")
    p.add_argument("--dry-run", action="store_true", help="check the configuration and print it")
    p.add_argument("--check-determinism", action="store_true", help="run twice and compare")
    p.add_argument("--domain", help="only events of flows whose domain contains this")
    for name in ("protocol", "ip", "src-ip", "dst-ip", "subnet", "direction"):
        p.add_argument(f"--{name}")
    for name in ("port", "src-port", "dst-port", "min-size", "max-size"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--exclude-ip", action="append", default=[])
    p.add_argument("--exclude-port", action="append", type=int, default=[])
    p.add_argument("--keep-loopback", action="store_true")
    return p


def configuration(a: argparse.Namespace) -> config.Config:
    f = Filters(min_size=a.min_size or 0, max_size=a.max_size or 0, exclude_loopback=not a.keep_loopback, protocol=a.protocol, ip=a.ip, src_ip=a.src_ip, dst_ip=a.dst_ip, exclude_ips=tuple(a.exclude_ip), port=a.port, src_port=a.src_port, dst_port=a.dst_port, exclude_ports=tuple(a.exclude_port), subnet=a.subnet, direction=a.direction)
    return replace(config.preset(a.mode), filters=f, packet_limit=a.limit, domain_filter=a.domain)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    c = configuration(a)
    errors, warnings = config.validate(c)
    if a.config:
        try:
            a.output = a.output or config.settings(a.config).get("output_dir")
        except ValueError as e:
            errors.append(str(e))
    for x in warnings:
        print("warning:", x, file=sys.stderr)
    for x in errors:
        print("error:", x, file=sys.stderr)
    if errors:
        return 1
    if a.dry_run:
        print(config.text(c))
        print("sha256", config.digest(c))
        return 0
    if not a.pcap or not (a.output or a.check_determinism or a.flows_csv):
        print("error: --pcap and one of --output, --flows-csv, --check-determinism are needed", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession, functions as F

    from .operators import events, flows
    from .plans import determinism, engine
    from .sources import pcap

    spark = SparkSession.builder.appName("packetloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pcap.register(spark)
    frames = pcap.numbered(spark.read.format("pcap").load(a.pcap))
    if a.check_determinism:
        one, two = (events.ndjson(engine.run(frames, c)) for _ in range(2))
        r = determinism.first_difference(one, two).first()
        same = r["event_id"] is None and r["lines_a"] == r["lines_b"]
        print("identical" if same else f"event {r['event_id']} differs", r["lines_a"], "lines")
        return 0 if same else 2
    if a.output:
        start = frames.agg(F.min("timestamp_us")).first()[0] or 0
        head = events.session_header(spark, config.digest(c), a.pcap, c.mode, start)
        events.write_ndjson(head.union(events.ndjson(engine.run(frames, c))), a.output, a.one_file)
    if a.flows_csv:
        packets = engine.decoded_packets(frames.where("error is null").drop("error"), c)[1]
        flows.summaries(flows.sessions_by_gap(flows.with_flow_key(packets), c.idle_us)).write.option("header", True).csv(a.flows_csv)
    return 0


if __name__ == "__main__":
    sys.exit(main())
