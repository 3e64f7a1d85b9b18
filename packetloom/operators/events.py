"""The event stream: typed rows, one order, NDJSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.stage import numbered
from .decode import flow_id

FIELDS = ("packet_id", "timestamp_us", "event_type", "protocol", "flow_id", "ordinal", "attributes")
# The place of each kind of event within one packet.
ORDINALS = {"discovery.device": 0, "flow": 1, "engine.parse_error": 2, "dns": 3, "tls.client_hello": 4, "tls.server_hello": 5, "http.request": 6, "http.response": 7, "quic.sni": 8, "dhcp.message": 9, "icmp.message": 10, "smb.session": 11, "mdns.record": 12, "engine.capture_error": 13}


def attributes(**values: str) -> Column:
    """A map of strings in key order from SQL expressions; absent values are left out."""
    if not values:
        return F.expr("cast(map() as map<string, string>)")
    pairs = ", ".join(f"named_struct('key', '{k}', 'value', cast({v} as string))" for k, v in sorted(values.items()))
    return F.expr(f"map_from_entries(filter(array({pairs}), x -> x.value is not null))")


def _lit(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def event(df: DataFrame, event_type: Column | str, protocol: Column | str, ordinal: int, flow: Column | str, **values) -> DataFrame:
    return df.select("packet_id", "timestamp_us", _lit(event_type).alias("event_type"), _lit(protocol).alias("protocol"), _lit(flow).alias("flow_id"), F.lit(ordinal).alias("ordinal"), attributes(**values).alias("attributes"))


def one(when: Column, event_type: Column | str, protocol: str, ordinal: int, flow: Column | str, **values) -> Column:
    """An event as a struct, null where the condition does not hold."""
    return F.when(when, F.struct(_lit(event_type).alias("event_type"), F.lit(protocol).alias("protocol"), _lit(flow).alias("flow_id"), F.lit(ordinal).alias("ordinal"), attributes(**values).alias("attributes")))


def one_error(reason: str, protocol: str) -> Column:
    return one(F.col(reason).isNotNull(), "engine.parse_error", protocol, ORDINALS["engine.parse_error"], "", reason=shortened(reason))


def spread(df: DataFrame, found: list[Column]) -> DataFrame:
    """One row for each event that a row has."""
    if not found:
        return event(df.limit(0), "", "", 0, "")
    return df.select("packet_id", "timestamp_us", F.inline(F.array_compact(F.array(*found)))).select(*FIELDS)


def flow_events(counted: DataFrame, updates: bool = True) -> DataFrame:
    """flow.new and flow.update for each packet with running counters (see flows.running_counters)."""
    rows = counted if updates else counted.where("is_new")
    names = {c: c for c in ("src_ip", "src_port", "dst_ip", "dst_port", "packet_size", "flow_tx_bytes", "flow_rx_bytes", "flow_packets")}
    if "domain" in rows.columns:
        names["domain"] = "domain"
    return event(rows, F.when(F.col("is_new"), "flow.new").otherwise("flow.update"), F.col("protocol"), ORDINALS["flow"], flow_id(), **names)


def device_events(first_seen: DataFrame) -> DataFrame:
    return event(first_seen.withColumnRenamed("frame_no", "packet_id"), "discovery.device", "ARP", ORDINALS["discovery.device"], "", mac="src_mac")


def shortened(reason: str) -> str:
    return f"if(length({reason}) > 256, concat(left({reason}, 256), '...[truncated]'), {reason})"


def parse_errors(df: DataFrame, protocol: str, reason: str) -> DataFrame:
    return event(df.where(F.col(reason).isNotNull()), "engine.parse_error", protocol, ORDINALS["engine.parse_error"], "", reason=shortened(reason))


def capture_errors(frames: DataFrame) -> DataFrame:
    """Rows of a capture that could not be read (column error), at their frame's place."""
    rows = frames.where("error is not null").select(F.col("frame_no").alias("packet_id"), F.coalesce("timestamp_us", F.lit(0)).cast("long").alias("timestamp_us"), "error", "file")
    return event(rows, "engine.capture_error", "", ORDINALS["engine.capture_error"], "", reason="error", file="file")


def ordered(*parts: DataFrame, top: int | None = None) -> DataFrame:
    """One stream with event_id 1, 2, ...: by packet, place within it, type, attributes.

    The union goes into a table by ranges of packets (see stage.numbered); with ``top``, the
    greatest packet_id, it is computed once, else once more for a sample of its range.
    """
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return numbered(all_, "events", "event_id", "packet_id", ["ordinal", "event_type", "flow_id", F.to_json("attributes"), "timestamp_us"], top=top)[0].select("event_id", *FIELDS)


def ndjson(events: DataFrame) -> DataFrame:
    """event_id, line: keys in fixed order, attribute keys sorted, all control characters escaped."""
    inner = F.map_from_entries(F.array_sort(F.map_entries("attributes")))
    return events.select("event_id", F.to_json(F.struct("event_id", "packet_id", "timestamp_us", "event_type", "protocol", "flow_id", inner.alias("attributes"))).alias("line"))


def session_header(spark: SparkSession, config_sha256: str, source: str, mode: str, start_us: int, version: str = "0.1.0") -> DataFrame:
    row = {"config_sha256": config_sha256, "input_source": source, "operating_mode": mode, "record_type": "session_header", "session_start_us": start_us, "engine_version": version}
    df = spark.createDataFrame([tuple(row.values())], "config_sha256 string, input_source string, operating_mode string, record_type string, session_start_us long, engine_version string")
    return df.select(F.lit(0).cast("long").alias("event_id"), F.to_json(F.struct(*sorted(row))).alias("line"))


def syslog(lines: DataFrame, host: str, app: str = "packetloom") -> DataFrame:
    """event_id, line as RFC 5424 messages of at most 1400 bytes, for a foreachBatch sender."""
    text = F.concat(F.lit(f"<134>1 - {host} {app} - - - "), "line")
    return lines.select("event_id", F.when(F.octet_length(text) <= 1400, text).otherwise(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, 1400).cast("string"))).alias("line"))


def write_ndjson(lines: DataFrame, path: str, one_file: bool = False, lines_per_file: int = 5_000_000) -> None:
    """Text files that, read in name order, hold the lines by event_id."""
    out = lines.coalesce(1).sortWithinPartitions("event_id") if one_file else lines.repartitionByRange("event_id").sortWithinPartitions("event_id")
    out.select("line").write.option("maxRecordsPerFile", lines_per_file).text(path)
