import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetloom.dissect import pointers
from packetloom.functions.bytes import ip_key
from packetloom.operators import decode, events, flows, tcp
from packetloom.operators.filters import Filters, filter_packets
from packetloom.plans import config, determinism, engine
from packetloom.sources import pcap, tables
from packetloom.sources.packets import encode_frames, load_packets
from packetloom.streaming.flows import flow_table, session_flows

DIR = "/root/testdata/sf0.001"


def lines(spark):
    frames = encode_frames(load_packets(spark, DIR).where("packet_id <= 300"))
    return events.ndjson(engine.run(frames, config.preset("replay")))


def test_events_do_not_depend_on_the_partitioning(spark):
    found = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = sorted(map(tuple, lines(spark).collect()))
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        found.add(tuple(r[1] for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1
    for text in next(iter(found)):
        e = json.loads(text)
        assert list(e) == ["event_id", "packet_id", "timestamp_us", "event_type", "protocol", "flow_id", "attributes"]
        assert list(e["attributes"]) == sorted(e["attributes"])


def test_header_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"n": i})) for i in range(1, 500)], "event_id long, line string")
    head = events.session_header(spark, config.digest(config.preset("monitor")), "a.pcap", "monitor", 5)
    events.write_ndjson(head.union(rows), str(tmp_path / "out"))
    text = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert list(json.loads(text[0])) == sorted(json.loads(text[0]))
    assert [json.loads(x)["n"] for x in text[1:]] == list(range(1, 500))


def test_determinism_report(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "event_id long, line string")
    same = determinism.first_difference(a, a).first()
    assert same["event_id"] is None and same["lines_a"] == same["lines_b"] == 2
    b = spark.createDataFrame([(1, "x")], "event_id long, line string")
    assert determinism.first_difference(a, b).first()["event_id"] == 2
    assert determinism.digest(a).first() == determinism.digest(a.repartition(3)).first() != determinism.digest(b).first()


def test_pcap_source(spark, tmp_path):
    frames = encode_frames(load_packets(spark, DIR).where("packet_id <= 50"))
    path = str(tmp_path / "a.pcap")
    pcap.write_pcap(frames, path)
    pcap.register(spark)
    want = sorted((r["frame_no"], r["timestamp_us"], bytes(r["frame"])) for r in frames.collect())
    got = spark.read.format("pcap").load(path)
    assert sorted((r["frame_no"], r["timestamp_us"], bytes(r["frame"])) for r in got.collect()) == want
    with open(path, "rb") as f:
        data = f.read()
    (tmp_path / "d.pcap").write_bytes(data)
    two = pcap.numbered(spark.read.format("pcap").load(str(tmp_path / "[ad].pcap")))
    assert sorted(r["frame_no"] for r in two.collect()) == list(range(1, 101))
    (tmp_path / "d.pcap").unlink()
    (tmp_path / "b.pcap").write_bytes(data[:-5])
    (tmp_path / "c.pcap").write_bytes(b"nonsense")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pcap"))
    rows = pcap.from_binary(files).collect()
    assert sum(r["error"] is None for r in rows) == 99
    assert {r["error"] for r in rows} == {None, "packet data incomplete", "not a capture file"}


def test_rotating_captures_as_a_stream(spark, tmp_path):
    frames = encode_frames(load_packets(spark, DIR).where("packet_id <= 40"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        pcap.write_pcap(frames.where(f"frame_no % 3 = {i}"), str(tmp_path / f"in/{i}.pcap"))
    q = pcap.tail(spark, str(tmp_path / "in"), files_per_trigger=1).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(bytes(r["frame"]) for r in spark.sql("select * from tailed").collect())
    assert got == sorted(bytes(r["frame"]) for r in frames.collect())
    assert pcap.sha256(spark, str(tmp_path / "in/0.pcap")).count() == 1


def test_syslog_lines(spark):
    lines = spark.createDataFrame([(1, "{}"), (2, "é" * 2000)], "event_id long, line string")
    got = {r["event_id"]: r["line"] for r in events.syslog(lines, "h").collect()}
    assert got[1] == "<134>1 - h packetloom - - - {}" and len(got[2].encode()) <= 1403


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(sorted(pointers.DISSECTORS)))
def test_any_bytes_are_dissected_or_refused(data, name):
    try:
        pointers.DISSECTORS[name][0](data)
    except (pointers.Bad, IndexError):
        pass


def test_any_frames_decode(spark):
    import random

    r = random.Random(1)
    rows = [(i, 0, 0, bytes(r.randrange(256) for _ in range(r.randrange(120)))) for i in range(300)]
    rows += [(1000 + i, 0, 0, bytes.fromhex("02fffffffffe020000000001") + r.choice([b"\x08\x00", b"\x86\xdd", b"\x81\x00\x00\x01\x08\x00"]) + bytes([r.choice([0x45, 0x46, 0x60, 0x4F])]) + bytes(r.randrange(256) for _ in range(r.randrange(80)))) for i in range(300)]
    df = spark.createDataFrame(rows, "frame_no long, timestamp_us long, wire_len int, frame binary")
    got = decode.decode_frames(df).collect()
    assert len(got) == 600
    assert decode.decode_frames(df, native=True).columns == decode.decode_frames(df).columns
    native = {r["frame_no"]: r for r in decode.decode_frames(df, native=True).collect()}
    assert all(native[r["frame_no"]] == r for r in got), [(native[r["frame_no"]], r) for r in got if native[r["frame_no"]] != r][:2]
    assert all((x["protocol"] is None) or (x["error"] is None and x["src_ip"]) for x in got)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=2000), st.integers(0, 2**32 - 1), st.randoms(use_true_random=False))
def test_streams_reassemble_in_any_order(data, start, r):
    cuts = sorted({0, len(data), *(r.randrange(len(data) + 1) for _ in range(12))})
    parts = [(a, data[max(0, a - r.randrange(9)) : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = [(b_end - len(x), x) for (a, x), b_end in zip(parts, cuts[1:], strict=False)]
    first, rest = parts[0], parts[1:] * 2
    r.shuffle(rest)
    s = tcp.Stream()
    out = b"".join(s.push((start + a) & 0xFFFFFFFF, x)[1] for a, x in [first, *rest])
    assert out == data


def test_stream_limits():
    s = tcp.Stream()
    assert s.push(10, b"ab") == ("assembled", b"ab")
    assert s.push(10, b"ab")[0] == "retransmit"
    assert s.push(11, b"bc") == ("assembled", b"c")
    assert s.push(5, b"")[0] == "passthrough"
    assert s.push(100, b"x" * (tcp.MAX_AHEAD + 1))[0] == "reset"


def test_streaming_equals_batch(spark, tmp_path):
    p = load_packets(spark, DIR)
    for i, (low, high) in enumerate([(0, 400), (400, 800), (800, 5000)]):
        p.where(f"packet_id > {low} and packet_id <= {high}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    end = p.limit(1).withColumn("timestamp_us", F.lit(1904067200000000)).withColumn("client_end", F.lit(1)).drop("client_end")
    end.coalesce(1).write.parquet(str(tmp_path / "in/9"))
    source = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = session_flows(source).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["ip1"], r["port1"], r["ip2"], r["port2"], r["packets"], r["first_seen_us"]) for r in spark.sql("select * from sessions").collect())
    batch = flows.summaries(flows.sessions_by_gap(flows.with_flow_key(p)))
    want = sorted((r["ip1"], r["port1"], r["ip2"], r["port2"], r["packets"], r["first_seen_us"]) for r in batch.collect())
    assert got == want
    q = flow_table(source).writeStream.format("memory").queryName("table").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    closed = spark.sql("select * from table where closed").collect()
    assert sum(r["packets"] for r in closed) >= p.count() * 0.9


def test_filters_and_presets(spark):
    p = load_packets(spark, DIR)
    assert filter_packets(p, Filters(direction="outbound")).count() == 0
    assert filter_packets(p, Filters(exclude_multicast=True, exclude_broadcast=True, max_size=100)).where("packet_size > 100").count() == 0
    errors, warnings = config.validate(config.preset("light", filters=Filters(min_size=9, max_size=3, port=70000), sessions="x"))
    assert len(errors) == 3 and not warnings
    assert config.digest(config.preset("minimal")) != config.digest(config.preset("stealth", idle_us=5))
    assert all(not config.validate(c)[0] for c in config.PRESETS.values())


def test_reference_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("service,port\nold,53\ndomain,53,udp\nbad,x\n")
    got = tables.ports(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["service"], r["port"]) for r in got] == [("old", 53), ("domain", 53)]
    (tmp_path / "j.csv").write_text("ja4,application\nja4,application\nt13,chrome\nt13,edge\n")
    assert tables.fingerprints(spark, str(tmp_path / "j.csv")).count() == 2
    (tmp_path / "b.csv").write_text("File: list\nip,label,confidence,threat_actor\n1.2.3.4,bad,90,x\n")
    assert [tuple(r) for r in tables.blocklist(spark, str(tmp_path / "b.csv")).collect()] == [("1.2.3.4", "bad", "90", "x")]
    (tmp_path / "d.csv").write_text("A.example\nb.example,learned,2024-01-01\nx,y\n")
    assert [r["domain"] for r in tables.learned_domains(spark, str(tmp_path / "d.csv")).collect()] == ["a.example", "b.example"]


def test_sweep_sessions_need_a_sweep(spark):
    rows = [(i, i * 1_000_000, "10.0.0.1", 5, "10.0.0.2", 6, "TCP", 10) for i in range(1, 200)] + [(201, 400_000_000, "10.0.0.1", 5, "10.0.0.2", 6, "TCP", 10)]
    p = flows.with_flow_key(spark.createDataFrame(rows, "packet_id long, timestamp_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, payload_len int"))
    assert flows.sessions_by_gap(p).agg(F.max("session_id")).first()[0] == 1
    assert flows.sessions_by_sweep(p).agg(F.max("session_id")).first()[0] == 0


@pytest.mark.parametrize("data", [b"", b"\x16\x03\x01", b"\x00" * 11])
def test_short_payloads_give_errors(spark, data):
    df = spark.createDataFrame([(data,)], "payload binary")
    assert pointers.dissect(df, "dns").first()["dns"]["error"]
    tls = pointers.dissect(df, "tls").first()["tls"]
    assert tls["error"] if len(data) < 5 else tls is None


def test_settings_file(tmp_path, capsys):
    from packetloom.__main__ import main

    file = tmp_path / "a.toml"
    assert config.settings(str(file)) == {}
    file.write_text("\ufeff# comment\noutput_dir = \"out\"\nmax_memory_mb = 5\n", encoding="utf-8")
    assert config.settings(str(file)) == {"output_dir": "out"}
    for bad in ("output_dir = ", "output_dir = 5"):
        file.write_text(bad)
        with pytest.raises(ValueError, match=r"a\.toml"):
            config.settings(str(file))
        assert main(["--dry-run", "--config", str(file)]) == 1
    assert "error:" in capsys.readouterr().err


@pytest.mark.parametrize("hello", [True, False])
def test_quic_names(hello):
    name = b"q.example"
    ext = b"\0\0" + (len(name) + 5).to_bytes(2) + (len(name) + 3).to_bytes(2) + b"\0" + len(name).to_bytes(2) + name
    body = bytes.fromhex("0303") + bytes(32) + bytes.fromhex("00000213010100") + len(ext).to_bytes(2) + ext
    shake = (b"\x01" if hello else b"\x02") + len(body).to_bytes(3) + body
    head = b"\xc0\0\0\0\1" + b"\x01\xaa" + b"\0" + b"\x02\xbb\xbb"
    frames = b"\x00\x01" + b"\x06\x00" + (0x4000 | len(shake)).to_bytes(2) + shake
    packet = head + b"\x40\x10" + b"\0" + frames
    assert pointers.quic_initial(packet) == {"sni": name.decode() if hello else None}
    assert pointers.quic_initial(b"\xd0" + packet[1:]) == {"early_data": True}
    assert pointers.quic_initial(b"\xe0" + packet[1:]) is pointers.quic_initial(b"\xc0\0\0\0\x09" + packet[5:]) is None
    with pytest.raises(pointers.Bad, match="CRYPTO"):
        pointers.quic_initial(packet[:-1])
    with pytest.raises(pointers.Bad, match="SCID"):
        pointers.quic_initial(packet[:7] + b"\x15" + packet[8:])
    for n in range(6, len(head) + 4):  # cut before the first frame
        try:
            assert pointers.quic_initial(packet[:n]) is None
        except pointers.Bad as e:
            assert "DCID" in str(e)


def test_command_line(spark, tmp_path, capsys):
    from packetloom.__main__ import main

    path = str(tmp_path / "a.pcap")
    pcap.write_pcap(encode_frames(load_packets(spark, DIR).where("packet_id <= 60")), path)
    assert main(["--dry-run", "--mode", "light", "--port", "53"]) == 0
    assert "sha256" in capsys.readouterr().out
    assert main(["--port", "70000"]) == 1
    assert main(["--pcap", path]) == 1
    assert main(["--pcap", path, "--output", str(tmp_path / "out"), "--mode", "replay", "--one-file", "--flows-csv", str(tmp_path / "flows")]) == 0
    rows = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert rows[0]["record_type"] == "session_header" and [r["event_id"] for r in rows[1:]] == list(range(1, len(rows)))
    assert list((tmp_path / "flows").glob("part-*"))
    assert main(["--pcap", path, "--check-determinism", "--mode", "replay"]) == 0


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 8, 211])
def test_numbers_are_dense_at_any_partitioning(spark, aqe, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        n = 1_000_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("frame_no"), F.when(F.col("id") % 50 != 0, "UDP").alias("protocol"), F.lit(0).alias("timestamp_us"))
        got = decode.number_packets(rows)
        kept = F.col("frame_no") - F.expr("(frame_no + 49) div 50")  # the frame numbers of id % 50 = 0 are the multiples of 50
        r = got.agg(F.count("*").alias("n"), F.sum(F.when(F.col("packet_id") != kept + 1, 1).otherwise(0)).alias("wrong")).first()
        assert (r["n"], r["wrong"]) == (n - n // 50, 0)
        e = events.event(spark.range(n // 10).withColumnRenamed("id", "packet_id").withColumn("timestamp_us", F.lit(0).cast("long")), "x", "y", 0, "", a="packet_id")
        r = events.ordered(e).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_id") != F.col("packet_id") + 1, 1).otherwise(0)).alias("wrong")).first()
        assert (r["n"], r["wrong"]) == (n // 10, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_address_keys_order_by_number(spark):
    import ipaddress

    texts = ["::", "::1", "1::", "a:b::c:d", "2001:db8:1:2:3:4:5:6", "::ffff:1.2.3.4", "fe80::1:0:0:2", "10.0.0.9", "9.255.0.1", "192.168.1.1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    df = spark.createDataFrame([(x,) for x in texts], "ip string")
    for r in df.select("ip", ip_key(F.col("ip")).alias("k")).collect():
        a = ipaddress.ip_address(r["ip"])
        assert bytes(r["k"]) == (b"\x04" + a.packed + bytes(12) if a.version == 4 else b"\x06" + a.packed)
    p = df.select(F.col("ip").alias("src_ip"), F.col("ip").alias("dst_ip"))
    inside = lambda cidr: sorted(r[0] for r in filter_packets(p, Filters(subnet=cidr, exclude_loopback=False)).select("src_ip").collect())
    assert inside("2001:db8::/32") == ["2001:db8:1:2:3:4:5:6"] and inside("10.0.0.0/8") == ["10.0.0.9"] and len(inside("nonsense")) == len(texts)
