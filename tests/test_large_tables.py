"""Values and groups that only larger tables have."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from packetloom.operators import attribution
from packetloom.queries import catalogue


def same_as_sql(spark, folder, name):
    df = catalogue.queries()[name](spark, str(folder))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def write_events(spark, folder, n, users):
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.element_at(F.array(*map(F.lit, users)), (F.col("id") % len(users) + 1).cast("int")).cast("long").alias("user_id"))
    rows.write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["decode_packets", "device_first_seen", "decode_errors", "packet_numbers"])
def test_users_beyond_addresses_and_ports(spark, tmp_path, name):
    write_events(spark, tmp_path, 300, [0, 12799, 12800, 25535, 25536, 65536, 89999])
    same_as_sql(spark, tmp_path, name)


def test_devices_are_decoded_without_payloads(spark, tmp_path):
    write_events(spark, tmp_path, 10, [1, 2])
    df = catalogue.queries()["device_first_seen"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    made = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "src_mac" in made and "payload" not in made
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) < 10000


@pytest.mark.parametrize("inclusive", [False, True])
def test_one_address_is_dealt_by_blocks(spark, monkeypatch, inclusive):
    monkeypatch.setattr(attribution, "BLOCK", 16)
    draw = random.Random(7)
    probes = [(draw.choice(["a", "a", "a", "b", None]), i, i * 3) for i in range(400)]
    bound = [(draw.choice(["a", "b", "c", None]), draw.randrange(400), f"d{i:02d}") for i in range(40)] + [("a", 390, None)]
    p, b = spark.createDataFrame(probes, "ip string, packet_id long, x long"), spark.createDataFrame(bound, "ip string, packet_id long, domain string")

    def last(ip, at):
        return max(((w, d) for k, w, d in bound if k == ip and d is not None and (w < at or inclusive and w == at)), default=(0, None))[1]

    def following(ip, at):
        return min(((w, d or "", d) for k, w, d in bound if k == ip and w >= at), default=(None, "", None))

    df = attribution.as_of(p, b, inclusive=inclusive)
    assert {(r["packet_id"], r["ip"], r["x"], r["domain"]) for r in df.collect()} == {(at, ip, x, last(ip, at)) for ip, at, x in probes}
    windows = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert any("_block" in x for x in windows)
    if not inclusive:
        got = {(r["packet_id"], r["ip"], r["x"], r["domain"], r["bound_at"]) for r in attribution.next_binding(p, b).collect()}
        assert got == {(at, ip, x, following(ip, at)[2], following(ip, at)[0]) for ip, at, x in probes}


def test_frames_are_decoded_once(spark, tmp_path, monkeypatch):
    def sampled(*_):
        raise AssertionError("a range exchange decodes all frames for its sample")

    write_events(spark, tmp_path, 40, [1, 2])
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", sampled)
    assert catalogue.queries()["engine_events"](spark, str(tmp_path)).where("event_type like 'flow.%'").count() == 40
