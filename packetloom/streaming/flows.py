"""Flows over a stream of packets: event-time sessions and a stateful flow table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.flows import KEY, with_flow_key

#: One microsecond less than the idle time, as Spark merges sessions that touch.
GAP = "119.999999 seconds"


def session_flows(packets: DataFrame, late: str = "10 seconds", gap: str = GAP) -> DataFrame:
    """Flow sessions by event time; rows leave when the watermark has passed their end."""
    p = with_flow_key(packets).withColumn("ts", F.timestamp_micros("timestamp_us"))
    w = F.session_window("ts", gap)
    out = p.withWatermark("ts", late).groupBy(*KEY, w).agg(F.count("*").alias("packets"), F.sum(F.col("payload_len").cast("long")).alias("bytes"), F.min("timestamp_us").alias("first_seen_us"), F.max("timestamp_us").alias("last_seen_us"))
    return out.drop("session_window")


STATE = "packets long, tx long, rx long, src_ip string, src_port int, first_us long, last_us long"
OUT = "ip1 string, port1 int, ip2 string, port2 int, src_ip string, packets long, bytes_sent long, bytes_received long, first_seen_us long, last_seen_us long, closed boolean"


def flow_table(packets: DataFrame, idle_us: int = 120_000_000, late: str = "10 seconds") -> DataFrame:
    """Running flow rows (update mode); a flow is closed by an idle gap or by the event-time timeout."""
    p = with_flow_key(packets).withColumn("ts", F.timestamp_micros("timestamp_us")).withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda s, closed: pd.DataFrame([(*key, s[3], s[0], s[1], s[2], s[5], s[6], closed)], columns=[c.split()[0] for c in OUT.split(", ")])
        if state.hasTimedOut:
            yield row(state.get, True)
            state.remove()
            return
        s = list(state.get) if state.exists else None
        for r in pd.concat(list(batches)).sort_values("packet_id").itertuples():
            if s is not None and r.timestamp_us - s[6] >= idle_us:
                yield row(s, True)
                s = None
            if s is None:
                s = [0, 0, 0, r.src_ip, int(r.src_port), int(r.timestamp_us), int(r.timestamp_us)]
            s[0] += 1
            s[1 if (r.src_ip, r.src_port) == (s[3], s[4]) else 2] += int(r.payload_len)
            s[6] = max(s[6], int(r.timestamp_us))
        state.update(tuple(s))
        state.setTimeoutTimestamp(max(s[6] // 1000 + idle_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield row(s, False)

    return p.groupBy(*KEY).applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
