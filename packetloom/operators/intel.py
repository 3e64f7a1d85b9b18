"""Provider scores, indicator matches, risk and behaviour measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import RISK_WEIGHTS

#: Rows of a reference table that may be broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a reference table if it is below the bound, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def doh_score(alpn: str, path: str, content_type: str) -> Column:
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return one(F.col(alpn) == "h2") + one(F.startswith(path, F.lit("/dns-query"))) + one(F.col(content_type) == "application/dns-message")


def dot_score(port: str, tls: str, known: str) -> Column:
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return one(F.col(tls)) + one(F.col(port) == 853) + one(F.col(known))


def known_providers(df: DataFrame, domain: str, providers: DataFrame) -> DataFrame:
    """Adds provider: whether the domain or a parent of it is listed."""
    names = small(providers.select(F.lower("domain").alias("_name")).distinct())
    labels = F.split(F.lower("_d"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = df.select(F.col(domain).alias("_d")).where("_d is not null").distinct().withColumn("_name", F.explode(parents))
    hits = hits.join(names, "_name", "left_semi").select("_d").distinct()
    return df.join(hits, df[domain] == hits["_d"], "left").withColumn("provider", F.col("_d").isNotNull()).drop("_d")


def match_indicators(packets: DataFrame, indicators: DataFrame) -> DataFrame:
    """packet_id, ip, label: indicators met at either end of a packet."""
    ends = packets.select("packet_id", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"))
    return ends.join(small(indicators.select("ip", "label").distinct()), "ip").select("packet_id", "ip", "label")


def labelled(df: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """Adds the label of a fingerprint; of repeated keys the last line counts."""
    last = table.groupBy("key").agg(F.max_by("label", "line_no").alias(name))
    return df.join(small(last), df[key] == last["key"], "left").drop("key")


def risk_score(weights: dict[str, int] = RISK_WEIGHTS) -> Column:
    """Sum of the weights of the boolean columns that are true, 255 at most."""
    return F.least(F.lit(255), sum((F.when(F.col(k), w).otherwise(0) for k, w in weights.items()), F.lit(0)))


def beacons(packets: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of hosts with their number of packets and the spread of the gaps between them: permille of deviation to mean, whole numbers."""
    w = Window.partitionBy("src_ip", "dst_ip").orderBy("packet_id")
    gaps = packets.withColumn("gap", F.col("timestamp_us") - F.lag("timestamp_us").over(w)).where("gap is not null")
    g = gaps.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd")).where(F.col("n") >= least)
    return g.select("src_ip", "dst_ip", "n", F.round(F.col("sd") * 1000 / F.col("mean"), 0).cast("long").alias("cv_permille"))


def fan_out(packets: DataFrame, seconds: int, least: int) -> DataFrame:
    """Sources that reach at least so many different destinations in a window."""
    tick = F.floor(F.col("timestamp_us") / (seconds * 1_000_000)) * (seconds * 1_000_000)
    pairs = packets.select("src_ip", tick.alias("tick_us"), "dst_ip").distinct()
    return pairs.groupBy("src_ip", "tick_us").agg(F.count("*").alias("destinations")).where(F.col("destinations") >= least)


def flood(packets: DataFrame, seconds: int, least: int) -> DataFrame:
    """Destinations that get at least so many packets in a window."""
    tick = F.floor(F.col("timestamp_us") / (seconds * 1_000_000)) * (seconds * 1_000_000)
    return packets.groupBy("dst_ip", tick.alias("tick_us")).agg(F.count("*").alias("packets")).where(F.col("packets") >= least)


def letter_entropy(df: DataFrame, name: str) -> DataFrame:
    """Adds entropy: Shannon entropy of the characters, thousandths of a bit, whole numbers."""
    letters = F.filter(F.split(name, ""), lambda x: x != "")
    n = F.size(letters)
    terms = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    h = F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return df.withColumn("entropy", F.round(h * 1000, 0).cast("long"))
