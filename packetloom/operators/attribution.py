"""Domain names for addresses: as-of joins over observed bindings.

Bindings and probes are united and a window carries the last (or next) name
along, so no pairs are formed.  An address may have most of a capture, so its rows are
dealt by blocks of positions; one small row brings into a block what those before it leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Positions of a block: the most rows of one address that a task must sort together, if positions are distinct.
BLOCK = 1 << 17


def _carried(probes: DataFrame, bound: DataFrame, key: str, at: str, side: int, ahead: bool, places: DataFrame | None) -> DataFrame:
    """key, at, _row (the other columns), _value of the last row of ``bound`` (key, at, _value) before each probe, or (``ahead``) of the next."""
    columns = [c for c in probes.columns if c not in (key, at)]
    block = F.expr(f"`{at}` div {BLOCK}").alias("_block")
    order = lambda c: F.desc_nulls_last(c) if ahead else F.asc_nulls_first(c)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.min_by if ahead else F.max_by
    value_type = bound.schema["_value"].dataType
    bound = bound.where("_value is not null")
    # Blocks with probes and the value that each block with bindings leaves.
    seen = (probes if places is None else places).select(key, block).distinct().select(key, "_block", F.lit(0).alias("_side"), F.lit(None).cast(value_type).alias("_value"))
    left = bound.groupBy(key, block).agg(pick("_value", F.struct(at, "_value")).alias("_value")).select(key, "_block", F.lit(1).alias("_side"), "_value")
    across = upto(Window.partitionBy(key).orderBy(order("_block"), "_side"))
    brought = seen.unionByName(left).withColumn("_value", F.last_value("_value", ignoreNulls=True).over(across)).where("_side = 0 and _value is not null")
    p = probes.select(key, at, block, F.lit(side).alias("_side"), F.struct(F.lit(1).alias("_x"), *columns).alias("_row"), F.lit(None).cast(value_type).alias("_value"))
    none = F.lit(None).cast(p.schema["_row"].dataType).alias("_row")
    b = bound.select(key, at, block, F.lit(1).alias("_side"), none, "_value")
    first = brought.select(key, F.lit(None).cast(p.schema[at].dataType).alias(at), "_block", F.lit(9 if ahead else -1).alias("_side"), none, "_value")
    within = [F.desc_nulls_first(at), F.desc("_side"), F.desc("_value")] if ahead else [F.asc_nulls_first(at), F.asc("_side"), F.asc("_value")]
    w = upto(Window.partitionBy(key, "_block").orderBy(*within))
    both = p.unionByName(b).unionByName(first).withColumn("_value", F.last_value("_value", ignoreNulls=True).over(w)).where(F.col("_side") == side)
    return both.select(key, at, *(F.col(f"_row.{c}").alias(c) for c in columns), "_value")


def as_of(probes: DataFrame, bindings: DataFrame, key: str = "ip", at: str = "packet_id", value: str = "domain", inclusive: bool = False, places: DataFrame | None = None) -> DataFrame:
    """Adds the value of the last binding of the key before each probe (``inclusive``: at the same position too).

    Positions are whole numbers.  ``places`` (key, at of all probes, or more) saves computing the probes twice.
    Of bindings at one position the greatest value counts.
    """
    bound = bindings.select(key, at, F.col(value).alias("_value"))
    return _carried(probes, bound, key, at, 2 if inclusive else 0, False, places).withColumnRenamed("_value", value)


def next_binding(probes: DataFrame, bindings: DataFrame, key: str = "ip", at: str = "packet_id", value: str = "domain", places: DataFrame | None = None) -> DataFrame:
    """Adds the value and position of the first binding at or after each probe (rebinding of unnamed flows)."""
    bound = bindings.select(key, at, F.struct(F.col(value), F.col(at).alias("bound_at")).alias("_value"))
    found = _carried(probes, bound, key, at, 0, True, places)
    return found.select(*(c for c in found.columns if c != "_value"), f"_value.{value}", "_value.bound_at")


def latest_bindings(bindings: DataFrame, keep: int | None = None) -> DataFrame:
    """The cache after all bindings: the last name of each address; with ``keep`` only the
    addresses whose first binding is among the last ``keep`` (first in, first out)."""
    out = bindings.groupBy("ip").agg(F.max_by("domain", "packet_id").alias("domain"), F.min("packet_id").alias("first_at"))
    return out if keep is None else out.orderBy(F.desc("first_at")).limit(keep)
