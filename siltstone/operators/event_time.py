"""Event times of parsed points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nanoseconds per unit, by precision.
UNIT_NS = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}
#: Epoch seconds of the years events may lie in (2016 to 2025); no two precisions overlap in it.
FIRST_S, LAST_S = 1451606400, 1767225600


def event_ns(time: Column, ingest_ns: Column, precision: Column) -> Column:
    """Nanoseconds since the epoch of a time in its registered precision, or in the one in which it
    falls into the years of events; the ingest time where it is null. Out of the years in every
    precision, the registered one counts, and null if that overflows."""
    fits = lambda unit: time.between(FIRST_S * (10**9 // unit), LAST_S * (10**9 // unit) - 1)
    out = F.when(time.isNull(), ingest_ns)
    for unit in UNIT_NS.values():
        out = out.when(fits(unit), time * F.lit(unit))
    for name, unit in UNIT_NS.items():
        out = out.when((precision == name) & (F.abs(time.cast("double")) < 9.2e18 / unit), time * F.lit(unit))
    return out


def with_registry(readings: DataFrame, registry: DataFrame, how: str = "inner") -> DataFrame:
    """Readings with interval_s and event_ns. The registry is a fixed, small dimension by table
    name; only its first row per name counts. Readings of unknown tables stay out, or with how="left" come
    without an interval."""
    from siltstone.session import checked_broadcast

    known = registry.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("interval_s", "timestamp_precision")).alias("r"))
    known = known.select(F.col("name").alias("table_name"), F.col("r.interval_s").alias("interval_s"), F.col("r.timestamp_precision").alias("precision"))
    joined = readings.join(checked_broadcast(known), "table_name", how)
    return joined.withColumn("event_ns", event_ns(F.col("time"), F.col("__timestamp"), F.col("precision"))).drop("precision")
