"""Percentiles per group by radix selection.

Floating values become integers of the same order. A histogram of the leading digit gives, for each
target rank, the digit that holds it; only values with that digit are counted by the next digit, and
so on until the value is known in full. The first histograms are states that can be added up over
parts (partitions, days); alone they bound the error to 2**-10 of the value.

Scale: values are read twice, for the first digit and for those with a wanted first digit, which are written with
their counts; every round has partial aggregation. A group over all its parts is counted by adding up its parts'
histograms, so no row is read or moved twice for it. A group with a third of all values is a histogram of at
most 2**22 rows a part, never a list of values. Keys never go through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.event_time import with_registry
from siltstone.session import checked_broadcast, materialise

PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Bits below the first and below the second digit.
LOW, MIDDLE = 42, 21
#: Wanted digits, of some sixty bytes each, that are sent to all tasks; beyond it values are joined with them by shuffle.
WANTED = 500_000
_INFINITY, _NAN = 0x7FF0000000000000, 0x7FF8000000000000


def order_key(value: Column) -> Column:
    """Doubles as bigints of the same order; NaN above all, both zeros equal.

    The bits are put together from exponent and mantissa: powers of two are exact, so the mantissa is."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    part = size * F.pow(F.lit(2.0), -guess)
    exponent = guess - (part < 1).cast("bigint") + (part >= 2).cast("bigint")
    mantissa = size * F.pow(F.lit(2.0), -exponent) - 1
    normal = F.shiftleft(exponent + 1023, 52) + (mantissa * F.lit(2.0**52)).cast("bigint")
    small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = F.when(F.isnan(value), F.lit(_NAN)).when(size == float("inf"), F.lit(_INFINITY)).when(size < 2.0**-1022, small).when(size.isNotNull(), normal)
    return F.when(value < 0, -bits - 1).otherwise(bits)


def value_of(key: Column) -> Column:
    """The double of an order key."""
    bits = F.when(key < 0, -key - 1).otherwise(key)
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (F.lit(1.0) + fraction * F.lit(2.0**-52)) * F.pow(F.lit(2.0), exponent - 1023)
    small = fraction * F.lit(2.0**-537) * F.lit(2.0**-537)
    size = F.when(bits > _INFINITY, F.lit(float("nan"))).when(bits == _INFINITY, F.lit(float("inf"))).when(exponent == 0, small).otherwise(normal)
    return F.when(key < 0, -size).otherwise(size)


def histograms(values: DataFrame, groups: list[str], part: str = "part") -> DataFrame:
    """States (groups, part, digit, n): values by leading digit, that is sign, exponent and ten bits.

    `values` has the group columns, `part` (a day, a file, any string or null) and `key`. States of
    unlike parts or inputs are combined by `combine`.
    """
    return values.groupBy(*groups, part, F.shiftright("key", LOW).alias("digit")).agg(F.count("*").alias("n"))


def combine(states: DataFrame, groups: list[str]) -> DataFrame:
    """States of any number of parts as one."""
    return states.groupBy(*groups, "digit").agg(F.sum("n").alias("n"))


def _first(counts: DataFrame, by: list[str], probabilities: tuple[float, ...]) -> DataFrame:
    """(by, p, total, rank, digit): for each target the digit that holds it, and its rank within that digit."""
    whole = Window.partitionBy(*by)
    sums = counts.withColumn("upto", F.sum("n").over(whole.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(whole))
    rank = lambda p: F.greatest(F.lit(1), F.col("total") - F.floor(F.col("total") - p * F.col("total"))).cast("bigint")
    targets = F.array(*(F.struct(F.lit(float(p)).alias("p"), rank(F.lit(float(p))).alias("rank")) for p in probabilities))
    here = sums.withColumn("t", F.explode(F.filter(targets, lambda t: (t["rank"] > F.col("upto") - F.col("n")) & (t["rank"] <= F.col("upto")))))
    return here.select(*by, F.col("t.p").alias("p"), "total", (F.col("t.rank") - (F.col("upto") - F.col("n"))).alias("rank"), "digit")


def _next(counts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Targets with a further digit: `counts` (by, prefix, next, n) are of the values with the digit found so far."""
    w = Window.partitionBy(*by, "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    found = sums.join(targets.withColumnRenamed("digit", "prefix"), [*by, "prefix"]).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
    return found.select(*by, "p", "total", (F.col("rank") - F.col("before")).alias("rank"), (F.shiftleft("prefix", MIDDLE) + F.col("next")).alias("digit"))


def approximate(states: DataFrame, groups: list[str], probabilities: tuple[float, ...] = PROBABILITIES) -> DataFrame:
    """(groups, p, total, value): percentiles from states alone, each the lower end (towards zero) of
    its digit, so it is off by less than 2**-10 of the true value (or is a subnormal number)."""
    found = _first(combine(states, groups), groups, probabilities)
    low = F.shiftleft("digit", LOW)
    key = F.when(F.col("digit") < 0, low + F.lit((1 << LOW) - 1)).otherwise(low)
    return found.select(*groups, "p", "total", value_of(key).alias("value"))


def _wanted(values: DataFrame, targets: DataFrame, above: int) -> DataFrame:
    """The values (g, part, key, ...) whose leading digits hold a target of their part (`in_part`) or of their group (`in_whole`)."""
    held = targets.select("k", F.col("digit").alias("prefix")).distinct()
    of_part = held.where("not k.whole").select(F.struct("k.g", "k.part", "prefix").alias("a"), F.lit(True).alias("in_part"))
    of_whole = held.where("k.whole").select(F.struct("k.g", "prefix").alias("b"), F.lit(True).alias("in_whole"))
    rows = values.withColumn("prefix", F.shiftright("key", above))
    rows = rows.withColumn("a", F.struct("g", "part", "prefix")).withColumn("b", F.struct("g", "prefix"))
    rows = rows.join(checked_broadcast(of_part, WANTED), "a", "left").join(checked_broadcast(of_whole, WANTED), "b", "left")
    return rows.where("in_part or in_whole").drop("a", "b")


def percentiles(values: DataFrame, groups: list[str], probabilities: tuple[float, ...] = PROBABILITIES) -> DataFrame:
    """(groups, part, whole, p, total, value): exact percentiles of each part (whole = false) and of all parts of
    a group together (whole = true, part null): the least value with at least the share p of the values at or below.

    `values` has the group columns, of any types that can be compared, `part` (null: only in the whole) and
    `key`. Groups may be null; ties and repeated rows count each; an empty table gives no rows.
    """
    # keys are structs, which are equal where their nulls are
    rows = values.select(F.struct(*groups).alias("g"), "part", "key")
    states = materialise(histograms(rows, ["g"]), "digits")
    part_type = states.schema["part"].dataType
    level = lambda part, whole: F.struct("g", part.alias("part"), F.lit(whole).alias("whole")).alias("k")
    of_part = states.where("part is not null").select(level(F.col("part"), False), "digit", "n")
    of_whole = combine(states, ["g"]).select(level(F.lit(None).cast(part_type), True), "digit", "n")
    targets = materialise(_first(of_part.unionByName(of_whole), ["k"], probabilities), "targets")
    kept = _wanted(rows, targets, LOW).groupBy("g", "part", "key").agg(F.count("*").alias("n"))
    kept = materialise(kept, "wanted")
    mask = F.lit((1 << MIDDLE) - 1)
    for above, below in ((LOW, MIDDLE), (MIDDLE, 0)):
        here = _wanted(kept, targets, above).withColumn("next", F.shiftright("key", below).bitwiseAND(mask))
        counts = here.groupBy("g", "part", "prefix", "next").agg(F.sum("n").alias("n"), F.first("in_part").alias("in_part"), F.first("in_whole").alias("in_whole"))
        of_part = counts.where("in_part").select(level(F.col("part"), False), "prefix", "next", "n")
        of_whole = counts.where("in_whole").groupBy("g", "prefix", "next").agg(F.sum("n").alias("n")).select(level(F.lit(None).cast(part_type), True), "prefix", "next", "n")
        targets = _next(of_part.unionByName(of_whole), targets, ["k"])
        if below:
            targets = materialise(targets, "targets")
    return targets.select(*(F.col(f"k.g.`{g}`").alias(g) for g in groups), F.col("k.part").alias("part"), F.col("k.whole").alias("whole"), "p", "total", value_of(F.col("digit")).alias("value"))


def reading_values(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """Non-null readings as (table_name, field_name, part, key); part is the UTC day of the event,
    null where a reading has no event time."""
    rows = with_registry(readings.select("table_name", "field_name", "time", "__timestamp", "value").where("value is not null"), registry, "left")
    day = F.date_format(F.timestamp_seconds(F.expr("event_ns div 1000000000 - if(event_ns % 1000000000 < 0, 1, 0)")), "yyyy-MM-dd")
    return rows.select("table_name", "field_name", day.alias("part"), order_key(F.col("value")).alias("key"))
