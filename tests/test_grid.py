import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import grid
from siltstone.operators.event_time import FIRST_S, event_ns

READ = "reading_id bigint, db_name string, table_name string, source_id string, field_name string, time bigint, __timestamp bigint, value double, interval_s int, event_ns string, low int"
REG = "name string, timestamp_precision string, interval_s int"
LIM = "table_name string, field_name string, low double, high double"
S = 1704067200  # a midnight


def readings(spark, rows):
    """rows: (source, time, value[, table[, ingest]])"""
    full = [(i, "", r[3] if len(r) > 3 else "t", r[0], "f", r[1], r[4] if len(r) > 4 else None, r[2], 1, "clash", 7) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, READ)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("t", "s", 60), ("ms", "ms", 60), ("none", "s", None), ("t", "s", 60)], REG)


@pytest.mark.parametrize(("time", "precision", "want"), [(S, "ms", S * 10**9), (S * 1000, "s", S * 10**9), (S * 10**6 + 1, "s", S * 10**9 + 1000), (S * 10**9 + 5, "s", S * 10**9 + 5), (5, "s", 5 * 10**9), (-5, "ms", -5 * 10**6), (None, "s", 42), (2**62, "s", None), (FIRST_S, "ns", FIRST_S * 10**9), (1, None, None)])
def test_event_time(spark, time, precision, want):
    row = spark.createDataFrame([(time, precision)], "t bigint, p string").select(event_ns(F.col("t"), F.lit(42).cast("bigint"), F.col("p"))).first()
    assert row[0] == want


def series(spark, registry, rows, limits=None):
    got = grid.regular_series(readings(spark, rows), registry, limits).collect()
    return {(r.source_id, r.slot_start): (r.status, r.value) for r in got}


def test_slots(spark, registry):
    rows = [("a", S + 5, 1.0), ("a", S + 50, 3.0), ("a", S + 185, 5.0), ("a", S + 185, 5.0), ("a", S + 86400 + 600, 1.0), ("b", (S + 60) * 1000, 1.0), ("b", None, 2.0, "t", (S + 180) * 10**9),
            ("c", S, None), ("c", S + 120, 1.0), (None, S, 1.0), ("d", S, 1.0, "unknown"), ("e", S, 1.0, "none"), ("n", S, math.nan), ("n", S + 120, 2.0)]
    got = series(spark, registry, rows)
    assert {k: v for k, v in got.items() if v[0] == "observed"} == {
        ("a", S): ("observed", 2.0), ("a", S + 180): ("observed", 5.0), ("a", S + 86400 + 600): ("observed", 1.0), ("b", S + 60): ("observed", 1.0), ("b", S + 180): ("observed", 2.0),
        ("c", S + 120): ("observed", 1.0), ("n", S): ("observed", None), ("n", S + 120): ("observed", 2.0),
    }
    assert {k for k, v in got.items() if v[0] == "filled"} == {("a", S + 60), ("a", S + 120), ("b", S + 120), ("n", S + 60)}
    assert got[("a", S + 60)][1] == pytest.approx(3, abs=0.2) and got[("a", S + 120)][1] == pytest.approx(4, abs=0.2)


def test_empty(spark, registry):
    assert series(spark, registry, []) == {}


def test_against_brute_force(spark, registry):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(4)}", S + rng.randrange(3 * 86400), rng.random()) for _ in range(900)]
    seen = {(s, t // 60 * 60) for s, t, _ in rows}
    want = set()
    for s in {s for s, _ in seen}:
        for d in range(3):
            day = [t for q, t in seen if q == s and (t - S) // 86400 == d]
            want |= {(s, t) for t in range(min(day), max(day), 60)} - seen
    got = series(spark, registry, rows)
    assert {k for k, v in got.items() if v[0] == "filled"} == want
    assert all(v[1] is not None for v in got.values())


def test_fills_follow_season_and_trend(spark, registry):
    def truth(t):
        x = (t - S) / 86400
        return 20 + 3 * x + 5 * math.sin(2 * math.pi * x) + math.cos(4 * math.pi * x)

    gap = range(S + 2 * 86400 + 6 * 3600, S + 2 * 86400 + 16 * 3600)
    rows = [("a", t, truth(t)) for t in range(S, S + 5 * 86400, 300) if t not in gap]
    got = series(spark, registry, rows)
    errors = [abs(v - truth(t)) for (_, t), (status, v) in got.items() if status == "filled"]
    assert len(errors) > 5000 and max(errors) < 0.05


def test_impossible_values_do_not_bend_the_fill(spark, registry):
    limits = spark.createDataFrame([("t", "f", 0.0, 100.0)], LIM)
    got = series(spark, registry, [("a", S, 10.0), ("a", S + 60, 1e9), ("a", S + 240, 10.0)], limits)
    assert got[("a", S + 60)] == ("observed", None)
    assert got[("a", S + 120)][1] == pytest.approx(10, abs=0.1)


def test_the_whole_series_has_every_slot(spark, registry):
    rng = random.Random(7)
    rows = [(f"s{k}", S + 86400 * d + rng.randrange(3600 * 5, 3600 * 7), rng.random()) for k in range(3) for d in (0, 1, 4, 5, 9) for _ in range(3)]
    rows += [("late", S + 86399, 1.0), ("late", S + 86400 * 2 + 1, 3.0), ("nan", S, math.nan), ("nan", S + 86400 * 3, math.nan), ("half", S, 5.0), ("half", S + 86400 * 2, math.nan)]
    got = series(spark, registry, rows)
    for source in {r[0] for r in rows}:
        own = sorted(t // 60 * 60 for s, t, _ in rows if s == source)
        assert sorted(t for s, t in got if s == source) == list(range(own[0], own[-1] + 1, 60))
    assert got[("late", S + 86400)][0] == "between" and 1 < got[("late", S + 86400 + 43200)][1] < 3
    assert got[("nan", S + 86400)] == ("between", None) and got[("half", S + 86400)][1] == pytest.approx(5, abs=0.1)
    flat = grid.regular_series(readings(spark, rows), registry).groupBy("source_id", "slot_start").count().where("count > 1")
    assert flat.count() == 0


def test_an_interval_that_divides_no_day(spark, registry):
    odd = registry.sparkSession.createDataFrame([("t", "s", 7000)], REG)
    got = series(spark, odd, [("a", S, 1.0), ("a", S + 86400 * 3, 2.0)])
    first, last = S // 7000 * 7000, (S + 86400 * 3) // 7000 * 7000
    assert sorted(t for _, t in got) == list(range(first, last + 1, 7000))


def held_out(spark, tables, bridge):
    """Mean over sources of the median error of filled slots, in the source's scatter, for held-out hours of readings."""
    means = grid.slot_means(*tables).where("value is not null")
    hour = F.expr("slot_start div 3600")
    hidden = means.where(F.pmod(F.xxhash64("source_id", hour), F.lit(6)) == 0)
    left = means.join(hidden.select("source_id", "slot_start"), ["source_id", "slot_start"], "left_anti")
    rows = left.select(F.col("source_id"), F.lit("t").alias("table_name"), F.lit("f").alias("field_name"), F.col("slot_start").alias("time"), F.lit(0).cast("bigint").alias("__timestamp"), "value", "interval_s")
    out = []
    for step in sorted(r[0] for r in rows.select("interval_s").distinct().collect()):
        registry = spark.createDataFrame([("t", "s", step)], REG)
        series = grid.regular_series(rows.where(F.col("interval_s") == step).drop("interval_s"), registry, harmonics=0 if bridge else grid.HARMONICS)
        scored = series.where("status = 'filled'").join(hidden.withColumnRenamed("value", "true_value"), ["source_id", "slot_start"])
        out += scored.groupBy("source_id").agg(F.median(F.abs(F.col("value") - F.col("true_value"))).alias("error"), F.stddev("true_value").alias("scatter"), F.count("*").alias("n")).where("n >= 20 and scatter > 0").collect()
    return sum(r.error / r.scatter for r in out) / len(out)


def test_filled_values_against_held_out_readings(spark, testdata):
    """Over the readings' short gaps the seasonal fill is as good as a line between the readings around; it must not be worse."""
    tables = [spark.read.parquet(f"{testdata}/{n}.parquet") for n in ("readings", "table_registry", "field_limits")]
    assert held_out(spark, tables, False) <= 1.02 * held_out(spark, tables, True)
