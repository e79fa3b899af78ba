import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import percentiles as P


def values(spark, rows):
    df = spark.createDataFrame(rows, "g string, part string, v double, digit int, p double")  # further columns with names the operator uses
    return df.where("v is not null").select("g", "part", P.order_key(F.col("v")).alias("key"))


def brute(rows, ps):
    groups = {}
    for g, part, v in rows:
        for key in {(g, part), (g, None)}:
            groups.setdefault(key, []).append(v)
    out = {}
    for (g, part), vs in groups.items():
        vs = sorted(vs, key=lambda x: (math.isnan(x), x))
        for p in ps:
            k = max(1, len(vs) - math.floor(len(vs) - p * len(vs)))
            out[g, part, p] = (len(vs), vs[k - 1])
    return out


def same(a, b):
    return a == b or math.isnan(a) and math.isnan(b)


def check(spark, rows, ps=(0.0, 0.25, 0.5, 0.9, 1.0)):
    assert all(r.whole == (r.part is None) for r in P.percentiles(values(spark, [(*r, 1, 1.0) for r in rows]), ["g"], ps).collect())
    got = {(r.g, r.part, r.p): (r.total, r.value) for r in P.percentiles(values(spark, [(*r, 1, 1.0) for r in rows]), ["g"], ps).collect()}
    want = brute([r for r in rows if r[2] is not None], ps)
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and same(got[k][1], v), k


def test_against_sorting(spark):
    rng = random.Random(1)
    odd = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0000000000000002]
    rows = [(rng.choice(["a", "b"]), rng.choice(["d1", "d2"]), rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), float(rng.randrange(5)), rng.choice(odd)])) for _ in range(3000)]
    rows += [("hot", "d1", 7.5)] * 2000 + [(None, "d1", 1.0), (None, "d1", 3.0), ("one", "d3", -2.0), ("nulls", "d1", None), ("a", None, 4.0)]
    rows = [r for r in rows if not (r[0] == "a" and r[1] is None)]
    check(spark, rows)


def test_values_without_a_part_count_in_the_whole(spark):
    got = {(r.part, r.p): r.value for r in P.percentiles(values(spark, [("a", None, 1.0, 0, 0.0), ("a", "d", 3.0, 0, 0.0), ("a", None, 2.0, 0, 0.0)]), ["g"], (0.5,)).collect()}
    assert got == {(None, 0.5): 2.0, ("d", 0.5): 3.0}


def test_a_part_of_any_name_is_a_part(spark):
    rows = [("a", "all", 1.0, 0, 0.0), ("a", "d", 3.0, 0, 0.0), ("a", "d", 5.0, 0, 0.0)]
    got = {(r.part, r.whole): (r.total, r.value) for r in P.percentiles(values(spark, rows), ["g"], (0.5,)).collect()}
    assert got == {("all", False): (1, 1.0), ("d", False): (2, 3.0), (None, True): (3, 3.0)}


def test_groups_keep_their_types(spark):
    rows = [(1, None, 2, 1.0), (1, None, 2, 2.0), (None, "x", 2, 5.0), (None, None, 3, 7.0), (1, "\x00", 3, 9.0)]
    df = spark.createDataFrame(rows, "a int, `b c` string, part int, v double").select("a", "b c", "part", P.order_key(F.col("v")).alias("key"))
    got = P.percentiles(df, ["a", "b c"], (1.0,))
    assert got.schema["a"].dataType.simpleString() == "int" and got.schema["part"].dataType.simpleString() == "int"
    assert sorted((r.a is None, r["b c"] is None, r.part, r.total, r.value) for r in got.where("not whole").collect()) == [(False, False, 3, 1, 9.0), (False, True, 2, 2, 2.0), (True, False, 2, 1, 5.0), (True, True, 3, 1, 7.0)]
    assert got.where("whole").count() == 4


def test_keys_are_the_bits_of_the_doubles(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1, 1) * 2.0 ** rng.randrange(-1060, 1024) + 0.0 for _ in range(5000)] + [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1024)] + [1.7976931348623157e308, 2.2250738585072014e-308, 2.225073858507201e-308]
    want = [b if b >= 0 else b ^ 0x7FFFFFFFFFFFFFFF for x in xs for b in struct.unpack("<q", struct.pack("<d", x))]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", "x", P.order_key(F.col("x")).alias("k"))
    rows = sorted(df.withColumn("back", P.value_of(F.col("k"))).collect())
    assert [r.k for r in rows] == want and [r.back for r in rows] == xs


def test_empty(spark):
    assert P.percentiles(values(spark, []), ["g"]).count() == 0


def test_states_add_up_and_keep_their_bound(spark):
    rng = random.Random(3)
    rows = [("a", f"d{rng.randrange(3)}", rng.choice([-1, 1]) * math.exp(rng.uniform(-20, 20)), 0, 0.0) for _ in range(4000)]
    v = values(spark, rows)
    parts = [P.histograms(v.where(f"part = 'd{k}'"), ["g"]) for k in range(3)]
    merged = {r.p: r.value for r in P.approximate(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"]).collect()}
    exact = {r.p: r.value for r in P.percentiles(v, ["g"]).where("part is null").collect()}
    assert merged.keys() == exact.keys()
    assert all(abs(merged[p] - exact[p]) <= abs(exact[p]) / 1024 for p in exact)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(), min_size=2, max_size=50))
def test_keys_keep_the_order(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", P.order_key(F.col("x")).alias("k"))
    rows = {r.i: (r.k, r.x) for r in df.select("i", "k", P.value_of(F.col("k")).alias("x")).collect()}
    assert all(same(rows[i][1], x) for i, x in enumerate(xs))
    for i, a in enumerate(xs):
        for j, b in enumerate(xs):
            if not math.isnan(a) and not math.isnan(b):
                assert (rows[i][0] < rows[j][0]) == (a < b)


def test_days_of_readings(spark):
    readings = spark.createDataFrame([("t", "f", 1704067200, 0, 1.0), ("t", "f", None, 1704153600 * 10**9, 2.0), ("t", "f", 1704067200000, 0, None), ("u", "f", None, None, 3.0)], "table_name string, field_name string, time bigint, __timestamp bigint, value double")
    registry = spark.createDataFrame([("t", "s", 60)], "name string, timestamp_precision string, interval_s int")
    assert sorted((r.table_name, r.part) for r in P.reading_values(readings, registry).collect() if r.part) == [("t", "2024-01-01"), ("t", "2024-01-02")]
    assert P.reading_values(readings, registry).count() == 3


@pytest.mark.parametrize("p", [0.07, 0.29, 0.57])
def test_ranks_of_shares_that_are_no_binary_fractions(spark, p):
    check(spark, [("a", "d", float(i)) for i in range(100)], (p,))
