import math
import random

import numpy as np
import pytest

from siltstone.operators import spikes

READ = "reading_id bigint, table_name string, source_id string, field_name string, time bigint, __timestamp bigint, value double, unit string, chunk int, at int"
S = 1704067200


@pytest.fixture(scope="module")
def dimensions(spark):
    return spark.createDataFrame([("t", "s", 60)], "name string, timestamp_precision string, interval_s int"), spark.createDataFrame([("t", "f", -1000.0, 1000.0), ("t", "passes", 0.0, 50.0)], "table_name string, field_name string, low double, high double")


def found(spark, dimensions, rows, **options):
    full = [(i, "t", r[0], r[3] if len(r) > 3 else "f", r[1], 0, r[2], "u", 1, 1) for i, r in enumerate(rows)]
    options.setdefault("counters", ("passes",))
    got = spikes.implausible(spark.createDataFrame(full, READ), *dimensions, **options).collect()
    assert len({r.reading_id for r in got}) == len(got)
    return {r.reading_id: r.reason for r in got}


def noisy(n, seed, level=lambda i: 20.0):
    rng = random.Random(seed)
    return [round(level(i) + rng.gauss(0, 1), 3) for i in range(n)]


def as_rows(values, source="a"):
    return [(source, S + 60 * i, v) for i, v in enumerate(values)]


def test_spikes_of_up_to_three_points(spark, dimensions):
    v = noisy(400, 1, lambda i: 20 + 3 * math.sin(i / 40))
    for at, size, height in ((50, 1, 12), (120, 2, -15), (200, 3, 30), (300, 4, 30)):
        for k in range(at, at + size):
            v[k] += height
    for k in range(350, 400):
        v[k] += 40  # a lasting change
    got = found(spark, dimensions, as_rows(v))
    assert got == dict.fromkeys([50, 120, 121, 200, 201, 202], "spike")


def test_stuck_and_impossible(spark, dimensions):
    v = noisy(200, 2)
    v[40:51] = [v[40]] * 11  # one short of a stuck run
    v[39], v[51] = v[40] - 0.5, v[40] + 0.5
    v[80:92] = [v[80]] * 12
    v[150] = 1000.0  # the bound itself is possible, though a spike
    v[160] = 1000.1
    got = found(spark, dimensions, as_rows(v))
    assert got == dict.fromkeys(range(80, 92), "stuck") | {150: "spike", 160: "impossible"}


def test_repeated_deliveries_count_once(spark, dimensions):
    v = noisy(120, 3)
    v[30:40] = [v[30]] * 10
    v[70] += 25
    rows = as_rows(v)
    again = [rows[k] for k in (30, 31, 32, 33, 70, 70)]
    assert found(spark, dimensions, rows + again) == {70: "spike", 124: "spike", 125: "spike"}


def test_order_is_by_event_time(spark, dimensions):
    v = noisy(120, 4)
    v[70] += 25
    rows = as_rows(v)
    random.Random(1).shuffle(rows)
    assert [rows[i] for i in found(spark, dimensions, rows)] == [("a", S + 60 * 70, v[70])]


def test_counters_and_constants(spark, dimensions):
    rows = [("p", S + 60 * i, float(i % 2) if i != 30 else 40.0, "passes") for i in range(60)] + [("p", S + 9999, 51.0, "passes")]
    rows += [("k", S + 60 * i, 5.0 if i % 40 else 6.0) for i in range(300)]  # a source that seldom changes
    assert found(spark, dimensions, rows) == {60: "impossible"}


def test_odd_rows(spark, dimensions):
    rows = [("a", S, None), (None, S, 2000.0), ("a", S, math.nan), ("a", None, 5.0), ("b", S, math.inf), ("c", S, 1.0), ("c", S, 2.0)]
    assert found(spark, dimensions, rows) == {1: "impossible", 2: "impossible", 4: "impossible"}
    assert found(spark, dimensions, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_chunks_make_no_difference(spark, dimensions, seed):
    rng = random.Random(seed)
    v = noisy(3000, seed, lambda i: 50 + 5 * math.sin(i / 200))
    for _ in range(40):
        at, size = rng.randrange(20, 2970), rng.randint(1, 3)
        for k in range(at, at + size):
            v[k] += 30
    for at in (256 - 6, 512 - 11, 1024 - 1, 2000):
        v[at : at + 12] = [v[at]] * 12
    whole = found(spark, dimensions, as_rows(v), chunk=100_000)
    parts = found(spark, dimensions, as_rows(v), chunk=256, halo=96)
    assert len(whole) > 80 and whole == parts


def test_a_run_of_whole_chunks(spark, dimensions):
    v = noisy(3000, 8)
    v[1000:1800] = [20.0] * 800
    assert found(spark, dimensions, as_rows(v), chunk=256) == dict.fromkeys(range(1000, 1800), "stuck")


def series(*columns):
    lengths = np.array([len(c) for c in columns])
    x, gone = np.zeros((max(lengths), len(columns))), np.ones((max(lengths), len(columns)), bool)
    for j, c in enumerate(columns):
        x[: len(c), j], gone[: len(c), j] = c, False
    return x, gone, lengths


def test_a_level_change_at_the_end_is_no_spike(spark, dimensions):
    v = noisy(100, 5)
    v[-2:] = [v[-2] + 40, v[-1] + 40]
    assert found(spark, dimensions, as_rows(v)) == {}


def test_filter_starts_again_after_a_change():
    x, gone, lengths = series(noisy(50, 6) + noisy(50, 7, lambda i: 80.0))
    assert not spikes.kalman(x, gone, lengths, np.array([1.0]), np.array([0.05]))[0].any()


def test_many_series_are_filtered_as_each_alone():
    columns = sorted((noisy(n, n, lambda i: 50.0 * (i > 60)) for n in (40, 90, 91, 200)), key=len, reverse=True)
    noise, drift = np.array([1.0, 2.0, 0.5, 1.0]), np.array([0.1, 0.01, 0.2, 0.3])
    together = spikes.kalman(*series(*columns), noise, drift)
    for j, c in enumerate(columns):
        alone = spikes.kalman(*series(c), noise[j : j + 1], drift[j : j + 1])
        for a, b in zip(together, alone, strict=True):
            assert np.array_equal(a[: len(c), j], b[:, 0])
    flagged, innovations, residuals = together
    news = innovations[1:200, 0] - residuals[:199, 0]  # what an innovation adds is the step of the reading
    assert np.allclose(news, np.diff(columns[0]))


def test_a_run_that_only_jitters_is_stuck(spark, dimensions):
    v = noisy(200, 9)
    v[60:90] = [v[60] + 1e-9 * (k % 3) for k in range(30)]
    assert found(spark, dimensions, as_rows(v)) == dict.fromkeys(range(60, 90), "stuck")


def test_calm_and_noisy_periods_are_judged_by_the_whole_source(spark, dimensions):
    """Spikes of one height over 6000 points, the second half far noisier; their fate follows from the source's scatter."""
    rng = random.Random(11)
    v = [rng.gauss(0, 1 if i < 3000 else 4) for i in range(6000)]
    for at in range(100, 5900, 200):
        v[at] = 60.0
    whole = found(spark, dimensions, as_rows(v), chunk=100_000)
    assert {i for i, r in whole.items() if r == "spike"} >= set(range(100, 5900, 200))
    assert found(spark, dimensions, as_rows(v), chunk=512) == whole == found(spark, dimensions, as_rows(v))


def test_counters_are_an_argument(spark, dimensions):
    rows = [("p", S + 60 * i, float(i % 2) if i != 30 else 40.0, "passes") for i in range(60)]
    assert found(spark, dimensions, rows, counters=()) == {30: "spike"}


@pytest.mark.parametrize("width", [8, 64])
def test_medians_of_bins(spark, width):
    rng = random.Random(4)
    values = {s: [rng.lognormvariate(m, 1.5) for _ in range(501)] for s, m in (("a", 0), ("b", -20), ("c", 30))}
    rows = [(s, math.floor(width * math.log2(x)), 1) for s, xs in values.items() for x in xs]
    bins = spark.createDataFrame(rows, "source_id string, bin int, n bigint").groupBy("source_id", "bin").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    got = {r.source_id: r.median for r in spikes.median_of_bins(bins, width).collect()}
    assert all(abs(math.log2(got[s] / sorted(xs)[250])) < 1 / width for s, xs in values.items())
