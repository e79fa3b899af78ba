import itertools
import json
import random
from datetime import datetime, timedelta

import pytest

from siltstone.operators import schema_drift

SNAP = "snapshot_id bigint, seen_at timestamp_ntz, db_name string, name string, field_names array<string>, field_types array<string>, timestamp_field string, timestamp_precision string, change string, day string"
BATCH = "batch_id bigint, snapshot_id bigint, received_at timestamp_ntz, db_name string, table_name string, data string, error string, pair string"
T0 = datetime(2016, 1, 1)


def snap(i, hours, fields, db="db", name="t", clock="time"):
    fields = {clock: "INT8"} | fields
    return (i, T0 + timedelta(hours=hours), db, name, list(fields), list(fields.values()), clock, "s", "x", "x")


def batch(i, snapshot, columns, hours=0):
    return (i, snapshot, T0 + timedelta(hours=hours), "", "t", json.dumps(columns), None, "x")


def found(spark, snaps, batches):
    return sorted(map(tuple, schema_drift.changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(batches, BATCH)).collect()))


S = 1451606400


def test_kinds_of_change(spark):
    snaps = [
        snap(3, 0, {"a": "FLOAT8", "b": "INT8", "gone": "VARCHAR", "k": "BIGINT"}),
        snap(1, 30, {"k": "LONG", "b": "VARCHAR", "a2": "DOUBLE", "new": "TEXT"}),  # another day, ids out of order, aliases, order
        snap(2, 31, {"k": "INT8", "b": "CHAR", "a2": "Float64", "new": "String"}),  # nothing changed
    ]
    batches = [
        batch(1, 3, {"time": [S, S + 1, S + 2], "a": [1, 2.5, 3], "b": [1, 2, 3], "gone": ["x", "y", "z"], "k": [1, 1, 1]}),
        batch(2, 1, {"time": [S + 2, S + 1, S + 9], "a2": [3.0, 2.5, 7], "b": ["3", "2", "1"], "new": ["n", "m", "o"], "k": [1, 1, 1]}),
        (3, None, None, None, None, None, "bad line", None),
    ]
    want = [(1, "added", "new"), (1, "removed", "gone"), (1, "renamed", "a2"), (1, "retyped", "b")]
    assert found(spark, snaps + snaps[:1], batches + batches) == want  # repeated rows change nothing


def test_not_renamed(spark):
    snaps = [snap(1, 0, {"a": "FLOAT8", "N": "INT8"}), snap(2, 1, {"b": "FLOAT8", "n": "VARCHAR"})]
    apart = [batch(1, 1, {"time": [S], "a": [1.0], "N": [1]}), batch(2, 2, {"time": [S + 1], "b": [1.0], "n": ["1"]})]
    want = [(2, "added", "b"), (2, "added", "n"), (2, "removed", "N"), (2, "removed", "a")]
    assert found(spark, snaps, apart) == want  # no shared time
    unlike = [batch(1, 1, {"time": [S, S + 1], "a": [1.0, 2.0], "N": [1, 2]}), batch(2, 2, {"time": [S, S + 1], "b": [1.0, 2.1], "n": ["1", "2"]})]
    assert found(spark, snaps, unlike) == want  # one value differs; equal values of another type
    nulls = [batch(1, 1, {"time": [S], "a": [None], "N": [1]}), batch(2, 2, {"time": [S], "b": [None], "n": ["1"]})]
    assert found(spark, snaps, nulls) == want
    assert found(spark, snaps, []) == want


def test_equal_columns_are_assigned_by_name(spark):
    snaps = [snap(1, 0, {"alpha": "FLOAT8", "omega": "FLOAT8"}), snap(2, 1, {"omega_x": "FLOAT8", "my_alpha": "FLOAT8", "third": "FLOAT8"})]
    batches = [batch(1, 1, {"time": [S], "alpha": [5], "omega": [5]}), batch(2, 2, {"time": [S], "omega_x": [5], "my_alpha": [5], "third": [5]})]
    assert found(spark, snaps, batches) == [(2, "added", "third"), (2, "renamed", "my_alpha"), (2, "renamed", "omega_x")]


def test_renames_that_changed_some_values(spark):
    """Of a hundred values five are corrected with the rename; another column of the type and a like name is no match."""
    rng = random.Random(3)
    temp, other = [round(rng.gauss(20, 5), 3) for _ in range(100)], [round(rng.gauss(20, 5), 3) for _ in range(100)]
    again = [v + 0.5 if i % 20 == 7 else v for i, v in enumerate(temp)]
    snaps = [snap(1, 0, {"temperature": "FLOAT8", "x": "FLOAT8"}), snap(2, 1, {"t_celsius": "FLOAT8", "temperature2": "FLOAT8"})]
    times = [S + i for i in range(100)]
    batches = [batch(1, 1, {"time": times, "temperature": temp, "x": [0.5] * 100}), batch(2, 2, {"time": times, "t_celsius": again, "temperature2": other})]
    frames = spark.createDataFrame(snaps, SNAP), spark.createDataFrame(batches, BATCH)
    loose = sorted(map(tuple, schema_drift.changes(*frames, least=0.6).collect()))
    assert loose == [(2, "added", "temperature2"), (2, "removed", "x"), (2, "renamed", "t_celsius")]
    assert found(spark, snaps, batches) == [(2, "added", "t_celsius"), (2, "added", "temperature2"), (2, "removed", "temperature"), (2, "removed", "x")]
    points = {(r.field_name, r.time): r.value for r in schema_drift.unified_points(*frames, least=0.6).collect()}
    assert {f for f, _ in points} == {"t_celsius", "temperature2", "x"} and points["t_celsius", (S + 7) * 10**9] == str(again[7])


def test_matching_takes_the_best_of_all():
    column = lambda name, sums, minima: {"name": name, "sums": sums, "minima": minima}
    old = [column("a", 1, [1, 2, 3, 4]), column("b", 2, [1, 2, 3, 9])]
    new = [column("p", 3, [1, 2, 3, 4]), column("q", 4, [1, 2, 7, 4]), column("r", 2, [8, 8, 8, None])]
    assert sorted(schema_drift.match_columns(old, new, 0.5)) == [("a", "p", 1.0), ("b", "r", 1.0)]
    assert schema_drift.match_columns(old, new, 1.0) == [("b", "r", 1.0)]
    assert schema_drift.match_columns(old, [], 0.5) == schema_drift.match_columns([], new, 0.5) == []


def test_odd_states(spark):
    snaps = [(1, T0, None, "t", None, None, None, None, "x", "x"), (2, T0 + timedelta(1), None, "t", ["a", None, "a"], ["INT8", "INT8", "INT8"], "time", "s", "x", "x"), (None, None, "d", "t", ["q"], ["INT8"], "time", "s", "x", "x"),
             (4, T0, "other", "t", ["z"], ["INT8"], "time", "s", "x", "x")]
    assert found(spark, snaps, [batch(1, 2, {"time": []}), (9, 2, T0, "", "t", "no json", None, None)]) == [(2, "added", "a")]
    assert found(spark, [], []) == []


def test_previous_over_days(spark):
    random.seed(2)
    snaps = [snap(i, random.random() * 200, {}, name=f"t{i % 3}") for i in range(120)]
    rows = schema_drift.with_previous(schema_drift.states(spark.createDataFrame(snaps, SNAP))).collect()
    got = {r.snapshot_id: r.previous.snapshot_id if r.previous else None for r in rows}
    want = {}
    for k in range(3):
        order = sorted((s for s in snaps if s[3] == f"t{k}"), key=lambda s: (s[1], s[0]))
        want |= {b[0]: a[0] if a else None for a, b in zip([None, *order], order, strict=False)}
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_the_best(seed):
    rng = random.Random(seed)
    names = lambda n: ["".join(rng.choices("abc_", k=rng.randint(1, 5))) + str(i) for i in range(n)]
    old, new = names(rng.randint(1, 4)), names(rng.randint(1, 4))
    got = sum(schema_drift.name_similarity(a, b) for a, b in schema_drift.assign(old, new))
    few, many = sorted((old, new), key=len)
    best = max(sum(schema_drift.name_similarity(a, b) for a, b in zip(few, p, strict=True)) for p in itertools.permutations(many, len(few)))
    assert got == pytest.approx(best)
    assert len(schema_drift.assign(old, new)) == len(few)


def test_one_table_of_all_points(spark):
    snaps = [snap(1, 0, {"a": "INT8"}), snap(2, 1, {"b": "INT8"}), snap(3, 2, {"c": "INT8", "a": "VARCHAR"}), snap(4, 3, {"c": "FLOAT8", "a": "VARCHAR"})]
    batches = [
        batch(1, 1, {"time": [S, S + 1], "a": [1, 2]}),
        batch(2, 2, {"time": [S + 1, S + 2], "b": [2, 3]}, 1),
        batch(3, 3, {"time": [S + 2, S + 3], "c": [3, 4], "a": ["p", "q"]}, 2),
        batch(4, 4, {"time": [S + 3, S + 4], "c": [4, 5.5], "a": ["q", "r"]}, 3),
        batch(4, 4, {"time": [S + 3, S + 4], "c": [4, 5.5], "a": ["q", "r"]}, 3),
    ]
    rows = schema_drift.unified_points(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(batches, BATCH)).collect()
    got = {(r.field_name, r.time // 10**9 - S): (r.type, r.value) for r in rows}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if k[0] == "c"} == {("c", i): ("FLOAT8", v) for i, v in enumerate(["1", "2", "3", "4", "5.5"])}
    assert {k[1] for k in got if k[0] == "a"} == {2, 3, 4}
