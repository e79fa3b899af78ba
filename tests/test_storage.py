import gzip
import json
import os
import threading
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone import config
from siltstone.gateway import BadLines, Body, Writer, route, serve, write_bodies, write_body
from siltstone.operators.bad_rows import parse_lines
from siltstone.plans import compaction
from siltstone.plans.catalog import INGEST, CatalogError, Lakehouse, TableSpec, from_request
from siltstone.plans.manifest import Entry, Manifest
from siltstone.plans.query import run, run_script, to_json
from siltstone.sources import datasource
from siltstone.sources.files import s3_location, s3_options
from siltstone.sources.union import read_union
from siltstone.streaming.ingest import ingest, read_lines, schema_id, sessions, windowed
from siltstone.types import canonical_type, common_type, spark_type


def entry(name, size=1, lo=0, hi=0, rows=1):
    return Entry(name, size, rows, lo, hi)


# -- types and settings


def test_types(spark):
    assert [spark_type(t) for t in ("LONG", "UInt64", "float8", " text ")] == ["bigint", "decimal(20,0)", "double", "string"]
    with pytest.raises(ValueError, match="unknown"):
        spark_type("blob")
    assert [common_type(*p) for p in (("bigint", "double"), ("double", "string"), ("bigint", "decimal(20,0)"), ("int", "int"), ("boolean", "bigint"))] == ["double", "string", "decimal(20,0)", "int", "string"]
    df = spark.createDataFrame([("Int64",), ("blob",), (None,)], "t string")
    assert [r[0] for r in df.select(canonical_type(F.col("t"))).collect()] == ["INT8", "BLOB", None]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"root": "/x", "no_merges": true, "other": 1}')
    s = config.load(str(tmp_path / "c.json"), {"SILTSTONE_PORT": "80", "SILTSTONE_ENABLED": "false", "SILTSTONE_SAVE_TIMEOUT_S": "0.5"})
    assert (s.root, s.no_merges, s.port, s.enabled, s.save_timeout_s) == ("/x", True, 80, False, 0.5)


def test_object_store_url():
    o = s3_options("s3://k%2F:s@host:9000/bucket/p?secure=false&region=eu")
    assert o["fs.s3a.access.key"] == "k/" and o["fs.s3a.endpoint"] == "host:9000" and o["fs.s3a.connection.ssl.enabled"] == "false" and o["fs.s3a.endpoint.region"] == "eu"
    assert s3_location("s3://k:s@host/bucket/p/") == "s3a://bucket/p"


# -- plans and manifests


@pytest.mark.parametrize(("sizes", "cap", "want"), [([60, 50, 30, 20, 10], 100, [[0, 1], [2, 3, 4]]), ([60, 50, 30, 20, 10], 1000, [[0, 1, 2, 3, 4]]), ([], 5, []), ([9], 5, [[0]]), ([5, 5], 10, [[0, 1]])])
def test_bins(sizes, cap, want):
    assert compaction.bins(sizes, cap) == want


@given(st.lists(st.integers(0, 50)), st.integers(1, 100))
def test_a_plan_covers_each_file_once(sizes, cap):
    files = [entry(f"{i}.1.parquet", s) for i, s in enumerate(sizes)] + [entry("x.2.parquet", 1), entry("odd", 1)]
    merges = compaction.plan(files, compaction.Tier(1, cap, 1))
    names = [s for m in merges for s in m.sources]
    assert sorted(names) == sorted(f.path for f in files[: len(sizes)])
    size = {f.path: f.size_bytes for f in files}
    assert all(sum(size[s] for s in m.sources[:-1]) <= cap for m in merges)
    assert all(m.target.endswith(".2.parquet") for m in merges)


def test_candidates_and_tiers():
    files = [entry("a.1.parquet", 5), entry("b.1.parquet", 9), entry("c.11.parquet", 7), entry("d.2.parquet", 8)]
    assert [f.path for f in compaction.candidates(files, 1)] == ["b.1.parquet", "a.1.parquet"]
    assert [(t.level, t.max_bytes >> 20, t.every) for t in compaction.TIERS] == [(1, 100, 1), (2, 400, 10), (3, 4000, 100), (4, 4000, 420)]
    assert compaction.due(compaction.TIERS[1], 0, 100, 10) and not compaction.due(compaction.TIERS[1], 1, 100, 10)
    assert compaction.plan([entry("a.1.parquet")], compaction.TIERS[0], 2) == []


@given(st.lists(st.tuples(st.integers(0, 6), st.booleans(), st.integers(-5, 5), st.integers(0, 5), st.integers(0, 9)), max_size=30))
def test_totals_follow_files(steps):
    m = Manifest("t")
    for name, add, lo, span, rows in steps:
        m.add([entry(str(name), rows, lo, lo + span, rows)]) if add else m.remove([str(name)])
    files = list(m.files.values())
    assert m.row_count == m.parquet_size_bytes == sum(f.row_count for f in files)
    again = Manifest.loads(m.dumps())
    assert again.dumps() == m.dumps()
    if files:
        assert (m.min_time, m.max_time) == (min(f.min_time for f in files), max(f.max_time for f in files)) or m.min_time <= min(f.min_time for f in files)


def test_drop_queue_and_bounds():
    m = Manifest()
    m.add([entry("a", 1, 0, 10), entry("b", 1, 20, 30), entry("c", 1, None, None)])
    assert [e.path for e in m.overlapping(11, 19)] == ["c"] and [e.path for e in m.overlapping(10, None)] == ["a", "b", "c"]
    m.replace(["a", "b"], [entry("ab", 2, 0, 30)], now=5.0)
    assert set(m.files) == {"c", "ab"} and m.drop_queue == {"a": 5.0, "b": 5.0}


# -- tables


def test_declarations():
    yaml = "create_table: m\nfields:\n  ts: Int64\n  v: FLOAT8\norder_by:\n  - ts\ntimestamp:\n  field: ts\n  precision: ms\nengine: Merge\n"
    spec = from_request(yaml, "db")
    assert (spec.name, spec.database, spec.engine, spec.fields, spec.order_by, spec.timestamp_field, spec.timestamp_precision, spec.partition_by) == ("m", "db", "Merge", {"ts": "Int64", "v": "FLOAT8"}, ["ts"], "ts", "ms", {})
    assert from_request('{"create_table": "m", "partition_by": "date", "fields": {"a": "TEXT"}}').partition_by.keys() == {"date"}
    for bad in ({"order_by": ["x"]}, {"timestamp": {"field": "x"}}, {"s3_url": "http://h"}, {"create_table": "a-b"}, {"engine": "Other"}, {"fields": {"a": "blob"}}, {"database": "../x"}):
        with pytest.raises(ValueError):
            from_request(json.dumps({"create_table": "m", "fields": {"a": "TEXT"}} | bad))


@pytest.fixture
def lake(spark, tmp_path):
    return Lakehouse(spark, str(tmp_path / "lake"))


def hours(spark, n=100):
    return spark.range(n).selectExpr("id", "cast(id % 3 as double) v")


def stamp():
    return (F.lit(1704067200) + F.col("id") * 600) * 1_000_000_000


def test_write_places_rows_by_their_own_hour(spark, lake):
    assert lake.write("", "t", hours(spark), stamp=stamp()) == 100
    assert lake.databases() == ["default"] and lake.tables("default") == ["t"]
    parts = lake.partitions("default", "t")
    assert parts[0] == "date=2024-01-01/hour=00" and len(parts) == 17
    assert sum(n for _, _, n, _, _ in lake.stats("default", "t")) == 100
    start, end = 1704067200 * 10**9 + 3600 * 10**9, 1704067200 * 10**9 + 7199 * 10**9
    assert len(lake.resolve("default", "t", start, end)) == 1
    assert sorted(r.id for r in lake.scan("default", "t", start, end).collect()) == list(range(6, 12))


def test_batch_written_again_replaces_itself(spark, lake):
    spec = TableSpec("t", partition_by={})
    lake.create(spec)
    for _ in range(2):
        lake.write("default", "t", hours(spark), batch="b1")
    lake.write("default", "t", hours(spark), batch="b2")
    assert lake.scan("default", "t").count() == 200
    assert not lake.files.list(lake.location("default", "t") + "/tmp")


def test_drifting_types_and_columns(spark, lake):
    lake.create(TableSpec("t", engine="Merge"))
    lake.write("default", "t", spark.createDataFrame([(1, "x")], "a bigint, b string"))
    lake.write("default", "t", spark.createDataFrame([(2.5,)], "a double"))
    assert sorted((r.a, r.b) for r in lake.scan("default", "t").collect()) == [(1.0, "x"), (2.5, None)]
    lake.write("default", "t", spark.createDataFrame([("q", 7)], "a string, c int"))
    assert sorted((r.a, r.c) for r in lake.scan("default", "t").collect()) == [("1.0", None), ("2.5", None), ("q", 7)] or sorted(r.a for r in lake.scan("default", "t").collect()) == ["1", "2.5", "q"]


def test_compaction_keeps_rows_and_sorts(spark, lake):
    lake.create(TableSpec("t", partition_by={"k": "id % 2"}, order_by=["v", INGEST]))
    for i in range(4):
        lake.write("default", "t", hours(spark).selectExpr(f"id + {100 * i} as id", "nullif(v, 0) v"), stamp=stamp())
    before = sorted(map(tuple, lake.scan("default", "t").select("id", "v", INGEST).collect()))
    assert lake.compact("default", "t", 1) == 2
    paths = lake.resolve("default", "t")
    assert len(paths) == 2 and all(p.endswith(".2.parquet") for p in paths)
    assert sorted(map(tuple, lake.scan("default", "t").select("id", "v", INGEST).collect())) == before
    for p in paths:
        v = [(r.v is None, r.v, r[INGEST]) for r in spark.read.parquet(p).collect()]
        assert v == sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))
    folder = lake.location("default", "t") + "/k=0"
    assert len([n for n in os.listdir(folder) if n.endswith(".parquet")]) > 1  # inputs stay for a while
    assert lake.vacuum("default", "t") == 0
    lake.grace_s = 0
    assert lake.vacuum("default", "t") >= 8
    assert len([n for n in os.listdir(folder) if n.endswith(".parquet")]) == 1
    assert lake.compact("default", "t", 2) == 2  # lone files are renamed
    assert all(p.endswith(".3.parquet") for p in lake.resolve("default", "t"))
    assert lake.compact("default", "t", 3, min_files=2) == 0
    assert lake.scan("default", "t").count() == 400


def test_maintenance_round(spark, lake):
    lake.create(TableSpec("t", engine="Merge"))
    lake.create(TableSpec("empty"))
    for _ in range(3):
        lake.write("default", "t", hours(spark, 10))
    assert lake.maintain() == 1 and lake.maintain(interval_s=1000) == 0
    assert lake.scan("default", "t").count() == 30 and lake.scan("default", "empty").count() == 0


def test_scans_read_no_footers(spark, lake, monkeypatch):
    from siltstone.sources import union

    lake.create(TableSpec("t", partition_by={"k": "id % 2"}))
    for _ in range(2):
        lake.write("default", "t", hours(spark, 20))
    monkeypatch.setattr(union, "file_schemas", lambda *a: pytest.fail("a footer was read"))
    lake.compact("default", "t", 1)
    lake.compact("default", "t", 2)
    assert lake.scan("default", "t").count() == 40
    assert set(lake.scan("default", "t").columns) == {"id", "v", INGEST}


def test_names_are_checked(spark, lake):
    for bad in ("../x", "a b", ""):
        with pytest.raises(CatalogError):
            lake.write("db", bad, hours(spark))


def test_union_of_no_files(spark):
    with pytest.raises(ValueError, match="no files"):
        read_union(spark, [])


# -- lines, streams and the front


def lines(spark, texts, db=None):
    rows = [(i, db, "ns", None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "line_id bigint, db_name string, precision string, received_at timestamp, line string")


def test_schema_ids(spark):
    texts = ['w,location=x temperature=1.5,humidity="h"', 'w,location=x temperature="s",humidity="h"', "w,location=x,humidity=h temperature=1.5", "w,humidity=h,location=x temperature=1.5"]
    ids = [r.schema_id for r in schema_id(parse_lines(lines(spark, texts))).orderBy("line_id").collect()]
    assert ids[0] != ids[1] and ids[0] == ids[2] == ids[3]


def test_stream_restart_stores_each_line_once(spark, tmp_path, lake):
    landing, progress, failed = tmp_path / "in", str(tmp_path / "progress"), []
    landing.mkdir()
    (landing / "a.txt").write_text("m,t=a v=1 1\nm,t=b v=2 2\nbroken\n")

    def run_once():
        ingest(lake, read_lines(spark, str(landing), "db"), progress, on_failed=lambda df, n: failed.extend(r.reason for r in df.collect())).awaitTermination()

    run_once()
    with gzip.open(landing / "b.txt.gz", "wt") as f:
        f.write("m,t=c v=3 1\nn v=1i\n")
    run_once()
    run_once()
    assert sorted((r.t, r.v) for r in lake.scan("db", "m").collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert [r.v for r in lake.scan("db", "n").collect()] == [1] and failed == ["column_count"]


def test_event_time_windows_drop_what_is_too_late(spark, tmp_path):
    def events(name, rows):
        spark.createDataFrame(rows, "at string, k string").selectExpr("cast(at as timestamp) at", "k").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def feed(build, name):
        events("in", [("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 03:00:00", "b")])
        stream = spark.readStream.schema("at timestamp, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        events("in", [("2024-01-01 00:03:00", "a"), ("2024-01-01 05:00:00", "c")])  # the first is behind the watermark
        q.processAllAvailable()
        q.stop()
        return sorted((r.k, r.n) for r in spark.table(name).collect())

    assert feed(lambda s: windowed(s, "at", ["k"], "5 minutes"), "tumbling") == [("a", 2), ("b", 1)]
    for f in (tmp_path / "in").glob("*"):
        f.unlink()
    assert feed(lambda s: sessions(s, "at", ["k"], "5 minutes"), "in_sessions") == [("a", 2), ("b", 1)]


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a.lp").write_text('m,t=a v=1,s="x y" 1\n\nbad\n')
    with gzip.open(tmp_path / "b.lp.gz", "wt") as f:
        f.write("m v=2i 2")
    rows = spark.read.format("lineproto").option("database", "d").option("precision", "s").load(str(tmp_path)).orderBy("time").collect()
    assert [(r.database, r.reason, r.time) for r in rows] == [("d", "column_count", None), ("d", None, 10**9), ("d", None, 2 * 10**9)]
    assert datasource.parser_for("application/json") is datasource.LineProtocol
    q = spark.readStream.format("lineproto").load(str(tmp_path)).select("floats", "strings", "reason").writeStream.format("memory").queryName("lp").start()
    q.processAllAvailable()
    (tmp_path / "_b.lp").write_text("not yet complete")
    (tmp_path / "a0.lp").write_text('m s="x\ny" 1\n')  # comes later, sorts earlier than what was read
    q.processAllAvailable()
    q.stop()
    assert spark.table("lp").count() == 4 and spark.table("lp").where("strings.s = 'x\\ny'").count() == 1


def test_bodies_are_all_or_nothing(lake):
    with pytest.raises(BadLines, match="line 2: value"):
        write_body(lake, b"m v=1\nm v=x", "db")
    assert lake.databases() == []
    assert write_body(lake, b"m v=1\nm v=x", "db", permissive=True) == 1
    with pytest.raises(CatalogError, match="two meanings"):
        write_body(lake, b"m,v=a v=1", "db")
    assert write_body(lake, b"a.m v=1\nb.m v=2,u=18446744073709551615u,ok=true", None) == 2
    assert [r.v for r in lake.scan("b", "m").collect()] == [2.0]


def test_tables_of_a_body_land_together(lake):
    lake.create(TableSpec("b", "db", fields={"v": "FLOAT8"}, partition_by={"k": "no_such_column"}))
    with pytest.raises(Exception, match="no_such_column"):
        write_body(lake, b"a v=1\nb v=2", "db")
    assert lake.scan("db", "a").count() == 0 and not lake.files.list(lake.location("db", "a") + "/tmp")
    with pytest.raises(CatalogError):
        write_body(lake, b"a v=1\nb-c v=2", "db")
    assert lake.scan("db", "a").count() == 0


def test_bodies_written_together(lake):
    bodies = [Body(b"m v=1\nm v=2", "db"), Body(b"m v=x", "db"), Body(b"m v=3\nm v=y", "db", permissive=True), Body(b'm,t=a s="x\ny" 1', "db")]
    write_bodies(lake, bodies)
    assert [b.done.exception() is None and b.done.result() for b in bodies] == [2, False, 1, 1]
    assert sorted((r.v or 0, r.s) for r in lake.scan("db", "m").collect()) == [(0, "x\ny"), (1, None), (2, None), (3, None)]
    bodies = [Body(b"n v=1", "db"), Body(b"n v=1i", "db"), Body(b"n,v=a v=1", "db")]
    write_bodies(lake, bodies)
    assert [b.done.exception() is None for b in bodies] == [True, True, False]
    assert lake.scan("db", "n").count() == 2


def test_no_acknowledged_row_is_lost(lake):
    """Many clients write while files are merged and deleted; what was acknowledged is there once."""
    lake.grace_s = 1.0
    writer, over, acknowledged, merged, failed = Writer(lake, 0.2), threading.Event(), [], [], []

    def client(k):
        for i in range(50):
            acknowledged.append(writer.write(f"m,client=c{k} v={i}i\nm,client=c{k} v={i + 1000}i".encode(), f"db{k % 2}"))

    def merge():
        while not over.is_set():
            try:
                merged.append(lake.maintain(0.0))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    merger = threading.Thread(target=merge)
    merger.start()
    clients = [threading.Thread(target=client, args=(k,)) for k in range(32)]
    [c.start() for c in clients]
    [c.join() for c in clients]
    over.set()
    merger.join()
    assert failed == [] and sum(merged) > 0 and sum(acknowledged) == 32 * 50 * 2
    for db in ("db0", "db1"):
        rows = lake.scan(db, "m")
        assert rows.count() == rows.distinct().count() == 16 * 50 * 2 == sum(n for _, _, n, _, _ in lake.stats(db, "m"))


def test_writers_that_share_nothing_but_the_files(spark, tmp_path):
    """Commits of one partition by lakehouses that don't know of each other, as in several processes."""
    lakes = [Lakehouse(spark, str(tmp_path / "lake")) for _ in range(6)]
    at = lakes[0].location("d", "t") + "/data/metadata.json"
    lakes[0].create(TableSpec("t", "d", engine="Merge"))

    def commits(k):
        catalog_lock = f"{at}/{k}"  # a lock of its own instead of the process's
        for i in range(20):
            def change(text, version):
                m = Manifest.loads(text) if text else Manifest("t")
                m.add([entry(f"{k}-{i}")])
                m.version = version
                return m.dumps()

            lakes[k]._swap(at, change, catalog_lock)

    threads = [threading.Thread(target=commits, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    m = lakes[0].manifest("d", "t", "data")
    assert len(m.files) == 120 and m.version == 120 and json.loads(lakes[0].files.read_text(at))["version"] == 120


def test_queries_do_not_see_each_other(spark, lake):
    for k, db in enumerate("ab"):
        lake.create(TableSpec("t", db, engine="Merge"))
        lake.write(db, "t", spark.createDataFrame([(k,)], "v int"))
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: (i % 2, run(lake, "ab"[i % 2], "SELECT v FROM t").first().v), range(40)))
    assert all(want == v for want, v in got)
    assert [tuple(r) for r in run(lake, "a", "SELECT x.v, y.v FROM t x JOIN b.t y ON x.v <> y.v").collect()] == [(0, 1)]
    assert run(lake, "a", "SELECT t.v FROM b.t WHERE v = 1").collect() and run(lake, "a", "FROM t WHERE v = 0").count() == 1


BOUNDED = [
    ("SELECT count(*) FILTER (WHERE __timestamp >= 5), count(*) FROM w", [(5, 10)], (None, None)),
    ("SELECT __timestamp >= 5 AS late, count(*) FROM w GROUP BY 1", [(False, 5), (True, 5)], (None, None)),
    ("SELECT (SELECT count(*) FROM w), count(*) FROM w WHERE __timestamp >= 5", [(10, 5)], (None, None)),
    ("SELECT count(*) FROM w WHERE IF(__timestamp > 5, true, true)", [(10,)], (None, None)),
    ("SELECT count(*) FROM w WHERE v <> '__timestamp > 5' -- __timestamp > 7", [(10,)], (None, None)),
    ("SELECT count(*) FROM w WHERE __timestamp > 5 OR v = '1'", [(5,)], (None, None)),
    ("SELECT count(*) FROM w WHERE __timestamp > 5 AND 9 >= __timestamp", [(4,)], (5, 9)),
    ("WITH x AS (SELECT * FROM w WHERE __timestamp BETWEEN 2 AND 3) SELECT count(*) FROM x JOIN w USING (v) WHERE w.__timestamp = 3", [(1,)], (2, 3)),
]


@pytest.mark.parametrize(("text", "want", "opened"), BOUNDED)
def test_bounds_come_from_the_plan(spark, lake, monkeypatch, text, want, opened):
    lake.create(TableSpec("w", engine="Merge"))
    lake.write("default", "w", spark.range(10).selectExpr("cast(id as string) v"), stamp=F.col("v").cast("bigint"))
    scans = []
    whole = Lakehouse.scan
    monkeypatch.setattr(Lakehouse, "scan", lambda self, db, name, lo=None, hi=None: scans.append((lo, hi)) or whole(self, db, name, lo, hi))
    assert sorted(map(tuple, run(lake, "default", text).collect())) == want
    assert scans == [opened]


def test_functions_reach_queries(lake):
    lake.functions["twice"] = (lambda x: 2 * x, "double")
    write_body(lake, b"m v=1.5", "db")
    assert run(lake, "db", "SELECT twice(v) AS w FROM m").first().w == 3.0


def test_a_scan_of_one_hour_reads_one_manifest(spark, lake, monkeypatch):
    lake.write("default", "t", hours(spark), stamp=stamp())
    read = []
    manifest = Lakehouse.manifest
    monkeypatch.setattr(Lakehouse, "manifest", lambda self, db, name, p: read.append(p) or manifest(self, db, name, p))
    start, end = 1704067200 * 10**9 + 3600 * 10**9, 1704067200 * 10**9 + 7199 * 10**9
    assert lake.scan("default", "t", start, end).count() == 6 and read == ["date=2024-01-01/hour=01"]


def test_tables_elsewhere(spark, lake, tmp_path):
    assert from_request('{"create_table": "t", "s3_url": "s3://k:s@host/bucket/p"}', "d").location == "s3a://bucket/p/d/t"
    lake.create(TableSpec("t", "d", engine="Merge", location=str(tmp_path / "far")))
    lake.write("d", "t", hours(spark, 5))
    lake.compact("d", "t", 1)
    assert lake.scan("d", "t").count() == 5 and os.listdir(tmp_path / "far/data")
    assert os.listdir(lake.root + "/d/t") == ["table.json"]


def test_queries_and_their_json(spark, lake):
    write_body(lake, b"weather,location=us-midwest,season=summer temperature=82\nweather,location=us-east,season=summer temperature=80\nweather,location=us-west,season=summer temperature=99", "mydb")
    assert json.loads(to_json(run(lake, "mydb", "SELECT count(), avg(temperature) FROM weather"))) == {"results": [{"count_star()": "3", "avg(temperature)": 87.0}]}
    assert json.loads(to_json(run(lake, "mydb", "SELECT location FROM weather WHERE time >= epoch_ns('2020-01-01'::TIMESTAMP) AND temperature > 81 ORDER BY 1")))["results"] == [{"location": "us-midwest"}, {"location": "us-west"}]
    assert run(lake, "mydb", "SELECT * FROM weather WHERE __timestamp >= 9000000000000000000").count() == 0
    [a, b] = run_script(spark, "SELECT toInt32('2.5') x; SELECT 'a;b' y")
    assert (a.first().x, b.first().y) == (3, "a;b")


def test_http(lake):
    @route("GET", "/tables")
    def tables(lake, options, body):
        return 200, json.dumps(lake.tables(options["db"])), "application/json"

    server = serve(lake, "127.0.0.1", 0, secret="s3cret", allow_local=True)
    token = {"Authorization": "Bearer s3cret"}
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None, headers=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body, token | (headers or {}), method="POST" if body is not None else "GET")
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert call("/health")[0] == 200 and call("/ping")[0] == 204 and call("/nowhere")[0] == 404
        assert call("/query", b"{}", {"Authorization": "Bearer x"})[0] == call("/nowhere", None, {"Authorization": ""})[0] == 401
        assert call("/create?db=d", b'{"create_table": "m", "fields": {"v": "FLOAT8"}, "engine": "Merge"}')[0] == 200
        assert call("/write?db=d", b"m v=1 5")[0] == 204
        assert call("/api/v2/write?bucket=d&precision=s", gzip.compress(b"m v=2i 6"), {"Content-Encoding": "gzip"})[0] == 204
        assert call("/write?db=d&table=j", b'{"a": 1}\n\n{"a": 2, "b": "x"}', {"Content-Type": "application/x-ndjson"})[0] == 204
        assert call("/write?db=d&table=j", b'{"a": 1}\n[]', {"Content-Type": "application/x-ndjson"}) == (400, "line 2: no JSON object")
        assert json.loads(call("/query?db=d", b'{"query": "SELECT a, b FROM j ORDER BY a"}')[1])["results"] == [{"a": "1", "b": None}, {"a": "2", "b": "x"}]
        assert call("/write?db=d", b"m v=") == (400, "line 1: column_count")
        assert json.loads(call("/query?db=d", b'{"query": "SELECT v, time FROM m ORDER BY v"}')[1]) == {"results": [{"v": 1.0, "time": "5"}, {"v": 2.0, "time": "6000000000"}]}
        assert call("/tables?db=d") == (200, '["j", "m"]')
        assert call("/query?db=d", b'{"query": "SELEC"}')[0] == 500 and call("/query", b"{}")[0] == 400
    finally:
        server.shutdown()
