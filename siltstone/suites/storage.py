"""Queries that take the events table through the engine's storage and back: parse, write, merge, scan."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.bad_rows import parse_lines
from siltstone.plans import compaction
from siltstone.plans.catalog import INGEST, Lakehouse, TableSpec
from siltstone.plans.manifest import Entry
from siltstone.session import fresh_path, table
from siltstone.sources.union import read_mergetree, read_union
from siltstone.streaming.ingest import ingest, read_lines, schema_id, write_points



def _ns() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) * 1000


_BY_TYPE = {"kind": "event_type"}


def _line(spark: SparkSession, sf: str, fields=None, stamp=None) -> DataFrame:
    """Events as lines: tags event_type and user_id, fields value and event_id."""
    fields = fields if fields is not None else F.concat(F.coalesce(F.concat(F.lit("value="), F.col("value").cast("string"), F.lit(",")), F.lit("")), F.lit("event_id="), F.col("event_id").cast("string"), F.lit("i"))
    line = F.concat(F.lit("ev,event_type="), F.col("event_type"), F.lit(",user_id="), F.col("user_id").cast("string"), F.lit(" "), fields, F.lit(" "), (_ns() if stamp is None else stamp).cast("string"))
    return table(spark, sf, "events").select(F.col("event_id").alias("line_id"), F.lit("bench").alias("db_name"), F.lit("ns").alias("precision"), F.lit(None).cast("timestamp").alias("received_at"), line.alias("line"))


def lineproto_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_lines(_line(spark, sf)).where("reason is null")
    return rows.select(F.col("ints")["event_id"].alias("event_id"), F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].cast("bigint").alias("user_id"), F.col("floats")["value"].alias("value"), F.col("time").alias("ns"))


def ts_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's time sent in one of four precisions by its id, read back in nanoseconds."""
    units = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1000, "ns": 1}
    pick = F.pmod("event_id", F.lit(4))
    name, unit = F.lit("ns"), F.lit(1)
    for k, (n, u) in enumerate(units.items()):
        name, unit = F.when(pick == k, F.lit(n)).otherwise(name), F.when(pick == k, F.lit(u)).otherwise(unit)
    sent = F.call_function("div", _ns() - F.pmod(_ns(), unit), unit)
    lines = _line(spark, sf, stamp=sent).join(table(spark, sf, "events").select(F.col("event_id").alias("line_id"), name.alias("p")), "line_id")
    rows = parse_lines(lines.drop("precision").withColumnRenamed("p", "precision"))
    return rows.select(F.col("line_id").alias("event_id"), F.col("time").alias("ns"))


def schema_id_groups(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("")).otherwise(F.lit("value=1.5,"))
    rows = parse_lines(_line(spark, sf, fields=F.concat(value, F.lit("event_id="), F.col("event_id").cast("string"), F.lit("i"))))
    return schema_id(rows).groupBy("schema_id", "schema_label").agg(F.count("*").alias("n")).select("schema_label", "n")


def ndjson_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "ndjson")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    rows = spark.read.schema("event_id bigint, event_type string, value double").json(path)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.max("value").alias("top"))


def union_by_name_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Three files of unlike schemas: a column missing, an integer for a double, text for a number."""
    path = fresh_path(spark, "slices")
    e, part = table(spark, sf, "events"), F.pmod("event_id", F.lit(3))
    slices = [
        e.where(part == 0).select("event_id", F.col("user_id").alias("v"), "event_type"),
        e.where(part == 1).select("event_id", F.col("value").alias("v")),
        e.where(part == 2).select("event_id", "event_type", F.col("user_id").cast("double").alias("v"), F.lit("x").alias("extra")),
    ]
    for k, s in enumerate(slices):
        s.write.parquet(f"{path}/{k}")
    files = sorted(r.f for r in spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("f")).collect())
    return read_union(spark, files).select("event_id", "v", "event_type", "extra")


def _lake(spark: SparkSession, sf: str, spec: TableSpec, pieces: int = 1) -> Lakehouse:
    """All events in a new lakehouse, in `pieces` writes, with their time as ingest time."""
    lake = Lakehouse(spark, fresh_path(spark, "lake"))
    lake.create(spec)
    for k in range(pieces):
        rows = table(spark, sf, "events")
        lake.write(spec.database, spec.name, rows.where(F.pmod(F.xxhash64("event_id"), F.lit(pieces)) == k) if pieces > 1 else rows, stamp=_ns())
    return lake


def hive_partition_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per date and hour folder, read from the folders' names."""
    lake = _lake(spark, sf, TableSpec("ev", "bench"))
    rows = spark.read.option("basePath", lake.location("bench", "ev")).parquet(lake.location("bench", "ev") + "/date=*/hour=*/*.parquet")
    return rows.groupBy(F.col("date").cast("string").alias("date"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour")).agg(F.count("*").alias("n"))


def partition_discovery(spark: SparkSession, sf: str) -> DataFrame:
    lake = _lake(spark, sf, TableSpec("ev", "bench", partition_by={"date": "date_format(timestamp_micros(__timestamp div 1000), 'yyyy-MM-dd')"}))
    return spark.createDataFrame([(p.removeprefix("date="), n) for p, _, n, _, _ in lake.stats("bench", "ev")], "date string, n bigint")


def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with ingest bounds opens only files that may hold them."""
    lake = _lake(spark, sf, TableSpec("ev", "bench", partition_by={"date": "date_format(timestamp_micros(__timestamp div 1000), 'yyyy-MM-dd')"}))
    start, end = 1704844800 * 10**9, 1705276800 * 10**9 - 1
    return lake.scan("bench", "ev", start, end).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def manifest_stats(spark: SparkSession, sf: str) -> DataFrame:
    lake = _lake(spark, sf, TableSpec("ev", "bench", partition_by=_BY_TYPE), 3)
    return spark.createDataFrame([(p.removeprefix("kind="), n, lo, hi) for p, _, n, lo, hi in lake.stats("bench", "ev")], "kind string, n bigint, lo bigint, hi bigint")


def _as_files(listed: DataFrame) -> DataFrame:
    """Listed index entries with a size as one row per directory with its files (entry_id, name, bytes)."""
    return listed.where("size_bytes >= 0 and path is not null and manifest_id is not null").select("manifest_id", F.struct("entry_id", F.btrim("path").alias("path"), "size_bytes").alias("f"))


def compaction_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each level of each directory among the listed index entries with a size, in the planner's order."""

    def choose(rows):
        import pandas as pd

        files = [Entry(f"{r['entry_id']}/{r['path']}", r["size_bytes"], 1, None, None) for r in rows["f"]]
        out = [(int(e.path.split("/")[0]), level, e.size_bytes, k + 1) for level in range(1, 5) for k, e in enumerate(compaction.candidates(files, level))]
        return pd.DataFrame(out, columns=["entry_id", "level", "size_bytes", "place"])

    # a directory's manifest is what the planner reads at once
    return _as_files(table(spark, sf, "index_entries")).groupBy("manifest_id").applyInPandas(choose, "entry_id bigint, level int, size_bytes bigint, place int").select("entry_id", "level", "size_bytes", "place")


def compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The planner's merges of level 1 of each directory among the listed index entries with a size, under a cap of 64 MiB."""

    def merges(key, rows):
        import pandas as pd

        files = [Entry(f"{r['entry_id']}.1.parquet", r["size_bytes"], 1, None, None) for r in rows["f"] if compaction.level_of(r["path"]) == 1]
        size = {f.path: f.size_bytes for f in files}
        plans = compaction.plan(files, compaction.Tier(1, 64 << 20, 1))
        return pd.DataFrame([(key[0], k, len(m.sources), sum(size[x] for x in m.sources)) for k, m in enumerate(plans)], columns=["manifest_id", "merge", "files", "bytes"])

    return _as_files(table(spark, sf, "index_entries")).groupBy("manifest_id").applyInPandas(merges, "manifest_id bigint, merge int, files int, bytes bigint")


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 3).alias("total"))


def compact_l1(spark: SparkSession, sf: str) -> DataFrame:
    lake = _lake(spark, sf, TableSpec("ev", "bench", partition_by=_BY_TYPE), 4)
    lake.compact("bench", "ev", 1)
    return _summary(lake.scan("bench", "ev"))


def compact_ln(spark: SparkSession, sf: str) -> DataFrame:
    lake = _lake(spark, sf, TableSpec("ev", "bench", partition_by=_BY_TYPE), 2)
    lake.compact("bench", "ev", 1)
    lake.write("bench", "ev", table(spark, sf, "events").where("event_type = 'view'"), stamp=_ns())
    lake.compact("bench", "ev", 1)
    lake.compact("bench", "ev", 2)
    lake.grace_s = 0
    lake.vacuum("bench", "ev")
    return _summary(lake.scan("bench", "ev"))


def mergetree_scan(spark: SparkSession, sf: str) -> DataFrame:
    lake = _lake(spark, sf, TableSpec("ev", "bench", engine="Merge"), 3)
    rows = read_mergetree(spark, lake.resolve("bench", "ev"), [INGEST])
    return rows.select("event_id", F.col(INGEST).alias("ns"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text files through the stream into the lakehouse, and a query over them."""
    landing, lake = fresh_path(spark, "landing"), Lakehouse(spark, fresh_path(spark, "lake"))
    _line(spark, sf).select("line").write.text(landing)
    lake.create(TableSpec("ev", "bench", partition_by=_BY_TYPE))
    ingest(lake, read_lines(spark, landing, "bench"), fresh_path(spark, "progress")).awaitTermination()
    return _summary(lake.scan("bench", "ev"))


def concurrent_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Eight writers at a time into one partitioned table, while its files are merged; no row may be lost or doubled."""
    lake = Lakehouse(spark, fresh_path(spark, "lake"))
    lake.create(TableSpec("ev", "bench", partition_by=_BY_TYPE))
    rows, writers = table(spark, sf, "events"), 8
    share = F.pmod(F.xxhash64("event_id"), F.lit(writers))
    with ThreadPoolExecutor(writers + 1) as pool:
        jobs = [pool.submit(lake.write, "bench", "ev", rows.where(share == k), None, _ns()) for k in range(writers)]
        jobs += [pool.submit(lake.compact, "bench", "ev", 1) for _ in range(2)]
        for job in jobs:
            job.result()
    return _summary(lake.scan("bench", "ev"))


def late_data_visible(spark: SparkSession, sf: str) -> DataFrame:
    """All events arrive today, whatever their time; a query by event time sees them all."""
    lake = Lakehouse(spark, fresh_path(spark, "lake"))
    write_points(lake, parse_lines(_line(spark, sf)))
    rows = lake.scan("bench", "ev").withColumn("day", F.date_format(F.timestamp_micros((F.col("time") / 1000).cast("bigint")), "yyyy-MM-dd"))
    return rows.groupBy("day").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        lineproto_parse, ts_precision, schema_id_groups, ndjson_scan, union_by_name_scan, hive_partition_assign, partition_discovery, scan_table, manifest_stats,
        compaction_candidates, compaction_plan, compact_l1, compact_ln, mergetree_scan, stream_ingest, concurrent_ingest, late_data_visible,
    )
}

_SUMMARY = "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 3) AS total FROM {} GROUP BY event_type"
ORACLE = {
    "lineproto_parse": "SELECT event_id, event_type, user_id, value, epoch_ns(ts) AS ns FROM events",
    "ts_precision": "SELECT event_id, epoch_ns(ts) - epoch_ns(ts) % CASE event_id % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000 ELSE 1 END AS ns FROM events",
    "schema_id_groups": """SELECT CASE WHEN event_id % 3 = 0 THEN 'event_id:INT8,event_type:VARCHAR,user_id:VARCHAR' ELSE 'event_id:INT8,event_type:VARCHAR,user_id:VARCHAR,value:FLOAT8' END AS schema_label,
        count(*) AS n FROM events GROUP BY 1""",
    "ndjson_scan": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, max(value) AS top FROM events GROUP BY event_type",
    "union_by_name_scan": """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN value ELSE CAST(user_id AS DOUBLE) END AS v, CASE WHEN event_id % 3 <> 1 THEN event_type END AS event_type,
        CASE WHEN event_id % 3 = 2 THEN 'x' END AS extra FROM events""",
    "hive_partition_assign": "SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY ALL",
    "partition_discovery": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY ALL",
    "scan_table": "SELECT event_type, count(*) AS n, max(value) AS top FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type",
    "manifest_stats": "SELECT event_type AS kind, count(*) AS n, min(epoch_ns(ts)) AS lo, max(epoch_ns(ts)) AS hi FROM events GROUP BY event_type",
    "compaction_candidates": r"""SELECT entry_id, level, size_bytes,
            CAST(row_number() OVER (PARTITION BY manifest_id, level ORDER BY size_bytes DESC, CAST(entry_id AS VARCHAR) || '/' || trim(path)) AS INTEGER) AS place
        FROM (SELECT manifest_id, entry_id, path, size_bytes, TRY_CAST(regexp_extract(trim(path), '\.(\d+)\.parquet$', 1) AS INTEGER) AS level FROM index_entries
        WHERE size_bytes >= 0 AND path IS NOT NULL AND manifest_id IS NOT NULL) WHERE level BETWEEN 1 AND 4""",
    "compaction_plan": r"""WITH RECURSIVE f AS (SELECT manifest_id, size_bytes, row_number() OVER (PARTITION BY manifest_id ORDER BY size_bytes DESC, CAST(entry_id AS VARCHAR) || '.1.parquet') AS k
            FROM index_entries WHERE size_bytes >= 0 AND manifest_id IS NOT NULL AND regexp_extract(trim(path), '\.(\d+)\.parquet$', 1) = '1'),
        b AS (SELECT manifest_id, k, size_bytes, 0 AS merge, size_bytes AS held FROM f WHERE k = 1
            UNION ALL SELECT f.manifest_id, f.k, f.size_bytes, CASE WHEN b.held > 67108864 THEN b.merge + 1 ELSE b.merge END, CASE WHEN b.held > 67108864 THEN f.size_bytes ELSE b.held + f.size_bytes END
            FROM b JOIN f ON f.manifest_id = b.manifest_id AND f.k = b.k + 1)
        SELECT manifest_id, CAST(merge AS INTEGER) AS merge, CAST(count(*) AS INTEGER) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM b GROUP BY manifest_id, merge""",
    "compact_l1": _SUMMARY.format("events"),
    "compact_ln": _SUMMARY.format("(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'view')"),
    "mergetree_scan": "SELECT event_id, epoch_ns(ts) AS ns FROM events",
    "concurrent_ingest": _SUMMARY.format("events"),
    "stream_ingest": _SUMMARY.format("events"),
    "late_data_visible": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
}
