"""Continuous ingest of line protocol into a lakehouse, and continuous queries over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.bad_rows import parse_lines
from siltstone.plans.catalog import CatalogError, Lakehouse, checked_name
from siltstone.sources.lineproto import records

_TYPED = ("floats", "ints", "uints", "strings", "booleans")


def schema_id(rows: DataFrame) -> DataFrame:
    """Parsed rows with `schema_id` and its label: the set of names and types of tags and fields.

    A tag and a string field are of one type; neither the order nor the split into tags and fields
    matters."""
    short = {"floats": "FLOAT8", "ints": "INT8", "uints": "UBIGINT", "strings": "VARCHAR", "booleans": "BOOLEAN", "tags": "VARCHAR"}
    names = [F.transform(F.map_keys(column), _suffix(kind)) for column, kind in short.items()]
    label = F.array_join(F.array_sort(F.array_distinct(F.concat(*names))), ",")
    return rows.withColumn("schema_label", label).withColumn("schema_id", F.xxhash64("schema_label"))


def _suffix(kind: str) -> Callable[[Column], Column]:
    return lambda name: F.concat(name, F.lit(f":{kind}"))


def tables_of(parsed: DataFrame) -> list:
    """One row per (database, table) of a batch with the names in each of its typed maps."""
    keys = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(m))))).alias(m) for m in ("tags", *_TYPED)]
    return parsed.groupBy("database", "table").agg(*keys).collect()


def as_table(parsed: DataFrame, names) -> DataFrame:
    """Rows of one table with a column per tag and field, and `time`. A name that is both a tag and a
    field, or a field of two types, is refused."""
    columns: dict[str, Column] = {}
    for m in ("tags", *_TYPED):
        for n in names[m]:
            if n in columns or n == "time":
                raise CatalogError(f"{n!r} of {names['table']!r} has two meanings in one batch")
            columns[n] = F.col(m)[n].alias(n)
    return parsed.where((F.col("database") == names["database"]) & (F.col("table") == names["table"])).select(*columns.values(), "time")


def write_points(lake: Lakehouse, parsed: DataFrame, batch: str | None = None, stamp: Column | None = None) -> int:
    """Write parsed rows to their tables; returns how many. Rows that failed are left out.

    All tables are staged, at the same time, before the first is committed, so that a name or column that is
    refused in one leaves nothing in the others.
    """
    parsed = parsed.where("reason is null").persist()
    try:
        frames = [(n, as_table(parsed, n)) for n in tables_of(parsed)]
        for n, _ in frames:
            checked_name(n["database"]), checked_name(n["table"])
        with ThreadPoolExecutor(8) as pool:
            jobs = [pool.submit(lake.stage, n["database"], n["table"], frame, batch, stamp) for n, frame in frames]
        if failed := next((e for j in jobs if (e := j.exception())), None):
            for j in jobs:
                if not j.exception():
                    lake.discard(j.result())
            raise failed
        return sum(lake.land(j.result()) for j in jobs)
    finally:
        parsed.unpersist()


def read_lines(spark: SparkSession, landing: str, database: str | None = None, precision: str = "ns", max_files: int = 1000) -> DataFrame:
    """A stream of the records of text files (also .gz) that appear in a folder, each file a body of lines; a newline
    within a quoted field value belongs to its record."""
    files = spark.readStream.option("maxFilesPerTrigger", max_files).option("wholetext", True).text(landing)
    lines = files.select("value").mapInArrow(_records, "line_id bigint, line string")
    return lines.select("line_id", F.lit(database).cast("string").alias("db_name"), F.lit(precision).alias("precision"), F.current_timestamp().alias("received_at"), "line")


def _records(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for body in batch.column(0).to_pylist():
            found = list(records((body or "").removesuffix("\n").split("\n")))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())], ["line_id", "line"])


def ingest(lake: Lakehouse, lines: DataFrame, checkpoint: str, interval: str | None = None, on_failed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a stream of lines into the lakehouse; without an interval, what is there now and stop.

    A micro-batch that is run again after a failure replaces its own files, so every line is stored
    once. Lines that don't parse go to `on_failed` with their reason. Late events are stored like
    any other, in the partition of their arrival.
    """

    def each(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch).persist()
        try:
            write_points(lake, parsed, f"{_slug(checkpoint)}{number}")
            if on_failed:
                on_failed(parsed.where("reason is not null").select("line_id", "reason"), number)
        finally:
            parsed.unpersist()

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _slug(text: str) -> str:
    import hashlib

    return hashlib.sha1(text.encode()).hexdigest()[:12] + "b"


def windowed(stream: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or sliding event-time window and key; rows later than `lateness` are left out."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(F.window(at, length, slide or length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, lateness: str = "10 minutes") -> DataFrame:
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
