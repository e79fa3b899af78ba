"""Consolidating far too many small files.

`live_files` folds a file index and its drop queues into one row per live file, `small_files`
keeps those worth consolidating, `plan_outputs` assigns them to few well-sized outputs of the same
directory, and `consolidate` copies the encoded column blocks of each output's inputs into one
larger Parquet file (see `siltstone.sources.parquet_blocks`); nothing is decoded.

Scale: all steps are hash aggregations with map-side combine. A directory holding a third of all
files is spread over `BUCKETS` hash buckets; only per-bucket totals meet in one window, so no task
gets more than 1/BUCKETS of a directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialise

SMALL_BYTES = 4 * 1024 * 1024
MIN_FILES = 5
TARGET_BYTES = 128 * 1024 * 1024
#: Inputs of one output; a task holds the footers of all of them.
MAX_INPUTS = 8192
BUCKETS = 64
MAX_TASKS = 10_000
DATA_ROOT = "/data/"


def canonical_path(path: Column, root: str = DATA_ROOT) -> Column:
    """One spelling per file: blanks around, file: scheme, percent codes, relative paths, doubled
    slashes, `.` and `..` steps are resolved. Null stays null."""
    p = F.btrim(path)
    p = F.coalesce(F.when(p.contains("%"), F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))), p)
    p = F.when(F.lower(p).startswith("file:"), F.regexp_replace(p, r"^[fF][iI][lL][eE]:(//[^/]*)?", "")).otherwise(p)
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root), p))
    steps = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda done, step: F.when(step.isin("", "."), done)
        .when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, step)),
    )
    return F.when(p.contains("//") | p.contains("/."), F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise(p)


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def live_files(entries: DataFrame, manifests: DataFrame, root: str = DATA_ROOT) -> DataFrame:
    """One row (path, entry_id, size_bytes, row_count) per file that no drop queue names.

    Entries with a null path or null id count for nothing; the id is the lowest of the listings,
    size and rows are those any listing gives (negative ones are no information); both may be null.
    Listings and drops meet in a single aggregation, so there is one shuffle, after map-side combine.
    """
    listed = entries.select(
        canonical_path(F.col("path"), root).alias("path"),
        F.col("entry_id").cast("bigint").alias("entry_id"),
        F.when(F.col("size_bytes") >= 0, F.col("size_bytes").cast("bigint")).alias("size_bytes"),
        F.when(F.col("row_count") >= 0, F.col("row_count").cast("bigint")).alias("row_count"),
        F.lit(False).alias("dropped"),
    )
    dropped = manifests.select(F.explode("drop_queue").alias("path")).select(
        canonical_path(F.col("path"), root).alias("path"),
        F.lit(None).cast("bigint").alias("entry_id"),
        F.lit(None).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("bigint").alias("row_count"),
        F.lit(True).alias("dropped"),
    )
    return (
        listed.unionByName(dropped)
        .where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.min("entry_id").alias("entry_id"), F.max("size_bytes").alias("size_bytes"), F.max("row_count").alias("row_count"), F.max("dropped").alias("dropped"))
        .where(~F.col("dropped") & F.col("entry_id").isNotNull())
        .drop("dropped")
    )


def plan_outputs(
    entries: DataFrame,
    manifests: DataFrame,
    small_bytes: int = SMALL_BYTES,
    min_files: int = MIN_FILES,
    target_bytes: int = TARGET_BYTES,
    buckets: int = BUCKETS,
    root: str = DATA_ROOT,
    max_inputs: int = MAX_INPUTS,
) -> DataFrame:
    """Each small live file with its output: (entry_id, path, directory, size_bytes, row_count,
    output_no, output_path).

    Files below `small_bytes` of directories with at least `min_files` of them are laid end to end
    in a fixed order, each at least as long as `max_inputs` of them fill the target; an output takes a stretch of
    `target_bytes`, so it holds at most the target and one small file more, and `max_inputs` files and one more. Directories with fewer files, files of unknown size and an empty index give
    no rows. Files of size 0 are assigned like any other.
    """
    files = (
        live_files(entries, manifests, root)
        .where(F.col("size_bytes") < small_bytes)
        .withColumn("directory", directory_of(F.col("path")))
        .withColumn("length", F.greatest("size_bytes", F.lit(-(-target_bytes // max_inputs)).cast("bigint")))
        .withColumn("bucket", F.pmod(F.conv(F.substring(F.md5("path"), 1, 4), 16, 10).cast("int"), F.lit(buckets)))
    )
    files = materialise(files, "small")  # both branches below read it; the listings are folded once
    totals = files.groupBy("directory", "bucket").agg(F.sum("length").alias("bucket_bytes"), F.count("*").alias("bucket_files"))
    per_dir = Window.partitionBy("directory")
    before = per_dir.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("files_in_directory", F.sum("bucket_files").over(per_dir))
        .withColumn("start", F.coalesce(F.sum("bucket_bytes").over(before), F.lit(0)))
        .where(F.col("files_in_directory") >= min_files)
        .select("directory", "bucket", "start")
    )
    inside = Window.partitionBy("directory", "bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(offsets, ["directory", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("length").over(inside), F.lit(0)))
    number = F.floor(F.col("at") / F.lit(target_bytes)).cast("bigint")
    return placed.select(
        "entry_id",
        "path",
        "directory",
        "size_bytes",
        "row_count",
        number.alias("output_no"),
        F.concat("directory", F.lit("/merged-"), F.lpad(number.cast("string"), 6, "0"), F.lit(".2.parquet")).alias("output_path"),
    )


def directory_report(plan: DataFrame) -> DataFrame:
    """Files, bytes and outputs of each directory that is consolidated."""
    return plan.groupBy("directory").agg(
        F.count("*").alias("files"),
        F.sum("size_bytes").alias("bytes"),
        F.sum("row_count").alias("known_rows"),
        F.count_distinct("output_no").alias("outputs"),
    )


def consolidate(plan: DataFrame) -> DataFrame:
    """Carry a plan out: (output_path, inputs, row_groups, rows, bytes) per file written.

    Needs columns path, row_count (null: unknown) and output_path. Inputs of one output are bounded
    by the plan's target size and number of inputs. A task that is run again writes the same file again: output names
    come from the plan, data goes to a temporary name first. Raises if a footer's rows differ from
    the plan's, or if the written file's blocks or rows differ from the inputs'. Inputs of unlike
    schema go to separate outputs (suffix -s1, -s2, ... in the order of their first input).
    """
    from siltstone.sources.parquet_blocks import RESULT_SCHEMA, concat_outputs

    jobs = materialise(plan.groupBy("output_path").agg(F.sort_array(F.collect_list(F.struct("path", "row_count"))).alias("inputs")), "jobs")
    # rows are tiny but each is much work: a number keeps adaptive execution from joining tasks
    tasks = max(1, min(jobs.count(), MAX_TASKS))
    return jobs.repartition(tasks, "output_path").mapInArrow(concat_outputs, RESULT_SCHEMA)
