"""Session defaults and small helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_written: list[str] = []


def build_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` overrides them (dots written as __)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (tests, a laptop), an own
    temporary folder serves; a cluster without a shared folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "_own", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = shared_dir._own = tempfile.mkdtemp(prefix="siltstone-")
        _written.append(base)
    return base


@atexit.register
def _clean() -> None:
    """Remove what this driver wrote to a shared folder that is mounted here; others are the cluster's to clear."""
    for path in _written:
        here = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        if "://" not in here and os.path.isdir(here):
            shutil.rmtree(here, ignore_errors=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a table written in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint only if `df` is proven to hold at most `max_rows` rows.

    Beyond the bound the frame is returned as it is, and Spark shuffles both sides (AQE splits
    skewed partitions). `df` should be cheap to count: a written table or a fixed dimension.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """An input of few splits over all cores, for operators whose work per row far exceeds its size.

    Inputs that have a split for each core, as any large one has, and streams stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
