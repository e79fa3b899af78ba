"""Reading Parquet files of unlike schemas as one table, columns matched by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import fresh_path
from siltstone.types import common_type


def file_schemas(spark: SparkSession, paths: list[str]) -> dict[str, T.StructType]:
    """The schema of each file, from its footer; footers are read on executors."""
    import pyarrow.parquet as pq

    def footer(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                source, p = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows.append(pq.read_schema(p, filesystem=source).serialize().to_pybytes())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.binary())], ["path", "schema"])

    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    frame = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 256)))
    found = frame.mapInArrow(footer, "path string, schema binary").collect()
    return {r.path: from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(r.schema)))) for r in found}


def unified_schema(schemas: list[T.StructType]) -> dict[str, str]:
    """The common type of each column, in order of first appearance."""
    out: dict[str, str] = {}
    for schema in schemas:
        for f in schema.fields:
            kind = f.dataType.simpleString()
            out[f.name] = common_type(out[f.name], kind) if f.name in out else kind
    return out


def read_union(spark: SparkSession, paths: list[str], with_file: bool = False, known: dict[str, T.StructType] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """All rows of the files; missing columns are null, unlike types widen to their common type.

    Files are grouped by schema and each group is one scan, so the plan grows with the number of
    schemas, not of files. `with_file` adds the file's path as `__file`. Footers are read of those
    files only whose schema isn't `known`. `columns` are the names and types of the result, where other
    files of the table have more.
    """
    if not paths:
        raise ValueError("no files to read")
    schemas = dict(known or {})
    if unknown := [p for p in paths if p not in schemas]:
        schemas |= file_schemas(spark, unknown)
    columns = columns or unified_schema([schemas[p] for p in paths])
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(schemas[p].json(), []).append(p)
    parts = []
    for members in groups.values():
        part = spark.read.schema(schemas[members[0]]).parquet(*members)
        own = part.schema.fieldNames()
        chosen = [(F.col(f"`{n}`").cast(k) if n in own else F.lit(None).cast(k)).alias(n) for n, k in columns.items()]
        parts.append(part.select(*chosen, *([F.col("_metadata.file_path").alias("__file")] if with_file else [])))
    return reduce(DataFrame.unionByName, parts)


def fetched(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths with files behind http(s) URLs replaced by copies in the shared folder; a task fetches each one."""
    remote = [p for p in paths if p.startswith(("http://", "https://"))]
    if not remote:
        return paths
    target = fresh_path(spark, "remote")

    def fetch(batches):
        import shutil
        from urllib.request import urlopen

        from pyarrow import fs

        for batch in batches:
            for number, url in zip(batch.column("number").to_pylist(), batch.column("url").to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
                system.create_dir(at, recursive=True)
                with urlopen(url, timeout=60) as source, system.open_output_stream(f"{at}/{number}.tmp", compression=None) as sink:  # noqa: S310
                    shutil.copyfileobj(source, sink, 8 << 20)
                system.move(f"{at}/{number}.tmp", f"{at}/{number}.parquet")
            yield batch

    urls = spark.createDataFrame(list(enumerate(remote)), "number int, url string").repartition(len(remote), "number")
    urls.mapInArrow(fetch, "number int, url string").count()
    copies = {u: f"{target}/{k}.parquet" for k, u in enumerate(remote)}
    return [copies.get(p, p) for p in paths]


def read_mergetree(spark: SparkSession, paths: list[str], order_by: list[str]) -> DataFrame:
    """The files' rows in order of the keys, nulls last, as one sorted run per output partition."""
    return read_union(spark, paths).repartitionByRange(*(F.col(k).asc_nulls_last() for k in order_by)).sortWithinPartitions(*(F.col(k).asc_nulls_last() for k in order_by))
