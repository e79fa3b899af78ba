"""Databases and tables on a file system: writing, reading through manifests, compacting, vacuuming.

Layout: root/db/table/key=value/.../{uuid}.{level}.parquet beside the partition's metadata.json; tables
of engine Merge have no partition keys and keep their files in data/. Writes go to a staging folder
and are renamed in; the manifest is swapped last, so readers never see part of a write.

Every change of a manifest (by a write, a merge or a vacuum) is a commit: it is applied to the latest
version and claims the next version's number by creating .commits/metadata.json.N, which only one writer
can; who loses applies the change again to the winner's version. metadata.json is the latest version, readers that
find it behind follow the claims. Within a process commits of one partition wait for each other. columns.json, the table's
columns over all its files, is kept in the same way.
"""

from __future__ import annotations

import copy
import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import types
from siltstone.plans import compaction
from siltstone.plans.manifest import NAME, Entry, Manifest
from siltstone.session import checked_broadcast
from siltstone.sources.files import Files, s3_location
from siltstone.sources.union import read_union, unified_schema

INGEST = "__timestamp"
ENGINES = ("HiveMerge", "Merge")
_NAME = re.compile(r"[A-Za-z0-9_]+")
_EXPRESSIONS = {"date": "date_format(timestamp_micros(__timestamp div 1000), 'yyyy-MM-dd')", "hour": "date_format(timestamp_micros(__timestamp div 1000), 'HH')"}


#: Claims of versions older than so many are deleted; no writer may sleep through as many commits of others.
CLAIMS = 200
_locks: dict[str, threading.RLock] = {}
_locks_guard = threading.Lock()


def _lock(at: str) -> threading.RLock:
    with _locks_guard:
        return _locks.setdefault(at, threading.RLock())


class Conflict(RuntimeError):
    """A commit whose premises no longer hold, as another one came first."""


class CatalogError(ValueError):
    """A request that the catalog refuses: a bad name, unknown columns, an unknown engine."""


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise CatalogError(f"{name!r} is no name: letters, digits and _ only")
    return name


@dataclass
class TableSpec:
    """A table's declaration. `partition_by` maps keys to SQL expressions over the row."""

    name: str
    database: str = "default"
    engine: str = "HiveMerge"
    fields: dict[str, str] = field(default_factory=dict)
    order_by: list[str] = field(default_factory=lambda: [INGEST])
    timestamp_field: str | None = None
    timestamp_precision: str = "ns"
    partition_by: dict[str, str] = field(default_factory=lambda: dict(_EXPRESSIONS))
    auto_timestamp: bool = True
    #: Where the table's files lie if not below the lakehouse's root.
    location: str = ""

    def __post_init__(self):
        self.database = checked_name(self.database or "default")
        checked_name(self.name)
        if self.engine not in ENGINES:
            raise CatalogError(f"unknown engine {self.engine!r}")
        if self.engine == "Merge":
            self.partition_by = {}
        for kind in self.fields.values():
            types.spark_type(kind)
        if self.fields:
            known = {*self.fields, INGEST}
            for column in [*self.order_by, *([self.timestamp_field] if self.timestamp_field else [])]:
                if column not in known:
                    raise CatalogError(f"{column!r} is no field of {self.name}")


def from_request(text: str, database: str = "default") -> TableSpec:
    """A declaration from a create request: JSON, or `key: value` lines nested by indentation."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        raw = _read_yaml(text)
    stamp = raw.get("timestamp") or {}
    where = raw.get("s3_url") or ""
    if where and not where.startswith(("s3://", "s3a://")):
        raise CatalogError("s3_url must begin with s3://")
    keys = raw.get("partition_by") or ""
    partition = {k.strip(): _EXPRESSIONS.get(k.strip(), k.strip()) for k in keys.split(",") if k.strip()} if isinstance(keys, str) else dict(keys)
    return TableSpec(
        name=raw.get("create_table", ""),
        database=raw.get("database") or database,
        engine=raw.get("engine") or "HiveMerge",
        fields=dict(raw.get("fields") or {}),
        order_by=list(raw.get("order_by") or [INGEST]),
        timestamp_field=stamp.get("field"),
        timestamp_precision=stamp.get("precision") or "ns",
        partition_by=partition or dict(_EXPRESSIONS),
        location=s3_location(where) + f"/{raw.get('database') or database}/{raw.get('create_table', '')}" if where else "",
    )


def _read_yaml(text: str) -> dict:
    """Maps, lists of scalars and scalars, nested by indentation: all that a create request needs."""
    lines = [(len(s) - len(s.lstrip()), s.strip()) for s in text.splitlines() if s.strip() and not s.strip().startswith("#")]

    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s

    def block(at: int, depth: int):
        out = None
        while at < len(lines) and lines[at][0] >= depth:
            _, s = lines[at]
            if s.startswith("- "):
                out = out if out is not None else []
                out.append(scalar(s[2:]))
                at += 1
                continue
            key, _, value = s.partition(":")
            out = out if out is not None else {}
            at += 1
            if value.strip():
                out[key.strip()] = scalar(value)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][1].startswith("- ")):
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = ""
        return out, at

    return block(0, 0)[0] or {}


@dataclass
class Staged:
    """Files of a write below `folder`: by partition, their paths there and their entries."""

    database: str
    name: str
    folder: str
    batch: str | None
    schema: T.StructType
    groups: dict[str, list[tuple[str, Entry]]]


def _may_hold(key: str, value: str, day: str, start: int | None, end: int | None) -> bool:
    """Whether a date= folder, or an hour= folder below the date `day`, may hold ingest times in the bounds."""
    length = 10 if key == "date" else 13
    if key == "hour" and not day:
        return True
    at = value if key == "date" else f"{day} {value}"
    stamp = lambda ns: (datetime.fromtimestamp(0, UTC) + timedelta(microseconds=ns // 1000)).strftime("%Y-%m-%d %H")[:length]
    try:
        return (start is None or at >= stamp(start)) and (end is None or at <= stamp(end))
    except OverflowError:
        return True


class Lakehouse:
    def __init__(self, spark: SparkSession, root: str, grace_s: float = 30.0, row_group_rows: int = 8124):
        self.spark, self.root, self.grace_s, self.row_group_rows = spark, root.rstrip("/"), grace_s, row_group_rows
        self.files = Files(spark)
        self._locations: dict[tuple[str, str], str] = {}
        #: Functions that queries may call, by name, with their return types; see `siltstone.plans.query.run`.
        self.functions: dict[str, tuple[Callable, str]] = {}
        self._last_runs: dict[tuple[str, str, int], float] = {}

    # -- catalog

    def _home(self, database: str, name: str) -> str:
        return f"{self.root}/{checked_name(database)}/{checked_name(name)}"

    def in_session(self, spark: SparkSession) -> Lakehouse:
        """The same lakehouse for frames of another session."""
        other = copy.copy(self)
        other.spark = spark
        return other

    def location(self, database: str, name: str) -> str:
        """Where a table's files lie; its declaration is always below the root."""
        key = (database, name)
        if key not in self._locations:
            home = self._home(database, name)
            if not self.files.exists(f"{home}/table.json"):
                return home
            self._locations[key] = self.spec(database, name).location or home
        return self._locations[key]

    def create(self, spec: TableSpec, if_missing: bool = True) -> TableSpec:
        at = f"{self._home(spec.database, spec.name)}/table.json"
        if self.files.exists(at) or not self.files.create_new(at, json.dumps(asdict(spec))):
            if not if_missing:
                raise CatalogError(f"{spec.database}.{spec.name} exists")
            return self.spec(spec.database, spec.name)
        return spec

    def spec(self, database: str, name: str) -> TableSpec:
        at = f"{self._home(database, name)}/table.json"
        if not self.files.exists(at):
            raise CatalogError(f"no table {database}.{name}")
        return TableSpec(**json.loads(self.files.read_text(at)))

    def databases(self) -> list[str]:
        return [n for n, is_dir, _ in self.files.list(self.root) if is_dir and not n.startswith((".", "_"))]

    def tables(self, database: str) -> list[str]:
        return [n for n, is_dir, _ in self.files.list(f"{self.root}/{checked_name(database)}") if is_dir and self.files.exists(f"{self.root}/{database}/{n}/table.json")]

    def partitions(self, database: str, name: str, start: int | None = None, end: int | None = None) -> list[str]:
        """Paths below the table of the folders that have a manifest. With bounds, folders of other dates and
        hours than ingest times in [start, end] lie in are not looked into."""
        base = self.location(database, name)
        spans = {}
        if start is not None or end is not None:
            for key, expression in self.spec(database, name).partition_by.items():
                if expression == _EXPRESSIONS.get(key):
                    spans[key] = (start, end)
        out: list[str] = []

        def visit(folder: str, day: str) -> None:
            for child, is_dir, _ in self.files.list(f"{base}/{folder}" if folder else base):
                if not is_dir:
                    if child == NAME:
                        out.append(folder)
                elif not child.startswith(".") and child != "tmp":
                    key, _, value = child.partition("=")
                    if key not in spans or _may_hold(key, value, day, *spans[key]):
                        visit(f"{folder}/{child}" if folder else child, value if key == "date" else day)

        visit("", "")
        return sorted(out)

    def manifest(self, database: str, name: str, partition: str) -> Manifest:
        text, _ = self._latest(f"{self.location(database, name)}/{partition}/{NAME}")
        return Manifest.loads(text) if text else Manifest(name)

    def _claim(self, at: str, version: int) -> str:
        folder, _, file = at.rpartition("/")
        return f"{folder}/.commits/{file}.{version}"

    def _latest(self, at: str) -> tuple[str | None, int]:
        """The text of the latest version of a document, and its number."""
        text = self.files.read_text(at) if self.files.exists(at) else None
        version = json.loads(text).get("version", 0) if text else 0
        while self.files.exists(self._claim(at, version + 1)):
            version += 1
            text = self.files.read_text(self._claim(at, version))
        return text, version

    def _swap(self, at: str, change: Callable[[str | None, int], str], lock: str | None = None) -> None:
        """Commit a change: `change` makes the text of the given version from the one before."""
        with _lock(lock or at):
            while True:
                before, version = self._latest(at)
                text, version = change(before, version + 1), version + 1
                if self.files.create_new(self._claim(at, version), text):
                    break
            while True:
                self.files.write_text(at, text)
                if not self.files.exists(self._claim(at, version + 1)):
                    break
                text, version = self._latest(at)  # another writer was faster; its version is the latest
            if version > CLAIMS:
                self.files.delete(self._claim(at, version - CLAIMS))

    def commit(self, database: str, name: str, partition: str, change: Callable[[Manifest], None]) -> None:
        """Apply a change to a partition's latest manifest. It may run several times, and raises Conflict
        where it no longer applies."""

        def renewed(text: str | None, version: int) -> str:
            manifest = Manifest.loads(text) if text else Manifest(name)
            change(manifest)
            manifest.version = version
            return manifest.dumps()

        self._swap(f"{self.location(database, name)}/{partition}/{NAME}", renewed)

    def columns(self, database: str, name: str) -> dict[str, str]:
        """Names and types of the table's columns over all its files."""
        text, _ = self._latest(f"{self.location(database, name)}/columns.json")
        return json.loads(text)["columns"] if text else {k: types.spark_type(v) for k, v in self.spec(database, name).fields.items()}

    def _widen(self, database: str, name: str, schema: T.StructType) -> None:
        known = self.columns(database, name)
        as_schema = lambda d: T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in d.items()))
        wider = lambda d: unified_schema([*([as_schema(d)] if d else []), schema])
        if wider(known) != known:
            self._swap(f"{self.location(database, name)}/columns.json", lambda text, version: json.dumps({"version": version, "columns": wider(json.loads(text)["columns"] if text else known)}))

    # -- writing

    def write(self, database: str, name: str, rows: DataFrame, batch: str | None = None, stamp: Column | None = None) -> int:
        """Append rows; returns how many. The table is created on first write.

        Rows get an ingest time in nanoseconds (overwriting a column of that name) unless the table
        says otherwise or `stamp` gives one. With a `batch` id, file names follow from it, so that
        writing the same batch again replaces its files.
        """
        return self.land(self.stage(database, name, rows, batch, stamp))

    def stage(self, database: str, name: str, rows: DataFrame, batch: str | None = None, stamp: Column | None = None) -> Staged:
        """The files of a write, not yet to be seen by readers; `land` commits them, `discard` deletes them."""
        database = database or "default"
        spec = self.create(TableSpec(name, database))
        if spec.auto_timestamp or stamp is not None:
            rows = rows.withColumn(INGEST, stamp if stamp is not None else F.unix_micros(F.current_timestamp()) * 1000)
        for column, kind in spec.fields.items():
            if column in rows.columns:
                rows = rows.withColumn(column, F.col(f"`{column}`").cast(types.spark_type(kind)))
        schema = rows.schema
        keys = list(spec.partition_by)
        for key, expression in spec.partition_by.items():
            rows = rows.withColumn(f"__part_{key}", F.expr(expression).cast("string"))
        staging = f"{self.location(database, name)}/tmp/{batch or uuid.uuid4().hex}"
        parts = [f"__part_{k}" for k in keys]
        out = rows.hint("rebalance", *parts) if parts else rows.hint("rebalance")
        writer = out.write.mode("overwrite").option("parquet.block.row.count.limit", str(self.row_group_rows))
        (writer.partitionBy(*parts) if parts else writer).parquet(staging)
        groups: dict[str, list[tuple[str, Entry]]] = {}
        for path, entry in sorted(self._stats(staging, rows.schema.fieldNames()).items()):
            folder, _, _ = path.rpartition("/")
            partition = "/".join(s.removeprefix("__part_") for s in folder.split("/")) if folder else "data"
            groups.setdefault(partition, []).append((path, entry))
        return Staged(database, name, staging, batch, schema, groups)

    def land(self, staged: Staged) -> int:
        """Commit staged files, partition by partition; returns their rows."""
        database, name, batch = staged.database, staged.name, staged.batch
        base = self.location(database, name)
        if staged.groups:
            self._widen(database, name, staged.schema)

        def commit(item: tuple[str, list[tuple[str, Entry]]]) -> None:
            partition, members = item
            fresh = []
            for k, (path, entry) in enumerate(members):
                entry.path = f"{batch}-{k}.1.parquet" if batch else f"{uuid.uuid4()}.1.parquet"
                self.files.move(f"{staged.folder}/{path}", f"{base}/{partition}/{entry.path}")
                fresh.append(entry)

            def change(manifest: Manifest) -> None:
                if batch:
                    manifest.replace([f for f in manifest.files if f.startswith(f"{batch}-")], [])
                manifest.add(fresh)

            self.commit(database, name, partition, change)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(commit, staged.groups.items()))
        self.files.delete(staged.folder, True)
        return sum(e.row_count for members in staged.groups.values() for _, e in members)

    def discard(self, staged: Staged) -> None:
        self.files.delete(staged.folder, True)

    def _stats(self, folder: str, columns: list[str]) -> dict[str, Entry]:
        """Entries of the data files below a folder, by path: sizes from the file system, rows and
        bounds from one aggregation; only a row per file comes to the driver."""
        sizes = {p: n for p, n in self.files.walk(folder) if p.endswith(".parquet")}
        if not sizes:
            return {}
        frame = self.spark.read.option("mergeSchema", "false").parquet(folder)
        bounds = [F.min(INGEST).alias("lo"), F.max(INGEST).alias("hi")] if INGEST in columns else [F.lit(None).alias("lo"), F.lit(None).alias("hi")]
        found = frame.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *bounds).collect()
        schema = T.StructType([f for f in frame.schema.fields if not f.name.startswith(("__part_", "__out", "__slot"))]).json()
        by_tail = {spelling: p for p in sizes for spelling in (p, _quoted(p))}
        tail = folder.rstrip("/").rsplit("/", 1)[1] + "/"
        out = {}
        for r in found:
            path = by_tail[r.file.rpartition(tail)[2]]
            out[path] = Entry(path, sizes[path], r.n, r.lo, r.hi, schema=schema)
        for path in sizes:  # files without rows
            if path not in out:
                self.files.delete(f"{folder}/{path}")
        return out

    # -- reading

    def resolve(self, database: str, name: str, start: int | None = None, end: int | None = None) -> list[str]:
        """Paths of the files that may hold ingest times in [start, end] (nanoseconds)."""
        return list(self._resolve(database, name, start, end))

    def _manifests(self, database: str, name: str, start: int | None = None, end: int | None = None) -> dict[str, Manifest]:
        found = self.partitions(database, name, start, end)
        with ThreadPoolExecutor(16) as pool:
            return dict(zip(found, pool.map(lambda p: self.manifest(database, name, p), found), strict=True))

    def _resolve(self, database: str, name: str, start: int | None, end: int | None) -> dict[str, Entry]:
        base = self.location(database, name)
        return {f"{base}/{p}/{e.path}": e for p, m in self._manifests(database, name, start, end).items() for e in m.overlapping(start, end)}

    def scan(self, database: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """All rows, or those ingested in [start, end]; files outside are not opened, and of tables kept by
        date and hour no other folder's manifest is read. Event time plays no part: late events lie in the
        partition of their arrival."""
        found, columns = self._resolve(database, name, start, end), self.columns(database, name)
        if not found:
            return self.spark.createDataFrame([], ", ".join(f"`{k}` {v}" for k, v in columns.items()) or f"{INGEST} bigint")
        rows = read_union(self.spark, list(found), known=_schemas(found), columns=columns)
        if start is not None:
            rows = rows.where(F.col(INGEST) >= start)
        return rows.where(F.col(INGEST) <= end) if end is not None else rows

    def stats(self, database: str, name: str) -> list[tuple[str, int, int, int | None, int | None]]:
        """[(partition, files, rows, least, greatest ingest time)] from the manifests."""
        out = []
        for p, m in self._manifests(database, name).items():
            out.append((p, len(m.files), m.row_count, m.min_time, m.max_time))
        return out

    # -- maintenance

    def compact(self, database: str, name: str, level: int, min_files: int = 1, max_bytes: int | None = None) -> int:
        """Merge the table's files of a level into the next one; returns how many merges were done.

        All merges of all partitions are one Spark job: a row goes to the task of its output, which
        sorts by the table's keys, nulls last. A lone file above level 1 is only renamed.
        """
        tier = next(t for t in compaction.TIERS if t.level == level)
        tier = compaction.Tier(level, max_bytes or tier.max_bytes, tier.every)
        base, spec = self.location(database, name), self.spec(database, name)
        with _lock(f"{base}/compaction"):
            manifests = self._manifests(database, name)
            merges = [(p, m) for p, manifest in manifests.items() for m in compaction.plan(list(manifest.files.values()), tier, min_files)]
            lone = [(p, m) for p, m in merges if level > 1 and len(m.sources) == 1]
            done = 0
            for p, m in lone:
                entry = manifests[p].files[m.sources[0]]
                self.files.duplicate(f"{base}/{p}/{m.sources[0]}", f"{base}/{p}/{m.target}")
                done += self._replace(database, name, p, m.sources, [Entry(m.target, entry.size_bytes, entry.row_count, entry.min_time, entry.max_time, schema=entry.schema)])
            if rewrite := [x for x in merges if x not in lone]:
                done += self._rewrite(database, name, spec, manifests, rewrite)
        return done

    def _replace(self, database: str, name: str, partition: str, sources: tuple[str, ...], fresh: list[Entry]) -> bool:
        """Commit merged files in place of their sources; if a source has gone meanwhile, they are deleted instead."""

        def change(manifest: Manifest) -> None:
            if not all(s in manifest.files for s in sources):
                raise Conflict(partition)
            manifest.replace(list(sources), fresh)

        try:
            self.commit(database, name, partition, change)
            return True
        except Conflict:
            for e in fresh:
                self.files.delete(f"{self.location(database, name)}/{partition}/{e.path}")
            return False

    def _rewrite(self, database: str, name: str, spec: TableSpec, manifests: dict[str, Manifest], merges: list) -> int:
        base = self.location(database, name)
        paths = [(f"{base}/{p}/{s}", k) for k, (p, m) in enumerate(merges) for s in m.sources]
        known = _schemas({f"{base}/{p}/{s}": manifests[p].files[s] for p, m in merges for s in m.sources})
        rows = read_union(self.spark, [p for p, _ in paths], with_file=True, known=known)
        tasks = max(1, min(len(merges), 10_000))
        slots = _slots(self.spark, tasks)
        owner = self.spark.createDataFrame([(p.rsplit("/", 1)[1], k, slots[k % tasks]) for p, k in paths], "__name string, __out int, __slot bigint")
        owner = checked_broadcast(owner) if len(paths) <= 100_000 else owner
        rows = rows.withColumn("__name", F.substring_index("__file", "/", -1)).join(owner, "__name").drop("__file", "__name")
        keys = [F.col(k).asc_nulls_last() for k in spec.order_by if k in rows.columns]
        staging = f"{base}/tmp/{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(tasks, "__slot").drop("__slot").sortWithinPartitions("__out", *keys)
        sorted_rows.write.option("parquet.block.row.count.limit", str(self.row_group_rows)).partitionBy("__out").parquet(staging)
        stats = self._stats(staging, [c for c in rows.columns if c != "__slot"])
        done = 0
        for k, (p, m) in enumerate(merges):
            made = [(path, e) for path, e in stats.items() if path.startswith(f"__out={k}/")]
            want = sum(manifests[p].files[s].row_count for s in m.sources)
            if sum(e.row_count for _, e in made) != want:
                raise RuntimeError(f"merging into {p}/{m.target}: {want} rows were to come out")
            fresh = []
            for i, (path, entry) in enumerate(sorted(made)):
                entry.path = m.target if i == 0 else f"{i}-{m.target}"
                self.files.move(f"{staging}/{path}", f"{base}/{p}/{entry.path}")
                fresh.append(entry)
            done += self._replace(database, name, p, m.sources, fresh)
        self.files.delete(staging, True)
        return done

    def vacuum(self, database: str, name: str, now: float | None = None) -> int:
        """Delete merged inputs whose grace period is over; returns how many."""
        now, done = time.time() if now is None else now, 0
        for p, seen in self._manifests(database, name).items():
            if not any(now - at >= self.grace_s for at in seen.drop_queue.values()):
                continue
            old: list[str] = []

            def change(manifest: Manifest) -> None:
                old[:] = [f for f, at in manifest.drop_queue.items() if now - at >= self.grace_s]
                for f in old:
                    del manifest.drop_queue[f]

            self.commit(database, name, p, change)
            for f in old:
                self.files.delete(f"{self.location(database, name)}/{p}/{f}")
            done += len(old)
        return done

    def maintain(self, interval_s: float = 10.0, min_files: int = 2, workers: int = 10) -> int:
        """One maintenance round over all tables: every tier that is due, then vacuum."""
        now, jobs = time.time(), []
        for db in self.databases():
            for name in self.tables(db):
                for tier in compaction.TIERS:
                    key = (db, name, tier.level)
                    if compaction.due(tier, self._last_runs.get(key, 0.0), now, interval_s):
                        self._last_runs[key] = now
                        jobs.append(key)
        by_table: dict[tuple[str, str], list[int]] = {}
        for db, name, level in jobs:
            by_table.setdefault((db, name), []).append(level)

        def run(item) -> int:
            (db, name), levels = item
            merged = sum(self.compact(db, name, level, min_files) for level in levels)
            self.vacuum(db, name)
            return merged

        with ThreadPoolExecutor(workers) as pool:
            return sum(pool.map(run, by_table.items()))


def _slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions a number that falls into it, so that every output gets a task of its own."""
    ids = spark.range(20 * n, numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = {r.p: r.id for r in ids.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(p, p) for p in range(n)]


def _schemas(files: dict[str, Entry]) -> dict[str, T.StructType]:
    """The schemas the manifests know, by path; each distinct one is parsed once."""
    parsed = {text: T.StructType.fromJson(json.loads(text)) for text in {e.schema for e in files.values()} if text}
    return {path: parsed[e.schema] for path, e in files.items() if e.schema}


def _quoted(path: str) -> str:
    from urllib.parse import quote

    return quote(path, safe="/=-_.~")
