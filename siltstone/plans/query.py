"""Running query text against a database and rendering results."""

from __future__ import annotations

import json
import math
import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans.catalog import INGEST, Lakehouse, checked_name
from siltstone.plans.dialect import masked, rewrite, statements
from siltstone.session import DEFAULTS

_QUALIFIED = re.compile(r"(?<=[\s,(])(\w+)\.(\w+)(?![\w.(])")
_BEFORE_TABLE = re.compile(r"(?:\bfrom|\bjoin|,|\()\s*$", re.I)
_BOUNDS = {"GreaterThan": ("start", "end"), "GreaterThanOrEqual": ("start", "end"), "LessThan": ("end", "start"), "LessThanOrEqual": ("end", "start"), "EqualTo": ("both", "both")}


def run(lake: Lakehouse, database: str, text: str) -> DataFrame:
    """The result of one query, in a session of its own, so that queries never see each other's names.

    Tables it names become views over the files their manifests list. Which files are opened follows from
    the optimised plan: where every read of a table is filtered by bounds on __timestamp, files outside
    them are left out.
    """
    session = lake.spark.newSession()
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    for name, (function, kind) in lake.functions.items():
        session.udf.register(name, function, kind)
    own = lake.in_session(session)
    text, tables = _tables(own, database or "default", text)
    query = rewrite(session, text)
    opened: dict[str, str] = {}  # first path of a stand-in to the view it stands for
    for view, (db, name) in tables.items():
        columns, some = own.columns(db, name), _any_file(own, db, name)
        if some and INGEST in columns:
            session.read.schema(", ".join(f"`{k}` {v}" for k, v in columns.items())).parquet(some).createOrReplaceTempView(view)
            opened[some] = view
        else:
            own.scan(db, name).createOrReplaceTempView(view)
    if opened:
        found = bounds(session.sql(query), opened)
        for view in opened.values():
            own.scan(*tables[view], *found.get(view, (None, None))).createOrReplaceTempView(view)
    return session.sql(query)


def _tables(lake: Lakehouse, database: str, text: str) -> tuple[str, dict[str, tuple[str, str]]]:
    """The text with db.table names made view names, and the tables by view name."""
    hidden, tables, pieces, at = masked(text), {}, [], 0
    for m in _QUALIFIED.finditer(hidden):
        db, name = m.groups()
        if _BEFORE_TABLE.search(hidden[: m.start()]) and lake.files.exists(f"{lake.root}/{db}/{name}/table.json"):
            view = f"__{db}__{name}"
            tables[view] = (db, name)
            pieces += [text[at : m.start()], f"{view} AS {name}" if not re.match(r"\s+(?:as\s+)?(?!(?:where|join|inner|left|right|full|cross|on|using|group|order|limit|having|union|except|intersect|qualify|natural|semi|anti|offset|window)\b)[a-z_]\w*", hidden[m.end() :], re.I) else view]
            at = m.end()
    text = "".join([*pieces, text[at:]])
    words = set(re.findall(r"\w+", masked(text)) + re.findall(r"`(\w+)`", text) + re.findall(r'"(\w+)"', text))
    for name in lake.tables(checked_name(database)):
        if name in words:
            tables[name] = (database, name)
    return text, tables


def _any_file(lake: Lakehouse, database: str, name: str) -> str | None:
    """A file of the table, wherever; its folder is found without a look at the others."""
    base = lake.location(database, name)

    def first(folder: str) -> str | None:
        for child, is_dir, _ in lake.files.list(f"{base}/{folder}" if folder else base):
            if not is_dir and child == "metadata.json":
                files = lake.manifest(database, name, folder).files
                if files:
                    return f"{base}/{folder}/{next(iter(files))}"
            elif is_dir and not child.startswith(".") and child != "tmp":
                found = first(f"{folder}/{child}" if folder else child)
                if found:
                    return found
        return None

    return first("")


def bounds(result: DataFrame, opened: dict[str, str]) -> dict[str, tuple[int | None, int | None]]:
    """(least, greatest) ingest time that the optimised plan reads of each view, None where a read has no
    such bound. `opened` are the views by the path that stands for them."""
    reads: dict[str, list[tuple[int | None, int | None]]] = {}

    def each(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def conjuncts(condition):
        if condition.getClass().getSimpleName() == "And":
            return conjuncts(condition.left()) + conjuncts(condition.right())
        return [condition]

    def limits(conditions) -> tuple[int | None, int | None]:
        low = high = None
        for c in conditions:
            kind = c.getClass().getSimpleName()
            if kind not in _BOUNDS:
                continue
            sides = [x.getClass().getSimpleName() for x in (c.left(), c.right())]
            if sorted(sides) != ["AttributeReference", "Literal"]:
                continue
            column, literal, flipped = (c.left(), c.right(), 0) if sides[0] == "AttributeReference" else (c.right(), c.left(), 1)
            value = literal.value()
            if column.name() != INGEST or not isinstance(value, int):
                continue
            side = _BOUNDS[kind][flipped]
            if side in ("start", "both"):
                low = value if low is None else max(low, value)
            if side in ("end", "both"):
                high = value if high is None else min(high, value)
        return low, high

    def visit(node, conditions) -> None:
        kind = node.getClass().getSimpleName()
        for sub in each(node.subqueries()):
            visit(sub, [])
        if kind == "LogicalRelation":
            relation = node.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                for root in each(relation.location().rootPaths()):
                    path = root.toString()
                    for known, view in opened.items():
                        if path.endswith(known.split(":", 1)[-1].lstrip("/")):
                            reads.setdefault(view, []).append(limits(conditions))
        own = conjuncts(node.condition()) if kind == "Filter" else []
        for child in each(node.children()):
            visit(child, own)

    visit(result._jdf.queryExecution().optimizedPlan(), [])
    out = {}
    for view, found in reads.items():
        lows, highs = [lo for lo, _ in found], [hi for _, hi in found]
        out[view] = (None if None in lows else min(lows), None if None in highs else max(highs))
    return out


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    return [spark.sql(rewrite(spark, s)) for s in statements(script)]


def column_name(name: str) -> str:
    """Result names as clients of the dialect expect them."""
    return "count_star()" if name in ("count(1)", "count(*)") else name


def plain(value):
    """A value as JSON: 64-bit integers and decimals as text, times in ISO form, no NaN."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value]


def to_json(result: DataFrame) -> str:
    """{"results": [...]}; rows come over one partition at a time."""
    names = [column_name(n) for n in result.columns]
    small = {f.name for f in result.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int")}
    rows = [{n: v if c in small else plain(v) for n, c, v in zip(names, result.columns, row, strict=True)} for row in result.toLocalIterator()]
    return json.dumps({"results": rows})
