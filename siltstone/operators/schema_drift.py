"""Schemas that drift: what changed between states of a table, and one table of all its points.

Columns that went and columns that came are profiled over the times both states' batches share: a 128-bit
sum of their (time, value) pairs, which is equal for equal columns, and a MinHash sketch of them, which tells how
many pairs two columns have in common. Within a state, columns of one type that are similar enough are matched
by the assignment of greatest total score, of value similarity first and name similarity second. With the
similarity that is asked for at 1, as where a rename must keep all values, only equal columns are matched.

Scale: states are compared with their predecessor within a day of their table first, and only each
day's last state meets the others of its table, so a hot table is spread over its days. Points are
grouped by (state, time), sketches by (state, column), in fixed space; columns meet within one state and type,
and there only those that share a value. What a column becomes and its type are settled per state, so points are
shuffled once, by their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.event_time import event_ns
from siltstone.session import materialise
from siltstone.types import canonical_type


#: Minima in a sketch, one for each share of the hashes; similarity is the share of them that two columns have in common.
MINIMA = 32
#: How much equal names add to the score of two columns, whose values add 1 at most.
NAME_WEIGHT = 0.25


def states(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, seen_at, db_name, name, fields, timestamp_field, precision), one row per id.

    Repeated rows count once (of unlike rows with one id, the least). Fields are distinct
    (name, type) pairs in order of name; null names, null ids and null arrays count for nothing;
    a name given twice keeps its first type.
    """
    pair = F.arrays_zip("field_names", "field_types")
    named = F.filter(pair, lambda x: x["field_names"].isNotNull())
    fields = F.transform(named, lambda x: F.struct(x["field_names"].alias("name"), canonical_type(x["field_types"]).alias("type")))
    rows = snapshots.where("snapshot_id is not null").select(
        F.col("snapshot_id").cast("bigint").alias("snapshot_id"),
        F.struct(
            F.col("seen_at").cast("timestamp_ntz").alias("seen_at"),
            F.coalesce("db_name", F.lit("")).alias("db_name"),
            F.coalesce("name", F.lit("")).alias("name"),
            F.array_sort(F.array_distinct(F.coalesce(fields, F.array().cast("array<struct<name:string,type:string>>")))).alias("fields"),
            F.col("timestamp_field").alias("timestamp_field"),
            F.col("timestamp_precision").alias("precision"),
        ).alias("s"),
    )
    return rows.groupBy("snapshot_id").agg(F.min("s").alias("s")).select("snapshot_id", "s.*")


_STATE = ["seen_at", "snapshot_id", "fields", "timestamp_field", "precision"]


def with_previous(now: DataFrame) -> DataFrame:
    """Each state with `previous`, the one before it of the same table by (seen_at, snapshot_id)."""
    rows = now.withColumn("day", F.coalesce(F.to_date("seen_at"), F.lit("0001-01-01").cast("date"))).withColumn("state", F.struct(*_STATE))
    in_day = Window.partitionBy("db_name", "name", "day").orderBy("seen_at", "snapshot_id")
    rows = rows.withColumn("previous", F.lag("state").over(in_day))
    lasts = rows.groupBy("db_name", "name", "day").agg(F.max("state").alias("last"))
    lasts = lasts.withColumn("carried", F.lag("last").over(Window.partitionBy("db_name", "name").orderBy("day"))).where("carried is not null").select("db_name", "name", "day", "carried")
    return rows.join(lasts, ["db_name", "name", "day"], "left").withColumn("previous", F.coalesce("previous", "carried")).drop("carried", "day", "state")


def _names(fields: Column) -> Column:
    return F.transform(fields, lambda x: x["name"])


def compare(now: DataFrame) -> DataFrame:
    """Each state that has a predecessor, with the fields `gone` and `came` (name, type) and the
    names `retyped`."""
    rows = with_previous(now).where("previous is not null")
    old, new = F.col("previous.fields"), F.col("fields")
    return (
        rows.withColumn("old_names", _names(old))
        .withColumn("new_names", _names(new))
        .withColumn("gone", F.filter(old, lambda x: ~F.array_contains(F.col("new_names"), x["name"])))
        .withColumn("came", F.filter(new, lambda x: ~F.array_contains(F.col("old_names"), x["name"])))
        .withColumn("retyped", F.array_distinct(_names(F.filter(new, lambda x: F.array_contains(F.col("old_names"), x["name"]) & ~F.array_contains(old, x)))))
        .drop("old_names", "new_names")
    )


def _batches(batches: DataFrame) -> DataFrame:
    """Distinct batches that hold data: (snapshot_id, batch_id, received_at, columns)."""
    good = batches.where("snapshot_id is not null and data is not null")
    good = good.groupBy("batch_id", "snapshot_id", "data").agg(F.max(F.col("received_at").cast("timestamp_ntz")).alias("received_at"))
    return good.select(F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "batch_id", "received_at", F.from_json("data", "map<string,array<string>>").alias("columns"))


def _plain(value: Column, kind: Column) -> Column:
    """Values of one type in one spelling, as text."""
    return F.when(kind == "FLOAT8", F.coalesce(value.try_cast("double").cast("string"), value)).otherwise(value)


def sketches(compared: DataFrame, batches: DataFrame, minima: bool = True) -> DataFrame:
    """(snapshot_id, side, name, type, shared, s1, s2, minima): the sketches of each column that came to the
    state or went from it, over the times that the batches of both states share.

    Only states that lost and won columns of one type are looked at. A column whose values are null
    at all shared times has no sketch. Without `minima` that array is empty.
    """
    types = lambda c: F.transform(F.col(c), lambda x: x["type"])
    both = compared.where(F.arrays_overlap(types("gone"), types("came")))
    wanted = both.select(
        F.col("snapshot_id").alias("pair"),
        F.explode(
            F.array(
                F.struct(F.col("previous.snapshot_id").alias("snapshot_id"), F.lit("old").alias("side"), F.col("gone").alias("fields"), F.col("previous.timestamp_field").alias("clock"), F.col("previous.precision").alias("precision")),
                F.struct(F.col("snapshot_id"), F.lit("new").alias("side"), F.col("came").alias("fields"), F.col("timestamp_field").alias("clock"), F.col("precision").alias("precision")),
            )
        ).alias("w"),
    ).select("pair", "w.*")
    found = _batches(batches).join(wanted, "snapshot_id")
    values = F.transform("fields", lambda f: F.named_struct(F.lit("name"), f["name"], F.lit("type"), f["type"], F.lit("values"), F.try_element_at("columns", f["name"])))
    found = found.select("pair", "side", "precision", values.alias("fields"), F.posexplode(F.try_element_at("columns", F.col("clock"))).alias("i", "time"))
    at = event_ns(F.col("time").try_cast("bigint"), F.lit(None).cast("bigint"), F.col("precision"))
    cell = lambda f: F.named_struct(F.lit("side"), F.col("side"), F.lit("name"), f["name"], F.lit("type"), f["type"], F.lit("value"), _plain(F.get(f["values"], F.col("i")), f["type"]))
    cells = found.select("pair", "side", at.alias("time"), F.transform("fields", cell).alias("cells")).where("time is not null")
    shared = cells.groupBy("pair", "time").agg(F.count_distinct("side").alias("sides"), F.array_distinct(F.flatten(F.collect_set("cells"))).alias("cells")).where("sides = 2")
    flat = shared.select("pair", "time", F.explode("cells").alias("c")).select("pair", "time", "c.*")
    value = F.coalesce("value", F.lit("\x00"))
    flat = flat.select("pair", "side", "name", "type", "value", F.xxhash64("time", value).alias("h1"), F.xxhash64(value, F.lit("second"), "time").alias("h2"))
    sums = [F.count("*").alias("shared"), F.count("value").alias("known"), F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2")]
    least = [F.min(F.when(F.pmod("h2", F.lit(MINIMA)) == k, F.col("h1"))).alias(f"m{k}") for k in range(MINIMA if minima else 0)]
    profiled = flat.groupBy(F.col("pair").alias("snapshot_id"), "side", "name", "type").agg(*sums, *least).where("known > 0")
    return profiled.select("snapshot_id", "side", "name", "type", "shared", "s1", "s2", F.array(*(f"m{k}" for k in range(MINIMA if minima else 0))).cast("array<bigint>").alias("minima"))


def name_similarity(a: str, b: str) -> float:
    """0 to 1 by common bigrams (Dice) of the lower-case names."""
    pa, pb = ({f"^{x.lower()}$"[i : i + 2] for i in range(len(x) + 1)} for x in (a, b))
    return 2 * len(pa & pb) / (len(pa) + len(pb))


def assign(old: list[str], new: list[str], score: Callable[[str, str], float] = name_similarity) -> list[tuple[str, str]]:
    """The assignment of old to new names with the greatest total score (shortest augmenting
    paths, cubic). Of unlike numbers the rest stays out; ties go to the first by name."""
    old, new = sorted(old), sorted(new)
    if len(old) > len(new):
        return [(o, n) for n, o in assign(new, old, lambda a, b: score(b, a))]
    inf, n, m = float("inf"), len(old), len(new)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, seen = [inf] * (m + 1), [False] * (m + 1)
        while match[at]:
            seen[at] = True
            row, delta, nearest = match[at], inf, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = -score(old[row - 1], new[j - 1]) - u[row] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, at
                    if least[j] < delta:
                        delta, nearest = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nearest
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return [(old[match[j] - 1], new[j - 1]) for j in range(1, m + 1) if match[j]]


def match_columns(old: list[dict], new: list[dict], least: float) -> list[tuple[str, str, float]]:
    """(old name, new name, similarity) of the columns of one state and type that are matched.

    Columns are {name, sums, minima}. Equal sums are similarity 1; others are as similar as the minima they have in
    common. Pairs below `least` are no candidates, so the assignment is solved for each group of columns linked
    by candidates by itself.
    """
    by_sum: dict = {}
    by_minimum: dict = {}
    for k, c in enumerate(old):
        by_sum.setdefault(c["sums"], []).append(k)
        if least < 1:
            for i, m in enumerate(c["minima"]):
                if m is not None:
                    by_minimum.setdefault((i, m), []).append(k)
    similar: dict[tuple[int, int], float] = {}
    for j, c in enumerate(new):
        common: dict[int, int] = {}
        if least < 1:
            for i, m in enumerate(c["minima"]):
                for k in by_minimum.get((i, m), ()) if m is not None else ():
                    common[k] = common.get(k, 0) + 1
        for k, n in common.items():
            filled = sum(a is not None or b is not None for a, b in zip(old[k]["minima"], c["minima"], strict=True))
            if n / filled >= least:
                similar[k, j] = n / filled
        for k in by_sum.get(c["sums"], ()):
            similar[k, j] = 1.0
    group = list(range(len(old) + len(new)))

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for k, j in similar:
        group[root(k)] = root(len(old) + j)
    members: dict[int, tuple[list[str], list[str]]] = {}
    for x in {x for k, j in similar for x in (k, len(old) + j)}:
        side = members.setdefault(root(x), ([], []))
        side[x >= len(old)].append((old + new)[x]["name"])
    olds, news = {c["name"]: k for k, c in enumerate(old)}, {c["name"]: j for j, c in enumerate(new)}
    out = []
    for o, n in members.values():
        score = lambda a, b: similar[olds[a], news[b]] + NAME_WEIGHT * name_similarity(a, b) if (olds[a], news[b]) in similar else -1.0
        out += [(a, b, similar[olds[a], news[b]]) for a, b in assign(o, n, score) if (olds[a], news[b]) in similar]
    return out


def renames(compared: DataFrame, batches: DataFrame, least: float = 1.0) -> DataFrame:
    """(snapshot_id, old_name, new_name, similarity) of the columns found to be renamed at each state: those of one
    type whose values are equal at the times both states share or, with `least` below 1, equal enough."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts:
            rows = []
            for i, columns in zip(*(batch.column(c).to_pylist() for c in ("snapshot_id", "columns")), strict=True):
                both = {side: [{"name": c["name"], "sums": (c["shared"], c["s1"], c["s2"]), "minima": c["minima"]} for c in columns if c["side"] == side] for side in ("old", "new")}
                rows += [(i, *m) for m in match_columns(both["old"], both["new"], least)]
            ids, olds, news, similar = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(olds, pa.string()), pa.array(news, pa.string()), pa.array(similar, pa.float64())], ["snapshot_id", "old_name", "new_name", "similarity"])

    # the columns of one state and type
    column = F.struct("side", "name", "shared", "s1", "s2", "minima")
    groups = sketches(compared, batches, least < 1).groupBy("snapshot_id", "type").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    groups = groups.where((F.element_at("columns", 1)["side"] == "new") & (F.element_at("columns", -1)["side"] == "old"))
    return groups.mapInArrow(run, "snapshot_id bigint, old_name string, new_name string, similarity double")


def changes(snapshots: DataFrame, batches: DataFrame, least: float = 1.0) -> DataFrame:
    """(snapshot_id, change, field_name): `added`, `removed`, `retyped` or `renamed` (the new name).

    The first state of a table has no changes; aliases of one type are the same type; names are
    case-sensitive and their order does not matter. A rename keeps at least the share `least` of the
    values. Without batches, or without a shared time, a
    rename is a removal and an addition. Empty tables give no rows.
    """
    compared = materialise(compare(states(snapshots)), "states")  # three branches below read it
    renamed = renames(compared, batches, least).groupBy("snapshot_id").agg(F.collect_list("old_name").alias("old"), F.collect_list("new_name").alias("new"))
    rows = compared.select("snapshot_id", "gone", "came", "retyped").join(renamed, "snapshot_id", "left")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    kinds = {"added": F.array_except(_names(F.col("came")), new), "removed": F.array_except(_names(F.col("gone")), old), "retyped": F.col("retyped"), "renamed": new}

    def report(kind: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.named_struct(F.lit("change"), F.lit(kind), F.lit("field_name"), x))

    reported = [report(*item) for item in kinds.items()]
    return rows.select("snapshot_id", F.explode(F.concat(*reported)).alias("c")).select("snapshot_id", "c.*")


def lineage(now: DataFrame, batches: DataFrame, least: float = 1.0) -> DataFrame:
    """(db_name, name, until, field, unified) of the states `now`: the name that a column called `field` before the state
    `until`, at which it was renamed, has in the unified table. It is the name the column last bears.

    Per table only its rename events are gathered, not its states or points.
    """
    compared = materialise(compare(now), "states")
    events = renames(compared, batches, least).join(compared.select("snapshot_id", "db_name", "name", "seen_at"), "snapshot_id")
    event = F.struct("seen_at", "snapshot_id", "old_name", "new_name")
    tables = events.groupBy("db_name", "name").agg(F.sort_array(F.collect_list(event)).alias("events"))

    def follow(parts: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in parts:
            rows = []
            for db, name, own in zip(*(batch.column(c).to_pylist() for c in ("db_name", "name", "events")), strict=True):
                last: dict[str, str] = {}  # by the name valid behind the event looked at, walking back
                for e in reversed(own):
                    final = last.pop(e["new_name"], e["new_name"])
                    rows.append((db, name, e["snapshot_id"], e["old_name"], final))
                    last[e["old_name"]] = final
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["db_name", "name", "until", "field", "unified"])

    return tables.mapInArrow(follow, "db_name string, name string, until bigint, field string, unified string")


def unified_columns(now: DataFrame, batches: DataFrame, least: float = 1.0) -> DataFrame:
    """(snapshot_id, columns): of each state its columns (field, unified, type), `type` being the narrowest that all
    states of the table share for the unified column (UBIGINT and INT8 meet in FLOAT8, anything meets
    VARCHAR in it)."""
    fields = now.select("db_name", "name", "snapshot_id", F.col("seen_at").alias("at"), F.explode("fields").alias("f")).select("db_name", "name", "snapshot_id", "at", F.col("f.name").alias("field"), F.col("f.type").alias("type"))
    moves = lineage(now, batches, least).join(now.select(F.col("snapshot_id").alias("until"), F.col("seen_at").alias("at")), "until")
    # a field is renamed by the first event behind the state that has its name
    both = fields.withColumn("unified", F.lit(None).cast("string")).unionByName(moves.select("db_name", "name", F.col("until").alias("snapshot_id"), "at", "field", F.lit(None).cast("string").alias("type"), "unified"))
    later = Window.partitionBy("db_name", "name", "field").orderBy(F.desc("at"), F.desc("snapshot_id"), F.col("unified").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    named = both.withColumn("next", F.last("unified", ignorenulls=True).over(later)).where("unified is null").select("db_name", "name", "snapshot_id", "field", "type", F.coalesce("next", "field").alias("unified"))
    rank = F.when(F.col("type") == "INT8", 1).when(F.col("type") == "UBIGINT", 2).when(F.col("type") == "FLOAT8", 4).otherwise(8)
    kind = F.bit_or(rank)
    kinds = named.groupBy("db_name", "name", "unified").agg(kind.alias("kind"))
    kind = F.col("kind")
    wide = F.when(kind >= 8, "VARCHAR").when((kind >= 4) | (kind == 3), "FLOAT8").when(kind == 2, "UBIGINT").otherwise("INT8")
    placed = named.join(kinds, ["db_name", "name", "unified"])
    return placed.groupBy("snapshot_id").agg(F.collect_list(F.struct("field", "unified", wide.alias("type"))).alias("columns"))


def unified_points(snapshots: DataFrame, batches: DataFrame, least: float = 1.0) -> DataFrame:
    """(db_name, name, time, field_name, type, value): all points of all tables in one table.

    A column that was renamed has the name it last bears. `type` is the narrowest type that all of
    the column's states share, value is its text. Of several values of a point, that of the batch received last
    counts. Points without a time, fields a state does not list and batches of unknown states stay out.
    """
    now = materialise(states(snapshots), "known")
    columns = materialise(unified_columns(now, batches, least), "columns").withColumnRenamed("columns", "unified")
    known = now.select("snapshot_id", "db_name", "name", "timestamp_field", "precision")
    rows = _batches(batches).join(known.join(columns, "snapshot_id"), "snapshot_id")
    fields = F.filter("unified", lambda f: ~f["field"].eqNullSafe(F.col("timestamp_field")))
    values = F.transform(fields, lambda f: F.named_struct(F.lit("field_name"), f["unified"], F.lit("type"), f["type"], F.lit("values"), F.try_element_at("columns", f["field"])))
    rows = rows.select("db_name", "name", "received_at", "batch_id", "precision", values.alias("fields"), F.posexplode(F.try_element_at("columns", F.col("timestamp_field"))).alias("i", "t"))
    at = event_ns(F.col("t").try_cast("bigint"), F.lit(None).cast("bigint"), F.col("precision"))
    cells = rows.select("db_name", "name", "received_at", "batch_id", at.alias("time"), F.explode(F.transform("fields", lambda f: F.named_struct(F.lit("field_name"), f["field_name"], F.lit("type"), f["type"], F.lit("value"), F.get(f["values"], F.col("i"))))).alias("c"))
    cells = cells.where("time is not null").select("*", "c.*").drop("c")
    points = cells.groupBy("db_name", "name", "time", "field_name", "type").agg(F.max_by("value", F.struct("received_at", "batch_id")).alias("value"))
    return points.select("db_name", "name", "time", "field_name", "type", "value")
