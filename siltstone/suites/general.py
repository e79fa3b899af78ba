"""Queries of the general data-processing problems (p1, p2, p4, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import bad_rows, grid, schema_drift, small_files, spikes
from siltstone.session import fresh_path, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return small_files.plan_outputs(table(spark, sf, "index_entries"), table(spark, sf, "manifests")).select("entry_id")


def p1_directories(spark: SparkSession, sf: str) -> DataFrame:
    plan = small_files.plan_outputs(table(spark, sf, "index_entries"), table(spark, sf, "manifests"))
    return small_files.directory_report(plan).drop("outputs")


def p1_outputs(spark: SparkSession, sf: str) -> DataFrame:
    plan = small_files.plan_outputs(table(spark, sf, "index_entries"), table(spark, sf, "manifests"))
    return plan.groupBy("output_path").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("row_count").alias("known_rows"))


def p1_block_copy(spark: SparkSession, sf: str) -> DataFrame:
    """All events written as many tiny files, joined by copying their blocks, and read again."""
    scattered, root = fresh_path(spark, "scattered"), fresh_path(spark, "joined")
    table(spark, sf, "events").repartition(48, "event_id").write.parquet(scattered)
    files = spark.read.parquet(scattered).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("row_count"))
    number = F.pmod(F.xxhash64("path"), F.lit(4))
    plan = files.withColumn("output_path", F.concat(F.lit(f"{root}/merged-"), number.cast("string"), F.lit(".parquet")))
    written = small_files.consolidate(plan).agg(F.sum("inputs")).first()[0]
    if written != files.count():
        raise RuntimeError("files were lost or joined twice")
    return spark.read.parquet(root).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf, "table_snapshots"), table(spark, sf, "parsed_batches"))


def p2_unified(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.unified_points(table(spark, sf, "table_snapshots"), table(spark, sf, "parsed_batches"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    series = grid.regular_series(table(spark, sf, "readings"), table(spark, sf, "table_registry"), table(spark, sf, "field_limits"), whole=False)
    return series.where("status = 'filled'").select("source_id", "slot_start")


def p4_series(spark: SparkSession, sf: str) -> DataFrame:
    return grid.regular_series(table(spark, sf, "readings"), table(spark, sf, "table_registry"), table(spark, sf, "field_limits"))


def p4_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of each source's series from its first to its last reading, over midnights and days without readings, and how
    many of them are filled."""
    return p4_series(spark, sf).groupBy("source_id").agg(F.count("*").alias("slots"), F.count_distinct("slot_start").alias("distinct_slots"), F.count_if(F.col("status") != "observed").alias("filled"))


def p4_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Slots and readings' days of each source, before filling."""
    means = grid.slot_means(table(spark, sf, "readings"), table(spark, sf, "table_registry"))
    return means.groupBy("source_id").agg(F.count("*").alias("slots"), F.min("slot_start").alias("first_slot"), F.max("slot_start").alias("last_slot"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_reasons(spark, sf).select("reading_id")


def p5_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible(table(spark, sf, "readings"), table(spark, sf, "table_registry"), table(spark, sf, "field_limits"), counters=("passes",))


def p5_impossible(spark: SparkSession, sf: str) -> DataFrame:
    return p5_reasons(spark, sf).where("reason = 'impossible'").select("reading_id")


def p5_stuck(spark: SparkSession, sf: str) -> DataFrame:
    return p5_reasons(spark, sf).where("reason = 'stuck'").select("reading_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.failed_lines(table(spark, sf, "raw_lines"))


def p6_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Lines loaded and failed of each body; the good lines of a body load whatever the others do."""
    lines = table(spark, sf, "raw_lines")
    parsed = bad_rows.parse_lines(lines).select("line_id", F.col("reason").isNull().alias("good"))
    return parsed.join(lines.select("line_id", "body_id"), "line_id").groupBy("body_id").agg(F.count_if("good").alias("loaded"), F.count_if(~F.col("good")).alias("failed"))


def p6_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.loaded_lines(table(spark, sf, "raw_lines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_directories, p1_outputs, p1_block_copy, p2_found, p2_unified, p4_found, p4_series, p4_whole, p4_observed, p5_found, p5_reasons, p5_impossible, p5_stuck, p6_found, p6_bodies, p6_loaded)}

_PATH = """
    SELECT CASE WHEN p LIKE '%/tmp/../%' THEN replace(p, '/tmp/../', '/') ELSE p END AS path, * EXCLUDE (p) FROM (
    SELECT regexp_replace(replace(replace(CASE WHEN q LIKE '/%' THEN q ELSE '/data/' || q END, '/./', '/'), '%3D', '='), '/+', '/', 'g') AS p, * EXCLUDE (q) FROM (
    SELECT regexp_replace(trim(raw), '^file://', '') AS q, * EXCLUDE (raw) FROM ({0})))"""
_SMALL = f"""
    WITH dropped AS (SELECT DISTINCT path FROM ({_PATH.format("SELECT unnest(drop_queue) AS raw FROM manifests")})),
    files AS (SELECT path, min(entry_id) AS entry_id, max(CASE WHEN size_bytes >= 0 THEN size_bytes END) AS size_bytes,
                     max(CASE WHEN row_count >= 0 THEN row_count END) AS row_count
              FROM ({_PATH.format("SELECT path AS raw, entry_id, size_bytes, row_count FROM index_entries")})
              WHERE path NOT IN (SELECT path FROM dropped) GROUP BY path),
    small AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files WHERE size_bytes < 4194304),
    kept AS (SELECT *, count(*) OVER (PARTITION BY directory) AS n FROM small)"""
_EVENT_S = """
    SELECT source_id, table_name, interval_s, value,
           CASE WHEN r."time" IS NULL THEN r.__timestamp // 1000000000
                WHEN r."time" < 100000000000 THEN r."time"
                WHEN r."time" < 100000000000000 THEN r."time" // 1000
                WHEN r."time" < 100000000000000000 THEN r."time" // 1000000
                ELSE r."time" // 1000000000 END AS second
    FROM readings r JOIN table_registry t ON t.name = r.table_name WHERE value IS NOT NULL"""
_POINTS = """
    SELECT r.reading_id, r.source_id, r.field_name, r.value, NOT r.value BETWEEN l.low AND l.high AS impossible,
           CASE WHEN r."time" IS NULL THEN r.__timestamp
                WHEN r."time" < 100000000000 THEN r."time" * 1000000000
                WHEN r."time" < 100000000000000 THEN r."time" * 1000000
                WHEN r."time" < 100000000000000000 THEN r."time" * 1000
                ELSE r."time" END AS et
    FROM readings r LEFT JOIN field_limits l ON l.table_name = r.table_name AND l.field_name = r.field_name WHERE r.value IS NOT NULL"""

_CANONICAL = "CASE WHEN upper(trim(t)) IN ('INT64', 'BIGINT', 'INT8', 'LONG') THEN 'INT8' WHEN upper(trim(t)) IN ('UINT64', 'UBIGINT') THEN 'UBIGINT' WHEN upper(trim(t)) IN ('FLOAT64', 'DOUBLE', 'FLOAT8') THEN 'FLOAT8' WHEN upper(trim(t)) IN ('STRING', 'VARCHAR', 'CHAR', 'BPCHAR', 'TEXT') THEN 'VARCHAR' ELSE upper(trim(t)) END"
#: Of the states' differences, a name that goes and one of its type that comes are a rename where the values at all shared times are the same set.
_CHANGES = f"""
    WITH s AS (SELECT snapshot_id, any_value(seen_at) AS seen_at, any_value(db_name) AS db, any_value(name) AS name, any_value(field_names) AS names, any_value(field_types) AS types, any_value(timestamp_field) AS clock
        FROM table_snapshots GROUP BY snapshot_id),
    p AS (SELECT *, lag(snapshot_id) OVER (PARTITION BY db, name ORDER BY seen_at, snapshot_id) AS previous FROM s),
    f AS (SELECT DISTINCT snapshot_id, n AS field, {_CANONICAL} AS type FROM (SELECT snapshot_id, unnest(names) AS n, unnest(types) AS t FROM s)),
    came AS (SELECT p.snapshot_id, f.field, f.type FROM p JOIN f USING (snapshot_id) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.snapshot_id = p.previous AND g.field = f.field)),
    gone AS (SELECT p.snapshot_id, f.field, f.type FROM p JOIN f ON f.snapshot_id = p.previous WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.snapshot_id = p.snapshot_id AND g.field = f.field)),
    retyped AS (SELECT p.snapshot_id, f.field FROM p JOIN f USING (snapshot_id) JOIN f g ON g.snapshot_id = p.previous AND g.field = f.field AND g.type <> f.type),
    b AS (SELECT DISTINCT b.snapshot_id, b.batch_id, b.data, s.clock FROM parsed_batches b JOIN s USING (snapshot_id) WHERE b.data IS NOT NULL),
    t AS (SELECT snapshot_id, batch_id, data, unnest(from_json(json_extract(data, '$."' || clock || '"'), '["BIGINT"]')) AS raw, generate_subscripts(from_json(json_extract(data, '$."' || clock || '"'), '["BIGINT"]'), 1) AS i FROM b),
    cells AS (SELECT DISTINCT snapshot_id, CASE WHEN raw < 100000000000 THEN raw * 1000000000 WHEN raw < 100000000000000 THEN raw * 1000000 WHEN raw < 100000000000000000 THEN raw * 1000 ELSE raw END AS ns, i, data FROM t),
    pairs AS (SELECT p.snapshot_id, p.previous, o.field AS old, n.field AS new, n.type FROM p JOIN gone o USING (snapshot_id) JOIN came n ON n.snapshot_id = p.snapshot_id AND n.type = o.type),
    shared AS (SELECT DISTINCT q.snapshot_id, a.ns FROM (SELECT DISTINCT snapshot_id, previous FROM pairs) q JOIN cells a ON a.snapshot_id = q.snapshot_id JOIN cells o ON o.snapshot_id = q.previous AND o.ns = a.ns),
    sides AS (SELECT snapshot_id, snapshot_id AS state, new AS field, type FROM pairs UNION SELECT snapshot_id, previous, old, type FROM pairs),
    seen AS (SELECT d.snapshot_id, d.state, d.field, c.ns, d.type, from_json(json_extract(c.data, '$."' || d.field || '"'), '["VARCHAR"]')[c.i] AS v FROM sides d JOIN cells c ON c.snapshot_id = d.state JOIN shared h ON h.snapshot_id = d.snapshot_id AND h.ns = c.ns),
    sets AS (SELECT snapshot_id, state, field, list_sort(list(DISTINCT ns || '=' || coalesce(CASE WHEN type = 'FLOAT8' THEN CAST(TRY_CAST(v AS DOUBLE) AS VARCHAR) ELSE v END, ''))) AS vs FROM seen GROUP BY ALL HAVING count(v) > 0),
    renamed AS (SELECT q.snapshot_id, q.old, q.new FROM pairs q JOIN sets a ON a.snapshot_id = q.snapshot_id AND a.state = q.snapshot_id AND a.field = q.new JOIN sets o ON o.snapshot_id = q.snapshot_id AND o.state = q.previous AND o.field = q.old AND o.vs = a.vs)
    SELECT snapshot_id, 'renamed' AS change, new AS field_name FROM renamed
    UNION ALL SELECT snapshot_id, 'retyped', field FROM retyped
    UNION ALL SELECT snapshot_id, 'added', field FROM came ANTI JOIN renamed ON renamed.snapshot_id = came.snapshot_id AND renamed.new = came.field
    UNION ALL SELECT snapshot_id, 'removed', field FROM gone ANTI JOIN renamed ON renamed.snapshot_id = gone.snapshot_id AND renamed.old = gone.field"""

_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_QUOTED = r'"(?:[^"\\]|\\.)*"'
_POINT = r"^(?:[^\\, ]|\\.)+(?:,(?:[^\\=, ]|\\.)+=(?:[^\\, ]|\\.)+)*"
_FIELD = r'(?:[^\\=, "]|\\.)+='
_ANY, _TYPED = rf'(?:{_QUOTED}|(?:[^\\, "]|\\.)+)', rf"(?:{_QUOTED}|t|T|true|True|TRUE|f|F|false|False|FALSE|{_DECIMAL}|[+-]?[0-9]+i|\+?[0-9]+u)"
_FAILED = rf"""
    WITH l AS (SELECT line_id, rtrim(line, ' ' || chr(13) || chr(10)) AS line FROM raw_lines WHERE line IS NOT NULL),
    r AS (SELECT line_id, line, regexp_replace(line, '^(?:[^\\ ]|\\.)*', '') AS rest FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '#')),
    n AS (SELECT *, regexp_replace(rest, '{_QUOTED}', '""', 'g') AS bare FROM r),
    c AS (SELECT line_id, CASE WHEN NOT regexp_full_match(rest, '(?:[^"\\]|\\.|={_QUOTED}(?:[, ]|$))*\\?') THEN 'quoting'
        WHEN NOT regexp_full_match(line, '{_POINT} {_FIELD}{_ANY}(?:,{_FIELD}{_ANY})*(?: (?:[^\\ ]|\\.)+)?') THEN 'column_count'
        WHEN NOT regexp_full_match(line, '{_POINT} {_FIELD}{_TYPED}(?:,{_FIELD}{_TYPED})*(?: [+-]?[0-9]+)?') THEN 'value'
        WHEN len(list_filter(regexp_extract_all(bare, '=([+-]?[0-9]+)i', 1), lambda x: TRY_CAST(x AS BIGINT) IS NULL)) > 0 THEN 'value'
        WHEN len(list_filter(regexp_extract_all(bare, '=(\+?[0-9]+)u', 1), lambda x: TRY_CAST(x AS UBIGINT) IS NULL)) > 0 THEN 'value'
        WHEN regexp_matches(bare, ' [+-]?[0-9]+$') AND TRY_CAST(regexp_extract(bare, ' ([+-]?[0-9]+)$', 1) AS BIGINT) IS NULL THEN 'value' END AS reason FROM n)
    SELECT line_id, reason FROM c WHERE reason IS NOT NULL"""

#: A column's last name is found by walking its renames, each the next one of its name behind the state at hand.
_UNIFIED = f"""
    WITH RECURSIVE {_CHANGES[: _CHANGES.rindex("SELECT snapshot_id, 'renamed'")].strip().removeprefix("WITH")},
    o AS (SELECT snapshot_id, db, name, clock, row_number() OVER (PARTITION BY db, name ORDER BY seen_at, snapshot_id) AS n FROM p),
    ev AS (SELECT o.db, o.name, r.old, r.new, o.n, coalesce(lag(o.n) OVER (PARTITION BY o.db, o.name, r.old ORDER BY o.n), -1) AS before FROM renamed r JOIN o USING (snapshot_id)),
    walk AS (SELECT f.snapshot_id, o.db, o.name, o.n, f.field, f.field AS now, f.type, 0 AS steps FROM f JOIN o USING (snapshot_id)
        UNION ALL SELECT w.snapshot_id, w.db, w.name, e.n, w.field, e.new, w.type, w.steps + 1 FROM walk w JOIN ev e ON e.db = w.db AND e.name = w.name AND e.old = w.now AND w.n >= e.before AND w.n < e.n),
    named AS (SELECT snapshot_id, db, name, field, any_value(type) AS type, arg_max(now, steps) AS unified FROM walk GROUP BY snapshot_id, db, name, field),
    wide AS (SELECT db, name, unified, CASE WHEN bool_or(type NOT IN ('INT8', 'UBIGINT', 'FLOAT8')) THEN 'VARCHAR' WHEN bool_or(type = 'FLOAT8') OR count(DISTINCT type) > 1 THEN 'FLOAT8' ELSE any_value(type) END AS type FROM named GROUP BY ALL),
    u AS (SELECT snapshot_id, batch_id, data, max(received_at) AS received_at FROM parsed_batches WHERE data IS NOT NULL GROUP BY ALL),
    v AS (SELECT u.*, unnest(from_json(json_extract(u.data, '$."' || o.clock || '"'), '["BIGINT"]')) AS raw, generate_subscripts(from_json(json_extract(u.data, '$."' || o.clock || '"'), '["BIGINT"]'), 1) AS i, o.clock FROM u JOIN o USING (snapshot_id)),
    k AS (SELECT snapshot_id, batch_id, received_at, data, i, clock, CASE WHEN raw < 100000000000 THEN raw * 1000000000 WHEN raw < 100000000000000 THEN raw * 1000000 WHEN raw < 100000000000000000 THEN raw * 1000 ELSE raw END AS ns FROM v WHERE raw IS NOT NULL)
    SELECT w.db AS db_name, w.name, k.ns AS "time", w.unified AS field_name, w.type, arg_max_null(from_json(json_extract(k.data, '$."' || n.field || '"'), '["VARCHAR"]')[k.i], (k.received_at, k.batch_id)) AS value
    FROM k JOIN named n ON n.snapshot_id = k.snapshot_id AND n.field IS DISTINCT FROM k.clock JOIN wide w ON w.db = n.db AND w.name = n.name AND w.unified = n.unified GROUP BY 1, 2, 3, 4, 5"""
#: Local level and scatter by the medians of 25 points, without a filter; at the end of a source nothing returns.
_SPIKES = f"""
    d AS (SELECT DISTINCT source_id, et, value FROM e WHERE field_name <> 'passes' AND NOT coalesce(impossible, false)),
    v AS (SELECT *, median(value) OVER (PARTITION BY source_id ORDER BY et, value ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS level, count(*) OVER (PARTITION BY source_id) AS points FROM d),
    x AS (SELECT *, abs(value - level) > 7 * 1.4826 * median(abs(value - level)) OVER (PARTITION BY source_id) AS far FROM v WHERE points >= 8),
    g AS (SELECT *, sum(CASE WHEN far THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY et, value) AS run, lead(et) OVER (PARTITION BY source_id ORDER BY et, value) IS NULL AS ends FROM x),
    n AS (SELECT *, count(*) FILTER (WHERE far) OVER (PARTITION BY source_id, run) AS length, bool_or(far AND ends) OVER (PARTITION BY source_id, run) AS open FROM g)
    SELECT source_id, et, value FROM n WHERE far AND length <= 3 AND NOT open"""

_IMPLAUSIBLE = f"""
        WITH e AS ({_POINTS}),
        sd AS (SELECT DISTINCT source_id, et, value FROM e WHERE field_name <> 'passes'),
        sc AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY source_id ORDER BY et, value) THEN 0 ELSE 1 END AS new FROM sd),
        sg AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY et, value) AS run FROM sc),
        stuck AS (SELECT source_id, et, value FROM (SELECT *, count(*) OVER (PARTITION BY source_id, run) AS length FROM sg) WHERE length >= 12),
        {_SPIKES[: _SPIKES.rindex("SELECT source_id, et, value FROM n")].strip()},
        spikes AS ({_SPIKES[_SPIKES.rindex("SELECT source_id, et, value FROM n") :]}),
        judged AS (SELECT reading_id, CASE WHEN impossible THEN 'impossible'
            WHEN EXISTS (SELECT 1 FROM stuck s WHERE s.source_id = e.source_id AND s.et = e.et AND s.value = e.value) THEN 'stuck'
            WHEN EXISTS (SELECT 1 FROM spikes s WHERE s.source_id = e.source_id AND s.et = e.et AND s.value = e.value) THEN 'spike' END AS reason FROM e)"""

ORACLE = {
    "p2_found": _CHANGES,
    "p2_unified": _UNIFIED,
    "p6_found": _FAILED,
    "p6_bodies": f"""SELECT body_id, count(*) FILTER (WHERE reason IS NULL) AS loaded, count(*) FILTER (WHERE reason IS NOT NULL) AS failed
        FROM raw_lines LEFT JOIN ({_FAILED.strip()}) USING (line_id) WHERE line IS NOT NULL AND trim(line, ' ' || chr(13) || chr(10)) <> '' AND NOT starts_with(line, '#') GROUP BY body_id""",
    "p5_impossible": f"SELECT reading_id FROM ({_POINTS}) WHERE impossible",
    "p5_found": f"{_IMPLAUSIBLE} SELECT reading_id FROM judged WHERE reason IS NOT NULL",
    "p5_reasons": f"{_IMPLAUSIBLE} SELECT reading_id, reason FROM judged WHERE reason IS NOT NULL",
    # every source of the tables changes from point to point, but for the counters
    "p5_stuck": f"""
        WITH e AS ({_POINTS}),
        d AS (SELECT DISTINCT source_id, et, value FROM e WHERE field_name <> 'passes'),
        c AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY source_id ORDER BY et, value) THEN 0 ELSE 1 END AS new FROM d),
        g AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY et, value) AS run FROM c),
        n AS (SELECT *, count(*) OVER (PARTITION BY source_id, run) AS length FROM g)
        SELECT reading_id FROM e JOIN n USING (source_id, et, value) WHERE length >= 12 AND NOT coalesce(impossible, false)""",
    "p1_found": f"{_SMALL} SELECT entry_id FROM kept WHERE n >= 5",
    "p1_directories": f"""{_SMALL} SELECT directory, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(row_count) AS BIGINT) AS known_rows
        FROM kept WHERE n >= 5 GROUP BY directory""",
    # laid end to end in order of (bucket, path), a file at least as long as 8192 of them fill 128 MiB
    "p1_outputs": f"""{_SMALL}, laid AS (SELECT *, sum(greatest(size_bytes, 16384)) OVER (PARTITION BY directory ORDER BY CAST('0x' || substr(md5(path), 1, 4) AS INTEGER) % 64, path ROWS UNBOUNDED PRECEDING) - greatest(size_bytes, 16384) AS at
            FROM kept WHERE n >= 5)
        SELECT directory || '/merged-' || lpad(CAST(CAST(floor(laid.at / 134217728) AS BIGINT) AS VARCHAR), 6, '0') || '.2.parquet' AS output_path, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(row_count) AS BIGINT) AS known_rows
        FROM laid GROUP BY 1""",
    "p1_block_copy": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "p4_found": f"""
        WITH slots AS (SELECT DISTINCT source_id, interval_s, second - second % interval_s AS slot FROM ({_EVENT_S})),
        ends AS (SELECT source_id, interval_s, slot // 86400 AS d, min(slot) AS lo, max(slot) AS hi FROM slots GROUP BY ALL),
        grid AS (SELECT source_id, unnest(generate_series(lo, hi, CAST(interval_s AS BIGINT))) AS slot_start FROM ends)
        SELECT source_id, slot_start FROM grid ANTI JOIN slots ON grid.source_id = slots.source_id AND grid.slot_start = slots.slot""",
    "p4_whole": f"""WITH slots AS (SELECT source_id, interval_s, second - second % interval_s AS slot FROM ({_EVENT_S})),
        ends AS (SELECT source_id, (max(slot) - min(slot)) // interval_s + 1 AS n, count(DISTINCT slot) AS seen FROM slots GROUP BY source_id, interval_s)
        SELECT source_id, n AS slots, n AS distinct_slots, n - seen AS filled FROM ends""",
    "p4_observed": f"""SELECT source_id, count(DISTINCT second - second % interval_s) AS slots, min(second - second % interval_s) AS first_slot,
        max(second - second % interval_s) AS last_slot FROM ({_EVENT_S}) GROUP BY source_id""",
}
