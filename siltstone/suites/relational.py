"""Relational queries: projections, filters, joins, aggregates, windows, sorts and set operations.

Each is a DataFrame program with the SQL it must agree with beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


class Tables:
    """Attribute access to a directory's tables; nothing is read before it is named."""

    def __init__(self, spark: SparkSession, sf: str):
        self._where = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return table(*self._where, name)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return build(Tables(spark, sf))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return build

    return register


# -- projections and filters

query("proj_columns", "SELECT ts, value FROM events")(lambda t: t.events.select("ts", "value"))
query("proj_star", "SELECT * FROM nation")(lambda t: t.nation.select("*"))
query("proj_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AS big FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"), (c("l_quantity") > 25).alias("big"))
)
query("filter_time_range", "SELECT event_id, ts, value FROM events WHERE epoch_ns(ts) >= epoch_ns(TIMESTAMP '2024-01-10 00:00:00')")(
    lambda t: t.events.where("ts >= '2024-01-10 00:00:00'::TIMESTAMP_NTZ").select("event_id", "ts", "value")
)
query("filter_time_between", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'")(
    lambda t: t.events.where("ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("event_id", "value")
)
query("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")(lambda t: t.orders.where(c("o_orderstatus") == "F"))
query(
    "filter_complex",
    "SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 30 OR p_brand IN ('Brand#12', 'Brand#23')) AND NOT (p_name LIKE '%a' OR p_type IS NULL)",
)(lambda t: t.part.where((c("p_size").between(10, 30) | c("p_brand").isin("Brand#12", "Brand#23")) & ~(c("p_name").like("%a") | c("p_type").isNull())).select("p_partkey"))

# -- joins

query("join_inner", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")(
    lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")
)
query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")(
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")
)
query("join_right", "SELECT p_partkey, l_orderkey, l_linenumber FROM (SELECT * FROM lineitem WHERE l_quantity > 45) RIGHT JOIN part ON l_partkey = p_partkey")(
    lambda t: t.lineitem.where("l_quantity > 45").join(t.part, c("l_partkey") == c("p_partkey"), "right").select("p_partkey", "l_orderkey", "l_linenumber")
)
query("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")(
    lambda t: t.supplier.join(t.customer.where("c_acctbal > 0"), (c("s_suppkey") == c("c_custkey")) & (c("s_nationkey") == c("c_nationkey")), "full").select("s_suppkey", "c_custkey")
)
query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")(
    lambda t: t.customer.join(t.orders.where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")
)
query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")
)
query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey <= b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda t: t.nation.alias("a").join(t.nation.alias("b"), (c("a.n_regionkey") <= c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_nationkey").alias("a"), c("b.n_nationkey").alias("b"))
)
query(
    "join_star",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
)(
    lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    .join(t.customer, c("o_custkey") == c("c_custkey"))
    .join(F.broadcast(t.nation.join(F.broadcast(t.region), c("n_regionkey") == c("r_regionkey"))), c("c_nationkey") == c("n_nationkey"))
    .groupBy("r_name", "n_name")
    .agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))
)


def interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, keys: list[str], width_s: int) -> DataFrame:
    """Rows of `left` whose time lies in [start, end) of rows of `right` with equal keys.

    Intervals are cut into buckets of `width_s`, on which the join is an equi-join, so no key is a
    nested loop; a pair meets in exactly one bucket, that of the time."""
    bucket = lambda x: F.floor(F.unix_seconds(c(x).cast("timestamp")) / width_s)
    r = right.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    return left.withColumn("_b", bucket(at)).join(r, [*keys, "_b"]).where((c(at) >= c(start)) & (c(at) < c(end))).drop("_b")


@query(
    "join_interval",
    """SELECT a.event_id AS start_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 2 HOURS
       WHERE a.event_type = 'purchase' GROUP BY 1""",
)
def _interval(t: Tables) -> DataFrame:
    starts = t.events.where("event_type = 'purchase'").select("user_id", c("event_id").alias("start_id"), c("ts").alias("start"), F.expr("ts + INTERVAL 2 HOURS").alias("end"))
    return interval_join(t.events.select("user_id", "ts"), starts, "ts", "start", "end", ["user_id"], 3600).groupBy("start_id").agg(F.count("*").alias("n"))


def asof_join(left: DataFrame, right: DataFrame, at: str, key: str, value: list[str], width: str = "day") -> DataFrame:
    """Each row of `left` with the last row of `right` of the same key at or before its time.

    One pass over the union within (key, time unit), by a window; units without an earlier row take
    the last one of the units before, found on one row per unit. So a hot key is spread over time."""
    carried = F.struct(c(at).alias("_at"), *value)
    fields = {f.name: f for f in left.schema}
    l = left.withColumn("_r", F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType)).withColumn("_right", F.lit(0))
    r = right.select(key, at, carried.alias("_r"), F.lit(1).alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_u", F.date_trunc(width, c(at)))
    w = Window.partitionBy(key, "_u").orderBy(c(at), c("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    units = both.groupBy(key, "_u").agg(F.max("_r").alias("_m"))
    before = Window.partitionBy(key).orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(key, "_u", F.last("_m", ignorenulls=True).over(before).alias("_m"))
    rows = rows.where("_right = 0").join(units, [key, "_u"], "left").withColumn("_last", F.coalesce("_last", "_m"))
    return rows.select(*fields, *(c("_last")[v].alias(v) for v in value))


@query(
    "join_asof",
    """SELECT a.event_id, b.pid, b.pv FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS pid, max(value) AS pv FROM events WHERE event_type = 'purchase' GROUP BY ALL) b
       ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type <> 'purchase'""",
)
def _asof(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("pid"), F.max("value").alias("pv"))
    return asof_join(t.events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "ts", "user_id", ["pid", "pv"]).select("event_id", "pid", "pv")


@query("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def _scalar(t: Tables) -> DataFrame:
    mean = t.orders.agg((F.avg("o_totalprice") * 1.5).alias("m"))
    return t.orders.join(F.broadcast(mean), c("o_totalprice") > c("m")).select("o_orderkey", "o_totalprice")


@query("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def _correlated(t: Tables) -> DataFrame:
    top = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(top, "o_custkey").where("o_totalprice >= top").select("o_orderkey")


# -- aggregates

query("agg_global", "SELECT count(*) AS n, round(avg(value), 4) AS mean FROM events")(lambda t: t.events.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")))
query("agg_group", "SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type")(lambda t: t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean")))
query("agg_multikey_order", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL ORDER BY mean DESC")(
    lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean")).orderBy(c("mean").desc_nulls_last())
)
query("agg_round_limit", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice)) AS mean FROM lineitem GROUP BY ALL ORDER BY 1, 2 LIMIT 10")(
    lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice")).alias("mean")).orderBy("l_returnflag", "l_linestatus").limit(10)
)
query("agg_sum_min_max", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderstatus")(
    lambda t: t.orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.sum("o_custkey").alias("keys"))
)
query("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")(lambda t: t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users")))
query("distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")(lambda t: t.part.select("p_brand", "p_type").distinct())
query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12"))
query("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_discount = 0), 4) AS tax FROM lineitem GROUP BY l_returnflag")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count_if(c("l_quantity") > 25).alias("big"), F.round(F.sum(F.when(c("l_discount") == 0, c("l_tax"))), 4).alias("tax"))
)
_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {}"
_measures = lambda: (F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
query("agg_rollup", _SETS.format("ROLLUP (o_orderstatus, o_orderpriority)"))(lambda t: t.orders.rollup("o_orderstatus", "o_orderpriority").agg(*_measures()))
query("agg_cube", _SETS.format("CUBE (o_orderstatus, o_orderpriority)"))(lambda t: t.orders.cube("o_orderstatus", "o_orderpriority").agg(*_measures()))
query("agg_grouping_sets", _SETS.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))(
    lambda t: t.orders.groupingSets([[c("o_orderstatus")], [c("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(*_measures())
)
query(
    "agg_stats",
    "SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_pop(value), 3) AS var, round(corr(value, user_id), 6) AS r, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY event_type",
)(
    lambda t: t.events.groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 4).alias("sd"),
        F.round(F.var_pop("value"), 3).alias("var"),
        F.round(F.corr("value", "user_id"), 6).alias("r"),
        F.round(F.percentile("value", 0.5), 4).alias("median"),
        F.round(F.percentile("value", 0.9), 4).alias("p90"),
    )
)
query("agg_approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type")(
    # the estimate beside the exact count; close is within three standard errors
    lambda t: t.events.groupBy("event_type")
    .agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count_distinct("user_id").alias("users"))
    .select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.06 * F.col("users")).alias("close"))
)
query("agg_time_bucket", "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")(
    lambda t: t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
)
query("agg_last_by_time", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")(
    lambda t: t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
)

# -- windows

_by_user = lambda: Window.partitionBy("user_id").orderBy("ts", "event_id")
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
query(
    "win_rank",
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, CAST(ntile(4) OVER w AS INTEGER) AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)",
)(
    lambda t: t.orders.select(
        "o_orderkey",
        F.row_number().over(w := Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rn"),
        F.rank().over(v := Window.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("rk"),
        F.dense_rank().over(v).alias("dr"),
        F.ntile(4).over(w).alias("nt"),
        F.round(F.percent_rank().over(w), 6).alias("pr"),
        F.round(F.cume_dist().over(w), 6).alias("cd"),
    )
)
query(
    "win_lag_lead",
    f"SELECT event_id, lag(value) {_W}) AS prev, lead(value, 2) {_W}) AS next2, first_value(value) {_W}) AS first, nth_value(value, 2) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events",
)(
    lambda t: t.events.select(
        "event_id",
        F.lag("value").over(_by_user()).alias("prev"),
        F.lead("value", 2).over(_by_user()).alias("next2"),
        F.first("value").over(_by_user()).alias("first"),
        F.nth_value("value", 2).over(_by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
    )
)
query("win_running_sum", f"SELECT event_id, round(sum(value) {_W} ROWS UNBOUNDED PRECEDING), 3) AS total FROM events")(
    lambda t: t.events.select("event_id", F.round(F.sum("value").over(_by_user().rowsBetween(Window.unboundedPreceding, 0)), 3).alias("total"))
)
query("win_moving_avg", f"SELECT event_id, round(avg(value) {_W} ROWS 4 PRECEDING), 4) AS mean FROM events")(
    lambda t: t.events.select("event_id", F.round(F.avg("value").over(_by_user().rowsBetween(-4, 0)), 4).alias("mean"))
)
query("win_range_time", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")(
    lambda t: t.events.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy(F.unix_micros(c("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 1_000_000, 0)).alias("n"))
)
query("win_topk_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")(
    lambda t: t.orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey"))).where("rn <= 3").select("o_custkey", "o_orderkey")
)

# -- event-time windows (the same expressions run on streams, see siltstone.streaming)

query("win_tumbling", "SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda t: t.events.groupBy(F.window(c("ts").cast("timestamp"), "15 minutes").start.cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
)
query(
    "win_sliding",
    """SELECT start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest(generate_series(time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '55 minutes', time_bucket(INTERVAL '5 minutes', ts), INTERVAL '5 minutes')) AS start,
       event_type, value FROM events) GROUP BY ALL""",
)(
    lambda t: t.events.groupBy(F.window(c("ts").cast("timestamp"), "1 hour", "5 minutes").start.cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
)
query(
    "win_session",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, sid""",
)(
    lambda t: t.events.withColumn("at", c("ts").cast("timestamp")).groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", c("w.start").cast("timestamp_ntz").alias("start"), c("w.end").cast("timestamp_ntz").alias("end"), "n")
)

# -- sorts and limits

query("sort_nulls_last", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal ASC NULLS LAST, c_custkey")(
    lambda t: t.customer.select("c_custkey", F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("bal")).orderBy(c("bal").asc_nulls_last(), "c_custkey")
)
query("limit_ordered", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")(lambda t: t.orders.orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey"))
query("topk", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")(
    lambda t: t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "l_partkey").limit(20)
)
query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 10 OFFSET 40")(lambda t: t.customer.orderBy("c_name", "c_custkey").offset(40).limit(10).select("c_custkey"))

# -- set operations

query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct())
query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")))
query("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda t: t.orders.select(c("o_custkey").alias("k")).intersect(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
)
query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda t: t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.select("o_custkey")))
query("set_intersect_all", "SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT p_size FROM part")(lambda t: t.lineitem.select(c("l_linenumber").alias("k")).intersectAll(t.part.select("p_size")))
query("set_except_all", "SELECT p_size AS k FROM part EXCEPT ALL SELECT l_linenumber FROM lineitem")(lambda t: t.part.select(c("p_size").alias("k")).exceptAll(t.lineitem.select("l_linenumber")))


@query(
    "flagship_hourly",
    """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n, avg(value) AS mean, max(value) AS top FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY ALL)
       SELECT bucket, event_type, n, round(mean, 4) AS mean, top, round(avg(mean) OVER (PARTITION BY event_type ORDER BY bucket ROWS 5 PRECEDING), 7) AS moving FROM h""",
)
def flagship(t: Tables) -> DataFrame:
    """Hourly count, mean and maximum per event type with a moving mean."""
    hours = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-02 00:00:00'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    w = Window.partitionBy("event_type").orderBy("bucket").rowsBetween(-5, 0)
    return hours.select("bucket", "event_type", "n", F.round("mean", 4).alias("mean"), "top", F.round(F.avg("mean").over(w), 7).alias("moving"))
