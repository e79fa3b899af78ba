"""Queries of the scalar functions, over whole columns as text and typed, and edge values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import macros
from siltstone.session import table

#: Edge values as text.
EDGES = ["42", " 42 ", "2.5", "-2.5", "3.5", "1e3", "0x1F", "0b101", "1_000", "1__0", "+5", ".5", "5.", "1.5e1", "inf", "nan", "true", "", "abc", "-0", "--1", "1 2", "1,000", "0.5", "-0.5",
         "300", "-1", "32768", "2147483648", "4294967296", "9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616", "99999999999999999999", "1d", "1.5e"]
DOUBLES = [2.5, 3.5, -2.5, 254.5, 1e20, 1e7, 1e-5, 1e16, 0.1, 123456.789, 1e-4, 0.001, 65536.5, -0.4]


def _texts(spark: SparkSession, sf: str, edges: bool) -> DataFrame:
    """(k, x): order keys of all orders as text, with the edge values; without edges, for the strict
    conversions, the keys' last two digits, as their SQL has them (0 to 99 fits every target type)."""
    orders = table(spark, sf, "orders")
    small = F.pmod("o_orderkey", F.lit(100)).cast("string")
    rows = orders.select(F.lit(0).alias("k"), small.alias("x")) if not edges else orders.select(F.lit(0).alias("k"), F.col("o_orderkey").cast("string").alias("x"))
    if not edges:
        return rows
    more = spark.createDataFrame([(1, e) for e in [*EDGES, None]], "k int, x string")
    return rows.unionByName(more)


def _oracle_texts(edges: bool) -> str:
    if not edges:
        return "SELECT 0 AS k, CAST(o_orderkey % 100 AS VARCHAR) AS x FROM orders"
    values = ", ".join(f"(1, '{e}')" for e in EDGES)
    return f"SELECT 0 AS k, CAST(o_orderkey AS VARCHAR) AS x FROM orders UNION ALL SELECT * FROM (VALUES {values}, (1, NULL))"


def _conversion(name: str) -> Callable[[SparkSession, str], DataFrame]:
    safe = name.endswith(("OrNull", "OrZero", "rNull", "rZero"))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _texts(spark, sf, safe)
        out = macros.call(name, "x").cast("string")
        if safe and "Float" not in name:
            typed = spark.createDataFrame([(2, d) for d in DOUBLES], "k int, d double")
            typed = typed.select("k", F.lit("double").alias("x"), macros.call(name, "d").cast("string").alias("y"))
            return rows.select("k", "x", out.alias("y")).unionByName(typed)
        return rows.select("k", "x", (macros.call(name, "x") if "Float" in name else out).alias("y"))

    run.__name__ = name
    return run


def _conversion_sql(name: str, kind: str) -> str:
    safe = name.endswith(("OrNull", "OrZero", "rNull", "rZero"))
    cast = f"TRY_CAST({{}} AS {kind})" if safe else f"CAST({{}} AS {kind})"
    if name.endswith("Zero"):
        cast = f"coalesce({cast}, 0)"
    if kind == "DOUBLE":
        return f"SELECT k, x, {cast.format('x')} AS y FROM ({_oracle_texts(safe)})"
    text = f"SELECT k, x, CAST({cast.format('x')} AS VARCHAR) AS y FROM ({_oracle_texts(safe)})"
    if not safe:
        return text
    doubles = ", ".join(f"(2, {d!r}::DOUBLE)" for d in DOUBLES)
    return f"{text} UNION ALL SELECT k, 'double' AS x, CAST({cast.format('d')} AS VARCHAR) AS y FROM (VALUES {doubles}) v(k, d)"


def _snake(name: str) -> str:
    name = name.replace("rZero", "OrZero").replace("rNull", "OrNull").replace("OOr", "Or") if name.startswith("toU") else name
    stem = name.removeprefix("to")
    for tail, text in (("OrZero", "_or_zero"), ("OrNull", "_or_null")):
        if stem.endswith(tail):
            return f"fn_to_{stem.removesuffix(tail).lower()}{text}"
    return f"fn_to_{stem.lower()}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _suffix, _kind in [*(macros.SIGNED | macros.UNSIGNED).items(), ("Float", "DOUBLE")]:
    for _tail in ("", "OrZero", "OrNull"):
        _name = f"to{_suffix}{_tail}"
        QUERIES[_snake(_name)] = _conversion(_name)
        ORACLE[_snake(_name)] = _conversion_sql(_name, _kind)


def fn_to_string(spark: SparkSession, sf: str) -> DataFrame:
    edges = spark.createDataFrame([(d,) for d in DOUBLES], "d double").select(F.lit("edge").alias("k"), macros.call("toString", "d").alias("y"))
    orders = table(spark, sf, "orders")
    return edges.unionByName(orders.select(F.lit("price").alias("k"), macros.call("toString", "o_totalprice").alias("y"))).unionByName(orders.select(F.lit("key").alias("k"), macros.call("toString", "o_orderkey").alias("y")))


def fn_int_div(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", macros.call("intDiv", "l_extendedprice", "l_quantity").alias("y"), macros.call("intDiv", "l_linenumber", "0").alias("z"))


def fn_match(spark: SparkSession, sf: str) -> DataFrame:
    edges = spark.createDataFrame([("abc", "a%"), ("ABC", "a%"), ("a_c", "a\\_c"), ("a\\xc", "a\\_c"), ("abc", "_b_"), (None, "a")], "x string, p string")
    parts = table(spark, sf, "part").select(F.col("p_type").alias("x"), F.lit("%A%").alias("p")).unionByName(edges)
    return parts.select("x", "p", macros.call("match", "x", "p").alias("y"))


def fn_epoch_ns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", macros.epoch_ns(F.col("ts")).alias("ns"))


def fn_date_parts(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"), F.hour(ts).alias("h"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


def fn_math(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(x, 1).alias("r"), F.floor(x).cast("bigint").alias("f"), F.ceil(x).cast("bigint").alias("c"), F.abs(-x).alias("a"), F.round(F.sqrt(x), 6).alias("s"), F.round(F.ln(x), 6).alias("l"), F.pmod("o_orderkey", F.lit(7)).cast("bigint").alias("m"))


def fn_string(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.upper(n).alias("u"), F.length(n).cast("bigint").alias("n"), F.substring(n, 2, 4).alias("s"), F.concat_ws("-", "p_brand", "p_type").alias("c"), F.regexp_replace(n, "[aeiou]", "_").alias("r"), F.trim(n).alias("t"))


def fn_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def fn_array(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), F.floor(total * 100).alias("total"), F.array_max(e).cast("double").alias("top"), F.element_at(e, 1).cast("double").alias("first"))


for _f in (fn_to_string, fn_int_div, fn_match, fn_epoch_ns, fn_date_parts, fn_math, fn_string, fn_json, fn_array):
    QUERIES[_f.__name__] = _f

_D = ", ".join(f"({d!r}::DOUBLE)" for d in DOUBLES)
ORACLE |= {
    "fn_to_string": f"SELECT 'edge' AS k, CAST(d AS VARCHAR) AS y FROM (VALUES {_D}) v(d) UNION ALL SELECT 'price', CAST(o_totalprice AS VARCHAR) FROM orders UNION ALL SELECT 'key', CAST(o_orderkey AS VARCHAR) FROM orders",
    "fn_int_div": "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS y, l_linenumber / 0 AS z FROM lineitem",
    "fn_match": r"SELECT x, p, x LIKE p AS y FROM (SELECT p_type AS x, '%A%' AS p FROM part UNION ALL SELECT * FROM (VALUES ('abc', 'a%'), ('ABC', 'a%'), ('a_c', 'a\_c'), ('a\xc', 'a\_c'), ('abc', '_b_'), (NULL, 'a')))",
    "fn_epoch_ns": "SELECT event_id, epoch_ns(ts) AS ns FROM events",
    "fn_date_parts": "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "fn_math": "SELECT o_orderkey, round(o_totalprice, 1) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, abs(-o_totalprice) AS a, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, o_orderkey % 7 AS m FROM orders",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_name, 2, 4) AS s, concat_ws('-', p_brand, p_type) AS c, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, trim(p_name) AS t FROM part",
    "fn_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "fn_array": "SELECT vec_id, len(embedding) AS n, CAST(floor(list_sum([CAST(v AS DOUBLE) FOR v IN embedding]) * 100) AS BIGINT) AS total, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings",
}
