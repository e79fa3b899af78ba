import math
import threading
from datetime import datetime
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone.functions import macros
from siltstone.plans import dialect


def value(spark, text):
    return spark.sql("SELECT " + dialect.rewrite(spark, f"SELECT {text} AS v").removeprefix("SELECT ")).first()[0]


@pytest.mark.parametrize(
    ("call", "want"),
    [("toInt32(2.5D)", 2), ("toInt32(3.5D)", 4), ("toInt32(2.5BD)", 3), ("toInt32('2.5')", 3), ("toInt8(9e18D)", 9000000000000000000), ("toInt16OrNull(40000)", None), ("toUInt8rZero('300')", 0), ("toUInt8OrZero(255.4D)", 255), ("toInt64OrNull(true)", 1),
     ("toUInt64('18446744073709551615')", 18446744073709551615), ("toInt128OrNull('99999999999999999999')", 99999999999999999999), ("toInt32OrZero(NULL)", 0), ("toInt32(NULL)", None), ("toFloatOrNull('1_000')", 1000.0), ("toFloatOrNull('0x1F')", None), ("toFloat(' -inf ')", -math.inf),
     ("toString(1e16D)", "1e+16"), ("toString(1e7D)", "10000000.0"), ("toString(1e-5D)", "1e-05"), ("toString(-0.001D)", "-0.001"), ("toString(true)", "true"), ("intDiv(7, 2)", 3.5), ("intDiv(1, 0)", math.inf), ("intDiv(-1, 0)", -math.inf),
     ("match('a_c', 'a\\\\_c')", False), ("match('ABC', 'a%')", False), ("toInt32(toString(toFloat('4.5')))", 5), ("epoch_ns('2024-01-01'::TIMESTAMP)", 1704067200 * 10**9), ("'toInt32(1)'", "toInt32(1)")],
)
def test_calls(spark, call, want):
    assert value(spark, call) == want


def test_zero_over_zero(spark):
    assert math.isnan(value(spark, "intDiv(0, 0)"))


@pytest.mark.parametrize("call", ["toInt32('abc')", "toUInt8(-1)", "toFloat('x')", "toInt16(1e9D)"])
def test_plain_forms_raise(spark, call):
    with pytest.raises(Exception, match="no such value"):
        value(spark, call)


def test_registered_functions(spark):
    macros.register(spark)
    assert tuple(spark.sql("SELECT toInt32('1e3'), toFloatOrZero('x'), intDiv(1, 4), match('abc', 'a%'), epoch_ns(TIMESTAMP '1970-01-01 00:00:01')").first()) == (1000, 0.0, 0.25, True, 10**9)


def test_conversions_stay_in_generated_code(spark):
    plan = spark.range(10).select(macros.call("toInt32OrNull", "cast(id AS double)").alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert "typeof" not in plan and "RLIKE" not in plan and "Python" not in plan


def test_epoch_folds_and_pushes_down(spark, testdata):
    df = spark.sql(dialect.rewrite(spark, f"SELECT event_id FROM parquet.`{testdata}/events.parquet` WHERE event_id >= epoch_ns('1970-01-01'::TIMESTAMP)"))
    assert "GreaterThanOrEqual(event_id,0)" in df._jdf.queryExecution().executedPlan().toString()


def test_query_forms(spark, tmp_path):
    spark.range(5).selectExpr("id", "id % 2 k").write.parquet(str(tmp_path / "a"))
    files = [str(p) for p in (tmp_path / "a").glob("*.parquet")]
    listed = "[" + ", ".join(f"'{f}'" for f in files) + "]"
    run = lambda q: [tuple(r) for r in spark.sql(dialect.rewrite(spark, q)).collect()]
    assert run(f"SELECT count() FROM read_parquet({listed}, union_by_name = true);") == [(5,)]
    assert run(f"SELECT id FROM read_parquet_mergetree({listed}, 'id')") == [(i,) for i in range(5)]
    assert sorted(run(f"SELECT k, id FROM read_parquet({listed}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1 ORDER BY k")) == [(0, 4), (1, 3)]
    assert run(f"SELECT count(*) FROM '{files[0]}'") and sorted(run(f"FROM read_parquet({listed}) SELECT id WHERE k = 1 LIMIT 9")) == [(1,), (3,)]
    assert run("SELECT time_bucket(INTERVAL '7 days', TIMESTAMP '2024-01-04 05:00:00')") == [(datetime(2024, 1, 1),)]
    spark.range(2).createOrReplaceTempView("twos")
    assert run("FROM twos WHERE id = 1 ORDER BY id") == [(1,)]
    assert run("FROM twos") == [(0,), (1,)]


def test_files_behind_urls(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "a"))
    [file] = (tmp_path / "a").glob("*.parquet")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(file.parent)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        query = f"SELECT sum(id) FROM 'http://127.0.0.1:{server.server_port}/{file.name}'"
        assert spark.sql(dialect.rewrite(spark, query)).first()[0] == 10
    finally:
        server.shutdown()


def test_scripts():
    assert dialect.statements("SELECT ';'; -- a; b\nSELECT 2;;") == ["SELECT ';'", "-- a; b\nSELECT 2"]
    assert dialect.arguments("a, f(b, c), 'x, y', [1, 2]") == ["a", "f(b, c)", "'x, y'", "[1, 2]"]
