"""Strict conversions of whole order keys and totals, with signs and fractions, against DuckDB."""

import pytest

from oracle import connection, oracle_rows, rows_of
from siltstone.functions import macros
from siltstone.session import table

#: Parts of an order that fit the target type, in SQL of both engines.
WIDE = ["cast(o_orderkey AS {text})", "cast(-o_orderkey AS {text})", "cast(o_orderkey * 1000003 AS {text})"]
FITTING = {"INTEGER": ["cast(o_orderkey AS {text})", "cast(-o_orderkey AS {text})"], "SMALLINT": ["cast(o_orderkey % 32768 AS {text})", "cast(-(o_orderkey % 32768) AS {text})"], "UTINYINT": ["cast(o_orderkey % 256 AS {text})"],
           "USMALLINT": ["cast(o_orderkey % 65536 AS {text})"], "UINTEGER": ["cast(o_orderkey AS {text})"], "UBIGINT": [WIDE[0], WIDE[2]]}
#: Totals have a fraction.
TOTAL = "cast(o_totalprice AS {text})"
CASES = [(f"to{s}", k, [*FITTING.get(k, WIDE), *([TOTAL] if k not in ("SMALLINT", "UTINYINT", "USMALLINT") else [])]) for s, k in (macros.SIGNED | macros.UNSIGNED).items()]
CASES.append(("toFloat", "DOUBLE", [*WIDE, TOTAL, "concat('-', cast(o_totalprice AS {text}))"]))


@pytest.mark.parametrize(("name", "kind", "values"), CASES)
def test_whole_columns(spark, testdata, name, kind, values):
    table(spark, testdata, "orders").createOrReplaceTempView("orders")
    texts = " UNION ALL ".join(f"SELECT o_orderkey AS k, {v} AS x FROM orders" for v in values)
    got = spark.sql(texts.format(text="string")).select("k", macros.call(name, "x").alias("y"))
    typed = got if kind == "DOUBLE" else got.select("k", got.y.cast("string").alias("y"))
    sql = f"SELECT k, CAST(x AS {kind}) AS y FROM ({texts.format(text='VARCHAR')})"
    if kind != "DOUBLE":
        sql = f"SELECT k, CAST(y AS VARCHAR) AS y FROM ({sql})"
    assert rows_of(typed) == oracle_rows(connection(testdata), sql)
