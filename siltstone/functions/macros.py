"""The conversion functions of the SQL dialect, as expressions for columns of any type.

Each is a template over `{x}` that dispatches on typeof(x). Catalyst folds typeof, so only the branch
of the column's own type is left in the plan and everything stays in generated code.

Integers from text allow blanks around, signs, digits grouped by single underscores, hexadecimal
(0x) and binary (0b) forms, fractions and exponents, and round half away from zero; doubles round
half to even, decimals half away from zero. Out of range, or no number: null for the OrNull forms,
0 for the OrZero forms (also for null), an error for the plain forms.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: (least, greatest, Spark type) by integer kind. Names count bytes or bits as the dialect does.
KINDS = {
    "BIGINT": (-(2**63), 2**63 - 1, "bigint"),
    "SMALLINT": (-(2**15), 2**15 - 1, "smallint"),
    "INTEGER": (-(2**31), 2**31 - 1, "int"),
    # the type has 38 digits in Spark; of the 128-bit range the ends beyond that are out
    "HUGEINT": (-(10**38) + 1, 10**38 - 1, "decimal(38,0)"),
    "UTINYINT": (0, 2**8 - 1, "smallint"),
    "USMALLINT": (0, 2**16 - 1, "int"),
    "UINTEGER": (0, 2**32 - 1, "bigint"),
    "UBIGINT": (0, 2**64 - 1, "decimal(20,0)"),
}
#: Integer kind by the dialect's suffix.
SIGNED = {"Int8": "BIGINT", "Int16": "SMALLINT", "Int32": "INTEGER", "Int64": "BIGINT", "Int128": "HUGEINT", "Int256": "HUGEINT"}
UNSIGNED = {"UInt8": "UTINYINT", "UInt16": "USMALLINT", "UInt32": "UINTEGER", "UInt64": "UBIGINT"}

_TEXT = "regexp_replace(cast({x} AS string), '^\\\\s+|\\\\s+$', '')"
_DIGITS = "[0-9]+(_[0-9]+)*"
_DECIMAL = f"^[+-]?({_DIGITS}(\\\\.({_DIGITS})?)?|\\\\.{_DIGITS})([eE][+-]?[0-9]+)?$"


def _text_to_integer() -> str:
    plain = f"replace({_TEXT}, '_', '')"
    return (
        f"CASE WHEN {_TEXT} RLIKE '{_DECIMAL}' THEN try_cast({plain} AS decimal(38,0)) "
        f"WHEN {_TEXT} RLIKE '^0[xX][0-9a-fA-F]+(_[0-9a-fA-F]+)*$' THEN try_cast(conv(substr({plain}, 3), 16, 10) AS decimal(38,0)) "
        f"WHEN {_TEXT} RLIKE '^0[bB][01]+(_[01]+)*$' THEN try_cast(conv(substr({plain}, 3), 2, 10) AS decimal(38,0)) END"
    )


def _integer(kind: str) -> str:
    low, high, spark = KINDS[kind]
    number = (
        "CASE WHEN typeof({x}) IN ('double', 'float') THEN try_cast(rint(try_cast({x} AS double)) AS decimal(38,0)) "
        "WHEN typeof({x}) LIKE 'decimal%' THEN try_cast(cast({x} AS string) AS decimal(38,0)) "
        "WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN cast(try_cast({x} AS bigint) AS decimal(38,0)) "
        f"ELSE {_text_to_integer()} END"
    )
    return f"try_cast(CASE WHEN {number} BETWEEN {low}BD AND {high}BD THEN {number} END AS {spark})"


def _float() -> str:
    plain = f"replace({_TEXT}, '_', '')"
    words = f"lower({_TEXT}) IN ('nan', 'inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')"
    return (
        f"CASE WHEN typeof({{x}}) <> 'string' THEN try_cast({{x}} AS double) WHEN {_TEXT} RLIKE '{_DECIMAL}' THEN try_cast({plain} AS double) "
        f"WHEN {words} THEN try_cast({_TEXT} AS double) END"
    )


def _to_string() -> str:
    """Doubles with at least one decimal, and an exponent of two digits below 1e-4 and from 1e16 on."""
    raw = "cast({x} AS string)"
    number = f"abs(try_cast({raw} AS double))"
    digits = f"replace(regexp_replace(regexp_extract({raw}, '^-?([0-9.]+)', 1), '\\\\.0$', ''), '.', '')"
    sign = f"if({raw} LIKE '-%', '-', '')"
    exponent = f"cast(coalesce(nullif(regexp_extract({raw}, 'E(-?[0-9]+)$', 1), ''), '0') AS int)"
    mantissa = f"concat(substr({digits}, 1, 1), if(length({digits}) > 1, concat('.', substr({digits}, 2)), ''))"
    scientific = f"concat({sign}, {mantissa}, 'e', if({exponent} < 0, '-', '+'), lpad(cast(abs({exponent}) AS string), greatest(2, length(cast(abs({exponent}) AS string))), '0'))"
    large = f"concat({sign}, if(length({digits}) > {exponent} + 1, concat(substr({digits}, 1, {exponent} + 1), '.', substr({digits}, {exponent} + 2)), concat(rpad({digits}, {exponent} + 1, '0'), '.0')))"
    small = f"concat({sign}, '0.', repeat('0', -{exponent} - 1), {digits})"
    double = (
        f"CASE WHEN {raw} = 'NaN' THEN 'nan' WHEN {raw} = 'Infinity' THEN 'inf' WHEN {raw} = '-Infinity' THEN '-inf' WHEN NOT contains({raw}, 'E') THEN {raw} "
        f"WHEN {number} >= 1e16D OR {number} < 1e-4D THEN {scientific} WHEN {exponent} > 0 THEN {large} ELSE {small} END"
    )
    return f"CASE WHEN typeof({{x}}) IN ('double', 'float') THEN {double} ELSE {raw} END"


def _strict(template: str, name: str) -> str:
    return f"CASE WHEN {{x}} IS NOT NULL AND ({template}) IS NULL THEN raise_error(concat('{name}: no such value: ', cast({{x}} AS string))) ELSE {template} END"


def _zero(template: str, spark: str) -> str:
    return f"coalesce({template}, cast(0 AS {spark}))"


def _build() -> dict[str, str]:
    out = {"toString": _to_string()}
    for name, kind in (SIGNED | UNSIGNED).items():
        safe, spark = _integer(kind), KINDS[kind][2]
        out[f"to{name}"] = _strict(safe, f"to{name}")
        out[f"to{name}OrZero"], out[f"to{name}OrNull"] = _zero(safe, spark), safe
        if name in UNSIGNED:  # the dialect's own spelling beside the regular one
            out[f"to{name}rZero"], out[f"to{name}rNull"] = out[f"to{name}OrZero"], out[f"to{name}OrNull"]
    out["toFloat"] = _strict(_float(), "toFloat")
    out["toFloatOrNull"], out["toFloatOrZero"] = _float(), _zero(_float(), "double")
    return out


#: SQL templates over {x} by function name.
TEMPLATES = _build()
#: Functions of two arguments, over {a} and {b}.
PAIRS = {
    # division of doubles: infinite or NaN for a zero divisor
    "intDiv": "CASE WHEN cast({b} AS double) <> 0 THEN cast({a} AS double) / cast({b} AS double) WHEN cast({b} AS double) = 0 THEN "
    "CASE WHEN cast({a} AS double) > 0 AND NOT isnan(cast({a} AS double)) THEN double('Infinity') WHEN cast({a} AS double) < 0 THEN double('-Infinity') WHEN {a} IS NOT NULL THEN double('NaN') END END",
    # LIKE without an escape character, case-sensitive
    "match": "cast({a} AS string) LIKE replace({b}, '\\\\', '\\\\\\\\')",
}


#: Longer arguments are evaluated once and bound to a name, as templates repeat their argument.
_BIND = 120


def sql(name: str, *arguments: str) -> str:
    """The expression of a call, as Spark SQL text."""
    places = ["{x}"] if name in TEMPLATES else ["{a}", "{b}"]
    text = TEMPLATES.get(name) or PAIRS[name]
    for place, argument in zip(places, arguments, strict=True):
        if len(argument) > _BIND:
            bound = f"v{zlib.crc32((name + place + argument).encode())}"
            text = f"element_at(transform(array({argument}), {bound} -> {text.replace(place, bound)}), 1)"
        else:
            text = text.replace(place, f"({argument})")
    return f"({text})"


def call(name: str, *arguments: str) -> Column:
    """A call as a Column; arguments are SQL expressions or column names."""
    return F.expr(sql(name, *arguments))


EPOCH_NS = "(unix_micros(cast(({x}) AS timestamp)) * 1000)"


def epoch_ns(timestamp: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp (UTC session)."""
    return F.unix_micros(timestamp.cast("timestamp")) * 1000


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the dialect. Spark's have one type per parameter, so these take
    text (and timestamps for epoch_ns); `siltstone.plans.dialect` keeps the arguments' own types."""
    for name, template in TEMPLATES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURN {template.replace('{x}', 'x')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION intDiv(a DOUBLE, b DOUBLE) RETURN {PAIRS['intDiv'].replace('{a}', 'a').replace('{b}', 'b')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION match(a STRING, b STRING) RETURN {PAIRS['match'].replace('{a}', 'a').replace('{b}', 'b')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION epoch_ns(x TIMESTAMP) RETURN unix_micros(x) * 1000")
