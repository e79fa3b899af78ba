"""Column types by their accepted names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical name by accepted alias. The format's own.
ALIASES = {
    "INT8": ["Int64", "BIGINT", "INT8", "LONG"],
    "UBIGINT": ["UInt64", "UBIGINT"],
    "FLOAT8": ["Float64", "DOUBLE", "FLOAT8"],
    "VARCHAR": ["String", "STRING", "VARCHAR", "CHAR", "BPCHAR", "TEXT"],
}
CANONICAL = {alias.upper(): name for name, aliases in ALIASES.items() for alias in aliases}
#: The Spark type of each canonical name. Spark has no unsigned 64-bit integer.
SPARK = {"INT8": "bigint", "UBIGINT": "decimal(20,0)", "FLOAT8": "double", "VARCHAR": "string"}
#: Types from narrow to wide; two types have the wider one in common.
_WIDTH = ["bigint", "decimal(20,0)", "double", "string"]


def canonical_type(name: Column) -> Column:
    """The canonical name of a type column; unknown types are themselves in upper case."""
    lookup = F.create_map(*(F.lit(x) for x in chain(*CANONICAL.items())))
    upper = F.upper(F.btrim(name))
    return F.coalesce(F.element_at(lookup, upper), upper)


def spark_type(name: str) -> str:
    """The Spark type of a type alias; ValueError for an unknown one."""
    try:
        return SPARK[CANONICAL[name.strip().upper()]]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}") from None


def common_type(a: str, b: str) -> str:
    """The narrowest Spark type both convert to; string for kinds that don't mix."""
    if a == b:
        return a
    numeric = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "decimal(20,0)": 1, "float": 2, "double": 2}
    if a in numeric and b in numeric:
        return _WIDTH[max(numeric[a], numeric[b])]
    if {a, b} <= {"timestamp", "timestamp_ntz", "date"}:
        return "timestamp"
    return "string"
