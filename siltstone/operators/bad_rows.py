"""Rows that fail to parse: the valid ones load typed, the others come out with their reason.

Each line is cut quote-aware into cells, the cells go through Python's strict csv reader, and its
structural exceptions are caught before any typed constructor sees a value. Narrow: one Arrow pass
over the input, no shuffle, so it scales with the input's splits and has no hot groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import spread
from siltstone.sources.lineproto import PARSED, failed_batches, parse_batches


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_id, db_name, precision, received_at, line) to line_id and the columns of PARSED.

    reason is null for rows that load, else `quoting`, `column_count` or `value`, the first that
    applies. Null lines, blank lines and comments give no row; further columns are ignored; lines
    given twice give two rows. An empty table gives none.
    """
    received = F.unix_micros(F.col("received_at").cast("timestamp")) * 1000
    source = lines.select(
        F.col("line_id").cast("bigint").alias("line_id"),
        F.col("db_name").cast("string").alias("db_name"),
        F.col("precision").cast("string").alias("precision"),
        received.alias("received_ns"),
        F.col("line").cast("string").alias("line"),
    )
    return spread(source).mapInArrow(parse_batches, "line_id bigint, " + PARSED)


def failed_lines(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that fail, by the same parser, without building the typed rows."""
    source = lines.select(F.col("line_id").cast("bigint").alias("line_id"), F.col("line").cast("string").alias("line"))
    return spread(source).mapInArrow(failed_batches, "line_id bigint, reason string")


def loaded_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).where("reason is null").drop("reason")
