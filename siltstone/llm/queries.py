"""Queries of the text and algorithm problems (p3, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import mixing, percentiles, residue, tokenizer
from siltstone.session import table

_GROUPS = ["table_name", "field_name"]


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.reading_values(table(spark, sf, "readings"), table(spark, sf, "table_registry"))


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per table and field, over all days and per day."""
    return percentiles.percentiles(_values(spark, sf), _GROUPS).select(*_GROUPS, F.col("part").alias("day"), "whole", "p", F.col("total").alias("n"), "value")


def p3_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from the days' states alone, combined; their error is below 2**-10."""
    states = percentiles.histograms(_values(spark, sf), _GROUPS)
    return percentiles.approximate(states, _GROUPS).select(*_GROUPS, "p", F.col("total").alias("n"), "value")


def p3_error(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the combined states' percentiles keep their bound against the exact ones."""
    exact = p3_percentiles(spark, sf).where("whole").drop("day", "whole").withColumnRenamed("value", "exact")
    both = p3_combined(spark, sf).join(exact, [*_GROUPS, "p", "n"])
    kept = F.abs(F.col("value") - F.col("exact")) <= F.abs("exact") / 1024
    return both.select(*_GROUPS, "p", "n", kept.alias("kept"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf, "documents"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each listed source that has tokens: whether its share is met up to two blocks, no block is used more often than its
    cap, one block at most is short, and its blocks hold as many tokens as its texts encoded one by one."""
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    report = mixing.share_report(documents, targets).where("available_tokens > 0")
    total, shares = F.sum("tokens").over(Window.partitionBy()), F.sum("target_share").over(Window.partitionBy())
    off = F.abs(F.col("tokens") - F.col("target_share") / shares * total)
    report = report.withColumn("share_kept", off <= 2 * mixing.BLOCK).withColumn("cap_kept", F.col("most_repeats") <= F.col("max_repeats"))
    alone = documents.select("doc_id", "source").join(tokenizer.encode(documents), "doc_id").groupBy("source").agg(F.sum(F.size("ids")).alias("alone"))
    return report.join(alone, "source").select("source", "share_kept", "cap_kept", (F.col("short_blocks") <= 1).alias("one_short"), (F.col("alone") == F.col("available_tokens")).alias("all_tokens"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents"))


def p9_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return residue.clean_corpus(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_combined, p3_error, p7_ids, p8_mixture, p8_shares, p8_invariants, p9_found, p9_kinds, p9_corpus)}

_DAYS = """
    SELECT r.table_name, r.field_name, r.value,
           strftime(epoch_ms(1000 * CASE WHEN r."time" IS NULL THEN r.__timestamp // 1000000000
                WHEN r."time" < 100000000000 THEN r."time"
                WHEN r."time" < 100000000000000 THEN r."time" // 1000
                WHEN r."time" < 100000000000000000 THEN r."time" // 1000000
                ELSE r."time" // 1000000000 END), '%Y-%m-%d') AS day
    FROM readings r WHERE r.value IS NOT NULL"""
_P = "(VALUES (0.01::DOUBLE), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) q(p)"
_PICK = "ceil(round(p * n, 9))"

ORACLE = {
    "p8_invariants": """SELECT source, true AS share_kept, true AS cap_kept, true AS one_short, true AS all_tokens FROM mix_targets
        WHERE source IN (SELECT source FROM documents WHERE text <> '')""",
    "p3_percentiles": f"""
        WITH v AS ({_DAYS}),
        levels AS (SELECT table_name, field_name, day, false AS whole, value FROM v UNION ALL SELECT table_name, field_name, NULL, true, value FROM v),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, field_name, whole, day ORDER BY value) AS k,
                          count(*) OVER (PARTITION BY table_name, field_name, whole, day) AS n FROM levels)
        SELECT table_name, field_name, day, whole, p, n, value FROM ranked JOIN {_P} ON k = greatest(1, {_PICK})""",
    # the value of a rank, cut to its sign, exponent and first ten bits of mantissa, towards zero
    "p3_combined": f"""
        WITH ranked AS (SELECT table_name, field_name, value, row_number() OVER (PARTITION BY table_name, field_name ORDER BY value) AS k, count(*) OVER (PARTITION BY table_name, field_name) AS n
            FROM readings WHERE value IS NOT NULL),
        picked AS (SELECT table_name, field_name, p, n, value FROM ranked JOIN {_P} ON k = greatest(1, {_PICK})),
        sized AS (SELECT *, CASE WHEN abs(value) / pow(2, floor(log2(nullif(abs(value), 0)))) >= 2 THEN floor(log2(abs(value))) + 1
            WHEN abs(value) / pow(2, floor(log2(nullif(abs(value), 0)))) < 1 THEN floor(log2(abs(value))) - 1 ELSE floor(log2(nullif(abs(value), 0))) END AS e FROM picked)
        SELECT table_name, field_name, p, n, coalesce(sign(value) * floor(abs(value) / pow(2, e - 10)) * pow(2, e - 10), 0.0) AS value FROM sized""",
    "p3_error": f"""
        WITH v AS (SELECT table_name, field_name, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY ALL)
        SELECT table_name, field_name, p, n, true AS kept FROM v CROSS JOIN {_P}""",
}
