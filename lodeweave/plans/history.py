"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.history import believed, current_versions, ledger
from ..session import table


def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every belief ever held about the valid time of a version."""
    return ledger(table(spark, sf_dir, "legal_metadata_updates"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods in which each version was valid, as believed now."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return believed(p3_ledger(spark, sf_dir)).select("provision_id", "version", day("valid_from"), day("valid_to"))


def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions without end, and the successor of every other."""
    return current_versions(p3_ledger(spark, sf_dir))


def p3_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every version of a provision, whether its beliefs follow each other in recorded time, one at a time, the last still open."""
    w = W.partitionBy("provision_id", "version").orderBy("recorded_from")
    book = p3_ledger(spark, sf_dir).withColumn("_next", F.lead("recorded_from").over(w))
    good = (F.col("recorded_to").isNull() & F.col("_next").isNull()) | (F.col("recorded_to") <= F.col("_next"))
    return book.groupBy("provision_id", "version").agg(F.bool_and(good & (F.col("valid_from") < F.col("valid_to"))).alias("in_order"), F.sum(F.col("recorded_to").isNull().cast("int")).alias("open_rows"))


_FOUND = """
    WITH rows AS (
        SELECT provision_id, regexp_extract(version, '(\\d+(?:\\.\\d+)*)', 1) AS version, effective_date, recorded_at, update_id, action, document_id
        FROM legal_metadata_updates WHERE effective_date IS NOT NULL),
    starts AS (
        SELECT provision_id, version, arg_max(effective_date, (recorded_at, update_id)) AS valid_from, arg_max(document_id, (recorded_at, update_id)) AS document_id
        FROM rows WHERE action <> 'repeal' AND version <> '' GROUP BY ALL),
    edges AS (
        SELECT provision_id, valid_from AS day FROM starts
        UNION SELECT provision_id, effective_date FROM rows WHERE action = 'repeal'),
    periods AS (
        SELECT s.provision_id, s.version, s.document_id, s.valid_from,
            coalesce((SELECT min(day) FROM edges e WHERE e.provision_id = s.provision_id AND e.day > s.valid_from), DATE '9999-12-31') AS valid_to
        FROM starts s)
"""
QUERIES = {"p3_found": p3_found, "p3_ledger": p3_ledger, "p3_current": p3_current, "p3_checked": p3_checked}
SQL = {
    "p3_checked": _FOUND + "SELECT provision_id, version, TRUE AS in_order, 1::BIGINT AS open_rows FROM periods",
    "p3_found": _FOUND + "SELECT provision_id, version, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to FROM periods",
    "p3_current": _FOUND
    + """, nexts AS (SELECT provision_id, valid_from, max(version) AS version, arg_max(document_id, version) AS document_id FROM periods GROUP BY ALL)
    SELECT p.provision_id, p.version, p.valid_to = DATE '9999-12-31' AS is_current, n.document_id AS superseded_by, n.version AS successor_version
    FROM periods p LEFT JOIN nexts n ON n.provision_id = p.provision_id AND n.valid_from = p.valid_to""",
}
