"""Registered queries of the core, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_importable
from . import answers, documents, history, quality, retrieval, rules, store

MODULES = [retrieval, documents, rules, answers, quality, store, history]


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, sf_dir)

        return run

    return {k: shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
