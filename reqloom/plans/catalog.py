"""All queries outside the corpus-preparation subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqloom.plans import export_queries, integrity, model_queries, text_queries

_MODULES: tuple = (integrity, text_queries, model_queries, export_queries)


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q_flat_table"](spark, sf_dir)
