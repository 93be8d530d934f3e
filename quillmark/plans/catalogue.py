"""Catalogue of the core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import drift
from quillmark.plans import bank, delivered, pairs, recovery, scores  # noqa: F401
from quillmark.plans.registry import QUERIES, SQL
from quillmark.session import durable, table


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    records = table(spark, where, "raw_records")
    return drift.changes(durable(drift.field_facts(records)), records).select("file_name", "change", "field", "new_field")


def p2_versions(spark: SparkSession, where: str) -> DataFrame:
    return drift.versions(drift.field_facts(table(spark, where, "raw_records")))


def p2_one_table(spark: SparkSession, where: str) -> DataFrame:
    records = table(spark, where, "raw_records")
    facts = durable(drift.field_facts(records))
    return drift.one_table(records, drift.changes(facts, records), facts)


def queries() -> dict:
    return QUERIES | {f.__name__: f for f in (p2_found, p2_versions, p2_one_table)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
