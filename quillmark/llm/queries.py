"""Queries of the numbered problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import copies, defects, leaks, packing, similar, splits, truncation
from quillmark.session import table


def _scopes(spark: SparkSession, where: str) -> DataFrame:
    items = table(spark, where, "rubric_items").select(F.lit("item").alias("scope"), F.col("rubric_id").alias("id"), "text")
    bank = table(spark, where, "bank_entries").select(F.lit("bank").alias("scope"), F.col("bank_id").cast("long").alias("id"), "text")
    return items.unionByName(bank)


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    return copies.copies(_scopes(spark, where))


def p4_representatives(spark: SparkSession, where: str) -> DataFrame:
    return copies.representatives(_scopes(spark, where))


def _reworded(spark: SparkSession, where: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    items = table(spark, where, "rubric_items").select(F.lit("item").alias("scope"), F.col("rubric_id").alias("id"), "text", none.alias("aliases"))
    bank = table(spark, where, "bank_entries").select(F.lit("bank").alias("scope"), F.col("bank_id").cast("long").alias("id"), "text", "aliases")
    return items.unionByName(bank)


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return similar.look_alikes(_reworded(spark, where))


def p5_groups(spark: SparkSession, where: str) -> DataFrame:
    return similar.groups(_reworded(spark, where))


def _prompts(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "preferences").select(F.col("record_idx").alias("id"), "split", "source", F.col("prompt_text").alias("text"))


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    return splits.overlaps(_prompts(spark, where))


def p3_report(spark: SparkSession, where: str) -> DataFrame:
    return splits.report(_prompts(spark, where))


def _documents(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("column"), "lang", "text")


def p8_found(spark: SparkSession, where: str) -> DataFrame:
    return truncation.truncated(_documents(spark, where), learn=True).where("cut").select(F.col("id").alias("doc_id"))


def p8_source_rates(spark: SparkSession, where: str) -> DataFrame:
    return truncation.rates(_documents(spark, where), learn=True).withColumnRenamed("column", "source")


def _texts(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "documents").select(F.col("doc_id").alias("id"), "text")


def _items(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "eval_items").select(F.col("item_id").alias("id"), "text")


def p6_containers(spark: SparkSession, where: str) -> DataFrame:
    sized = packing.sizes(_texts(spark, where))
    return packing.containers(sized, table(spark, where, "context_windows")).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, where: str) -> DataFrame:
    sized = packing.sizes(_texts(spark, where))
    return packing.summary(packing.containers(sized, table(spark, where, "context_windows")))


def p7_found(spark: SparkSession, where: str) -> DataFrame:
    return leaks.leaks(_texts(spark, where), _items(spark, where))


def p7_items(spark: SparkSession, where: str) -> DataFrame:
    return leaks.report(_texts(spark, where), _items(spark, where))


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return defects.found(table(spark, where, "preferences"))


def p1_defects(spark: SparkSession, where: str) -> DataFrame:
    return defects.listed(table(spark, where, "preferences"))


def p1_defect_counts(spark: SparkSession, where: str) -> DataFrame:
    return defects.counts(table(spark, where, "preferences"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
