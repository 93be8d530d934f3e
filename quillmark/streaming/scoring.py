"""Pairs scored as they arrive: each micro-batch goes through the batch operators and is appended to a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators import pairs as P


def score_batch(prefs: DataFrame, rubrics: DataFrame) -> DataFrame:
    pairs = P.oriented(prefs)
    return P.decide(pairs, P.margins(P.comparisons(pairs, rubrics)))


def score_stream(spark: SparkSession, source: str, schema: str, rubrics: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Score new preference files of a folder; a record_idx that the target holds isn't scored again.

    Exactly once by the checkpoint and the anti-join: a batch that is replayed after a failure adds nothing twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where("record_idx is not null").dropDuplicates(["record_idx"])
        ends = fresh.agg(F.min("record_idx").alias("low"), F.max("record_idx").alias("high")).first()
        if ends["low"] is None:
            return
        try:
            done = spark.read.parquet(target)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            # Only files whose range of ids meets the batch's are read.
            fresh = fresh.join(done.where(F.col("record_idx").between(ends["low"], ends["high"])).select("record_idx"), "record_idx", "left_anti")
        scored = score_batch(fresh, rubrics)
        scored.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
