"""Session helpers: durable intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing in a local session, as in tests, a temporary folder is set; on a cluster that is an error,
    since a folder of one machine would not outlive it.
    """
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which outlives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most rows of a table that is sent whole to all tasks, some tens of bytes each.
BROADCAST_ROWS = 1 << 20


def sized(small: DataFrame) -> DataFrame:
    """The durable table ``small``, to be broadcast if it has at most BROADCAST_ROWS rows; counting it reads no more."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a few small files would leave most idle; larger inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
