"""Stage tables and the reply cache: misses by anti-join, hit rates, dead letters, resumable stages, a judge on misses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def request_key(namespace: Column, *payload: Column) -> Column:
    """SHA-256 of a request: its namespace and the JSON of its payload, whole."""
    return F.sha2(F.concat_ws("\n", namespace, F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})), 256)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests(key, ...) that the cache(key, ...) lacks, one for each key."""
    return requests.join(cache.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])


def hit_rates(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(namespace, hits, misses, hit_rate) of requests(namespace, key)."""
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    return requests.join(known, "key", "left").groupBy("namespace").agg(F.count_if("hit").alias("hits"), (F.count("*") - F.count_if("hit")).alias("misses"), F.round(F.count_if("hit") / F.count("*"), 6).alias("hit_rate"))


def dead_letters(errors: DataFrame) -> DataFrame:
    """One row for each error(namespace, kind, prompt, raw), with short previews and how often it was met."""
    key = F.sha2(F.concat_ws("\n", "namespace", "kind", F.coalesce("prompt", F.lit("")), F.coalesce("raw", F.lit(""))), 256)
    return errors.groupBy(key.alias("error_key"), "namespace", "kind").agg(F.min(F.substring("prompt", 1, 2000)).alias("prompt"), F.min(F.substring("raw", 1, 4000)).alias("raw"), F.count("*").alias("n"))


def judge_missing(requests: DataFrame, client: Callable[[], Callable[[str], str]], threads: int = 8, tries: int = 5, pause: float = 0.5) -> DataFrame:
    """Replies (key, reply, error) of a served model to requests(key, prompt), several at a time in each task.

    ``client`` makes a function from prompt to reply in the task. A call is tried again after a pause that doubles up to 30
    seconds; a last failure is an error row and stops nothing. Write the result to the cache table before using it, so that
    a task run twice asks twice at most.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()

        def one(prompt: str) -> tuple[str | None, str | None]:
            for n in range(tries):
                try:
                    return ask(prompt), None
                except Exception as e:
                    if n == tries - 1:
                        return None, f"{type(e).__name__}: {e}"
                    time.sleep(min(30.0, pause * 2**n))
            return None, None

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list(pool.map(one, b["prompt"]))
                yield pd.DataFrame({"key": b["key"], "reply": [r for r, _ in got], "error": [e for _, e in got]})

    return requests.select("key", "prompt").mapInPandas(step, "key string, reply string, error string")


def run_stage(spark: SparkSession, folder: str, name: str, config: str, items: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's table for items(key, ...): rows that its folder holds are read, the rest computed and appended.

    ``config`` separates runs whose settings differ. A second run over the same items computes nothing. ``compute`` gives a
    table with the column key. Items with a null key are left out.
    """
    path = f"{folder}/{name}/config={config}"
    wanted = items.where("key is not null")
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        done = None
    todo = wanted if done is None else wanted.join(done.select("key"), "key", "left_anti")
    if done is None or not todo.isEmpty():
        compute(todo.dropDuplicates(["key"])).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select("key").distinct(), "key", "left_semi")


def best_round(rounds: DataFrame) -> DataFrame:
    """The first of rounds(round, accuracy) with the greatest accuracy."""
    return rounds.agg(F.max_by("round", F.struct("accuracy", -F.col("round"))).alias("round"), F.max("accuracy").alias("accuracy"))
