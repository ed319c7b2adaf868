"""Sinks: snapshots that change only where the data did, and appended histories."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweft.operators.history import prune_history
from inkweft.runtime import stored
from inkweft.sources.store import Store


def found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """A table, or None if its path isn't there; any other failure is one."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_changed(new: DataFrame, path: str, key: str = "name", text: str = "md") -> DataFrame:
    """Write the rows whose text is new or changed as one more batch; returns them.

    The table is read as its latest row for each key (``latest``), so unchanged documents are never rewritten.
    """
    spark = new.sparkSession
    before, todo = found(lambda: latest(spark, path, key)), new
    if before is not None:
        old = before.select(key, F.sha1(F.col(text).cast("binary")).alias("_was"))
        todo = new.join(old, key, "left").where(~F.sha1(F.col(text).cast("binary")).eqNullSafe(F.col("_was"))).drop("_was")
    stamp = time.time_ns()
    todo.withColumn("_batch", F.lit(stamp)).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("_batch") == stamp).drop("_batch")


def latest(spark: SparkSession, path: str, key: str = "name") -> DataFrame:
    df = spark.read.parquet(path)
    last = df.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return df.join(last, [key, "_batch"], "left_semi").drop("_batch")


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a table to a folder of its own and make it current by one atomic rename of a pointer file."""
    version = f"v{time.time_ns()}"
    df.write.parquet(f"{path}/{version}")
    Store(df.sparkSession, path).write("_current.json", json.dumps({"version": version}))
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The current snapshot, None if there is none or its pointer can't be read."""
    try:
        version = json.loads(Store(spark, path).read("_current.json") or "{}")["version"]
    except (ValueError, KeyError, TypeError):
        return None
    return found(lambda: spark.read.parquet(f"{path}/{version}"))


def append_history(diffs: DataFrame, path: str, keep: int | None = None) -> None:
    """Append entries; with ``keep`` only the newest ones of each document stay.

    The table is written anew only if some document has more than that.
    """
    diffs.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)
    if keep is None:
        return
    every = diffs.sparkSession.read.parquet(path)
    if every.groupBy("name").count().where(F.col("count") > keep).limit(1).count():
        stored(prune_history(every, keep)).write.mode("overwrite").parquet(path)


def write_assets(pictures: DataFrame, path: str) -> None:
    """Pictures ``name, file, content`` of converted documents, as one more batch of a binary table."""
    pictures.withColumn("_batch", F.lit(time.time_ns())).write.mode("append").parquet(path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """``name, file, content``: of each document the pictures of its latest batch."""
    every = found(lambda: spark.read.parquet(path))
    if every is None:
        return spark.createDataFrame([], "name string, file string, content binary")
    last = every.groupBy("name").agg(F.max("_batch").alias("_batch"))
    return every.join(last, ["name", "_batch"], "left_semi").drop("_batch")
