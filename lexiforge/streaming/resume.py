"""Resumable work: a batch that leaves out finished ids, and the same as a stream whose state holds the ids seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_resumable(spark: SparkSession, todo: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, every: int | None = None) -> DataFrame:
    """Appends work's rows for what isn't in path yet; a run that broke off goes on behind its last whole append.

    every: about how many keys an append covers, so that a run that breaks off loses that many at most; None for one append.
    Keys that work gives no row for come again in the next run.
    """
    done = spark.read.parquet(path) if exists(spark, path) else None
    left = remaining(todo, done, key)
    parts = 1 if every is None else max(1, -(-left.select(key).distinct().count() // every))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    for k in range(parts):
        # path is read no more here: what is appended meanwhile has other keys.
        work(left.filter(part == k) if parts > 1 else left).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def unseen(source: DataFrame, key: str | list[str], event_time: str | None = None, keep: str | None = None) -> DataFrame:
    """A stream's rows whose key wasn't seen before; the keys seen lie in the query's state store, so no sink is read again.

    Without event_time every key is kept for good. With it a key is kept until the watermark, keep behind the latest event, has passed
    its first event by keep: repetitions within that time are left out, and the state holds about that time's keys and no more. Rows that are later than the
    watermark are dropped. A null key is a key like others.
    """
    keys = [key] if isinstance(key, str) else key
    if event_time is None:
        return source.dropDuplicates(keys)
    return source.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(keys)


def stream_resumable(source: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str, event_time: str | None = None, keep: str | None = None):
    """Work's rows for each key of a streaming source once, in path/batch=<number>, across restarts on one checkpoint.

    Keys are told by unseen. A batch that broke off is done again whole: it overwrites its own folder, so nothing stands twice. Take a path that no run_resumable writes to.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return unseen(source, key, event_time, keep).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
