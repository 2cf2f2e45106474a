"""Streams of posts: seen-id dedup, polling runs, and the update log's upserts."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresmith.operators import incremental


def dedup_stream(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; event time must be a timestamp with zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """One polling run: what has arrived since the last, appended to a table."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def every(df: DataFrame, path: str, checkpoint: str, hours: float = 6):
    """Polling at an interval; the query restarts from its checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{round(hours * 3600)} seconds").start()


def keep_polling(run: Callable[[], None], *, hours: float = 6, after_error: float = 300, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[Exception]:
    """Run a polling run again and again: the next one ``hours`` after an end, ``after_error`` seconds after a failure.

    run: for instance ``run_available`` over a stream, whose checkpoint makes the run after a failure go on where the failed one stood.
    rounds: how many runs there are; without it they never end. Returns the failures of the last hundred runs, oldest first.
    """
    failures: deque[tuple[int, Exception]] = deque()
    n = 0
    while rounds is None or n < rounds:
        n += 1
        try:
            run()
            wait = hours * 3600
        except Exception as e:
            failures.append((n, e))
            wait = after_error
        while failures and failures[0][0] <= n - 100:
            failures.popleft()
        if n != rounds:
            sleep(wait)
    return [e for _, e in failures]


def capped(posts: DataFrame, most: int, *order: Column | str, source: str = "source") -> DataFrame:
    """The first posts of each source by ``order``: ``most`` divided by the number of sources, rounded down. Null is a source.

    Tasks cut their own rows to the cap before the shuffle, so a source with most of the posts sends few of them.
    """
    n = posts.select(source).distinct().count()
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return posts.withColumn("_nth", nth).where(F.col("_nth") <= most // max(n, 1)).drop("_nth")


#: Partitions of the update log: a batch rewrites those that its keys fall into.
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_into(spark: SparkSession, new: DataFrame, root: str, key: str = "service_key", buckets: int = BUCKETS) -> None:
    """Put rows of distinct keys into the log: they replace those of their keys, and only the partitions of their keys are written.

    A partition is named by its bucket of hashed keys and is replaced as a whole when the job commits. What is written
    depends on the log and the rows alone, and putting the same rows again changes nothing, so a run that died
    between two partitions is mended by the next try.
    """
    new = new.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    if _exists(spark, root):
        hit = [r[0] for r in new.select("bucket").distinct().collect()]  # one number a bucket at most
        old = spark.read.schema(new.schema).parquet(root).where(F.col("bucket").isin(hit))
        new = incremental.upsert(old, new, key)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)


def upsert_log(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str, key: str = "service_key") -> None:
    """Keep the newest row of each key: each micro-batch replaces the rows of its keys in the log's partitions that hold them."""

    def merge(batch: DataFrame, n: int) -> None:
        upsert_into(spark, incremental.latest(batch, key), root, key)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The log."""
    return spark.read.parquet(root).drop("bucket")
