"""Written tables in the folder that the cluster shares.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it again, so that a
lost executor never costs more than the stage in progress. The setting is read from the session;
only where it is unset (tests, a laptop) a local folder of our own is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Roots of the tables written by this process, oldest first.
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else, in local mode only, a folder made for this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loresmith-"))
    return _OWN[0]


class Stash:
    """Tables of one run; ``drop`` deletes those no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _ROOTS.append(self.root)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back; its path is ``df.stash_path``."""
        self._n += 1
        path = f"{self.root}/{self._n:02d}_{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.stash_path = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "stash_path", None):
                self.delete(t.stash_path)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_ROOTS)


def sweep(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables of stashes made since a mark, once what was made of them is written elsewhere."""
    for root in _ROOTS[since:]:
        if root not in keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _ROOTS[since:] = [r for r in _ROOTS[since:] if r in keep]


def partitions_for(df: DataFrame, size: int, most: int) -> int:
    """Partitions of about ``size`` bytes of what ``df`` reads, by the plan's statistics; the session's number at least, and ``most``.

    Rows that come from no file have no size (Spark then says 2^63 - 1): the session's number.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if read >= 1 << 60 else max(least, min(most, -(-read // size)))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove the shuffle files of finished jobs now.

    They go when the JVM collects the plans that refer to them, which an idle driver may put off
    until the disks are full.
    """
    import gc
    import time

    for _ in range(2):  # the cleaner works beside us: what it frees is gone a moment later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
