"""What every operator needs from the cluster: a shared folder for cut lineage, partition counts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many bytes as Spark estimates them; beyond it the join shuffles.
BROADCAST_LIMIT = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local one if the master is this one process (tests), else an error:

    on a cluster each executor would write to its own disk, and what it wrote would be lost to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    return _own_folder()


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="chronoweave-")
    return f"file://{folder}"


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Paths that results of this process still read, with the session that can delete them.
_kept: dict[str, SparkSession] = {}


def tidy() -> None:
    """Deletes what results were kept for, on whatever file system it lies. Runs when the driver's process ends or the caller is done with all results."""
    while _kept:
        path, spark = _kept.popitem()
        with contextlib.suppress(Exception):  # a session that is gone must not keep the process from ending
            remove_path(spark, path)


# registered after Spark's own handlers, and so run before them, while the JVM still answers
atexit.register(tidy)


class Workspace:
    """Written tables in the shared folder that cut lineage and survive the loss of executors.

    ``put`` writes a frame as Parquet and returns it as read back. ``drop`` removes one table; leaving the
    ``with`` block removes all but those put with ``keep=True``, which the returned result still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[str, bool]] = {}
        self._n = 0

    def put(self, df: DataFrame, keep: bool = False) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, keep)
        out._workspace_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_workspace_path", None)
            if path:
                remove_path(self.spark, path)
                self._paths = {k: v for k, v in self._paths.items() if v[0] != path}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc: object) -> None:
        for path, keep in self._paths.values():
            if not keep or exc[0] is not None:
                remove_path(self.spark, path)
            else:
                _kept[path] = self.spark


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan, the figure its own broadcast rule uses."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is under ``limit``, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Keys with more than half a fair partition's rows, with ``_pieces``: into how many each is to be cut.

    At most two times ``parts`` keys and three times ``parts`` pieces exist, whatever the data, so the result may be broadcast.
    Counts are combined map-side. An empty frame has no hot keys; a null key counts like any other.
    """
    parts = parts or shuffle_partitions(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.greatest(F.count(F.lit(1)) / parts, F.lit(2000.0)).alias("_fair"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_fair") / 2)
    return hot.select(*keys, F.least(F.ceil(F.col("_n") / F.col("_fair")), F.lit(parts)).cast("int").alias("_pieces"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
