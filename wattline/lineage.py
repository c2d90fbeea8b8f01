"""Shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
#: Spark's setting that removes the shuffle files of a query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (as in a local test) a fresh local folder is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder, so lost executors do not lose the work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; ``by`` deals it into a folder for each value of that column.

    For a result that several later passes read: each pass then reads the columns it needs and none
    computes the result again, also when executors are lost in between. Shuffles behind the written table go
    with the end of the write.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    _MADE.append(path)
    # without rows there is no folder to read a schema from
    out = (spark.read.schema(df.schema) if by else spark.read).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` returned; nothing that reads them may follow."""
    for df in staged:
        if df._staged in _MADE:
            _MADE.remove(df._staged)
        _delete(df.sparkSession, df._staged)


@contextlib.contextmanager
def only_last_stays(spark: SparkSession) -> Iterator[None]:
    """Of the tables staged inside the block the last one stays; the others are deleted when it ends.

    For a caller that stages its result at the end of the block: nothing reads the tables behind it any more.
    """
    before = len(_MADE)
    yield
    *done, last = [None, *_MADE[before:]]
    del _MADE[before:]
    if last is not None:
        _MADE.append(last)
    for path in done[1:]:
        _delete(spark, path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Redistribute rows before a step that makes far more work than their size suggests.

    A stated number of partitions is kept as it is, where adaptive execution would merge small inputs into
    one task.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *cols)
