"""Tables between the steps of a job, kept where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of at most this many narrow rows (some tens of bytes each) may be broadcast.
BROADCAST_ROWS = 500_000
# Where rows hold texts, these take at most this much, too.
BROADCAST_BYTES = 64 << 20
_RUN = uuid.uuid4().hex
_JOB: ContextVar[str] = ContextVar("job", default=_RUN)
_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `wardline.work.dir`, or else by `spark.checkpoint.dir`.

    Where neither is set, a local master gets a temporary folder of this process; a cluster gets an error.
    """
    folder = spark.conf.get("wardline.work.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set wardline.work.dir or spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="wardline-"))
    return _own_folder[0]


def _job_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wardline-{_JOB.get()}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_job_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and outlives lost executors. `compression`: zstd for tables with much text."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """A scope for work tables: those written inside are deleted at its end, when its results are stored elsewhere."""
    before = _JOB.set(uuid.uuid4().hex)
    try:
        yield
    finally:
        discard_written(spark)
        _JOB.reset(before)


def discard_written(spark: SparkSession) -> None:
    """Delete the work tables of the current job (outside of any, those of this process)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_job_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a written table is counted to be small; else leave the join to Spark.

    The count reads parquet footers, not data. Above the limit the join shuffles, and adaptive execution
    splits skewed partitions.
    """
    return F.broadcast(df) if df.count() <= limit else df


def order_column(columns: list[str]) -> Column:
    """One sortable value for an order given by several columns."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


# A key that this many rows share is split off before a shuffle join.
HEAVY_ROWS = 200_000


def join_heavy_split(rows: DataFrame, keyed: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join `rows` (any number per key) to `keyed` (written, one row per key, `weight` = rows of that key).

    Keys of great weight go through a broadcast join, so no task receives all rows of one key. If more than
    BROADCAST_ROWS keys are heavy, the heaviest are broadcast: each of the others then has less than a
    BROADCAST_ROWS-th of all rows. `how` is inner or left_semi.
    """
    heavy = keyed.where(F.col(weight) > HEAVY_ROWS)
    heavy_keys = heavy.count()
    if heavy_keys == 0:
        return rows.join(keyed.drop(weight), key, how)
    light = keyed.where(F.col(weight) <= HEAVY_ROWS)
    if heavy_keys > BROADCAST_ROWS:
        heavy = written(heavy.orderBy(F.desc(weight), key).limit(BROADCAST_ROWS), "heavy-keys")
        light = keyed.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return (
        rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
        .join(light.drop(weight), key, how)
        .unionByName(rows.join(F.broadcast(heavy.drop(weight)), key, how))
    )
