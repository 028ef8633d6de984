"""Helpers for driver-side loops of DataFrame rounds (graph jobs, Louvain).

A round's result is persisted (memory, then disk) so the next round reads it
once; every few rounds it is written as a reliable checkpoint into the
shared ``spark.checkpoint.dir`` so lineage stays short and a lost executor
costs at most the rounds since the last checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoint_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are removed when it ends, not when the
    driver's collector comes across them: a loop holds those of one round. For
    queries whose result is written, persisted or read by the driver."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, checkpoint: bool = False) -> DataFrame:
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)  # the checkpoint write reads the cache
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def persisted_count(df: DataFrame) -> tuple[DataFrame, int]:
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    return out, out.count()


def write_table(df: DataFrame, tag: str = "round") -> DataFrame:
    """Write a frame as Parquet below the shared checkpoint folder and read it
    back: one job, and the result's lineage starts at the written files."""
    from tessera.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


ROWS_PER_TASK = 2_000_000


def parts_for(spark, rows: int) -> int:
    """A number of partitions that grows with the rows, so that a task's share
    doesn't; the session's number of shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
