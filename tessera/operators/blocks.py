"""Running and moving frames of ordered groups, cut into blocks with carries.

A window by key runs in one task per key. Here a group's rows get their place
in it (range partitions by key and order, written once; a partition's share of
a group is one number), and every ``size`` places make a block, the unit of the
windows: a group that holds most rows is spread over many tasks. What a frame
needs from outside its block is carried in: one row per block for running
frames, the last rows of the block before for moving ones.

``order`` must be unique within a group, as it decides the places. Null keys
are a group of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.iterate import write_table
from tessera.operators.ranks import _same

BLOCK_ROWS = 1 << 16


def placed(df: DataFrame, by: list[str], order: list[str], size: int = BLOCK_ROWS) -> DataFrame:
    """The rows with their place in the group from 0 (_pos) and its block (_blk)."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = write_table(df.repartitionByRange(parts, *by, *order).withColumn("_pid", F.spark_partition_id()), "placed")
    # a group lies in neighbouring partitions: at most groups + partitions rows
    shares = ranged.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_share"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*by, "_pid", F.coalesce(F.sum("_share").over(earlier), F.lit(0)).alias("_earlier"))
    local = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(*order)) - 1)
    pos = F.col("_earlier") + F.col("_in")
    return local.alias("l").join(shares.alias("s"), _same("l", "s", ["_pid", *by])) \
        .select(*[F.col(f"l.`{c}`") for c in df.columns], pos.alias("_pos"), F.floor(pos / size).alias("_blk"))


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: kind -> (inside the block, of a whole block, over the other blocks, both together, looks ahead)
RUNNING: dict[str, tuple[Callable, Callable, Callable, Callable, bool]] = {
    "sum": (F.sum, F.sum, F.sum, _add, False),
    "count": (F.count, F.count, F.sum, _add, False),
    "min": (F.min, F.min, F.min, F.least, False),
    "max": (F.max, F.max, F.max, F.greatest, False),
    "last": (lambda v: F.last(v, ignorenulls=True), lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("_pos"))),
             lambda v: F.last(v, ignorenulls=True), F.coalesce, False),
    "next": (lambda v: F.first(v, ignorenulls=True), lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("_pos"))),
             lambda v: F.first(v, ignorenulls=True), F.coalesce, True),
}


def running(rows: DataFrame, by: list[str], frames: dict[str, tuple[str, Column]]) -> DataFrame:
    """``placed`` rows with one column per frame: name -> (kind of RUNNING,
    value). sum, count, min, max and last (known value) cover the rows up to
    this one, next (known value) those from it on; nulls count nowhere."""
    block, chain = Window.partitionBy(*by, "_blk").orderBy("_pos"), Window.partitionBy(*by).orderBy("_blk")
    first, end = Window.unboundedPreceding, Window.unboundedFollowing
    ends = rows.groupBy(*by, "_blk").agg(*[RUNNING[kind][1](v).alias(f"_e_{n}") for n, (kind, v) in frames.items()])
    carry = {n: RUNNING[kind][2](F.col(f"_e_{n}")).over(chain.rowsBetween(1, end) if RUNNING[kind][4] else chain.rowsBetween(first, -1))
             for n, (kind, _) in frames.items()}
    carries = ends.select(*by, "_blk", *[c.alias(f"_c_{n}") for n, c in carry.items()])
    inside = rows.withColumns({
        f"_i_{n}": RUNNING[kind][0](v).over(block.rowsBetween(0, end) if RUNNING[kind][4] else block.rowsBetween(first, 0))
        for n, (kind, v) in frames.items()})
    return inside.alias("l").join(carries.alias("s"), _same("l", "s", ["_blk", *by])) \
        .select(*[F.col(f"l.`{c}`") for c in rows.columns],
                *[RUNNING[kind][3](F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, (kind, _) in frames.items()])


def moving(rows: DataFrame, by: list[str], back: int, frames: dict[str, Callable], size: int = BLOCK_ROWS) -> DataFrame:
    """``placed`` rows (with the same ``size``) with one column per frame over
    this row and the ``back`` rows before it: name -> function of the window.
    A block's last ``back`` rows also go to the next block."""
    if not 0 <= back < size:
        raise ValueError("a frame must fit into one block")
    both = F.when(F.col("_pos") % size >= size - back, F.array(F.col("_blk"), F.col("_blk") + 1)) \
        .otherwise(F.array("_blk"))
    held = rows.withColumn("_own", F.col("_blk")).withColumn("_blk", F.explode(both))
    w = Window.partitionBy(*by, "_blk").orderBy("_pos").rowsBetween(-back, 0)
    return held.withColumns({n: f(w) for n, f in frames.items()}).where(F.col("_blk") == F.col("_own")).drop("_own")


def with_totals(df: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Every row with aggregates of its whole group: combined before the
    shuffle, one row per group joined back (a hot key's rows are split by the
    skew join, as no task needs all of them)."""
    groups = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return df.alias("l").join(groups.alias("s"), _same("l", "s", by)) \
        .select(*[F.col(f"l.`{c}`") for c in df.columns], *[F.col(f"s.`{n}`") for n in totals])
