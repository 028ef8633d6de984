"""Join forms Spark has no single operator for, built from equi-joins and windows.

* ``broadcast_if_small``: a broadcast hint only behind a size check.
* ``asof_join``: the right row last before, first after or nearest per key within a tolerance, by
  (key, time bucket) windows plus a carry-in from the previous bucket: no
  pair is ever emitted and a hot key is spread over its buckets.
* ``interval_join``: pairs of one key within a time gap, bucketed so the
  equi-key includes the bucket (a hot key spreads over its buckets).
* ``range_join``: point-in-interval by bin keys plus a residual predicate.
* ``range_counts``: points per interval without any pair, from running counts at its ends.
* ``row_index``: zipWithIndex as range partitions plus per-partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the estimated size is under max_bytes; otherwise the
    frame is left alone and the planner shuffles (AQE may still broadcast at
    run time from measured sizes)."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def _epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str,
              tolerance_s: int, right_cols: list[str], prefix: str = "r_",
              direction: str = "backward") -> DataFrame:
    """For every left row, the latest right row with the same key and
    right_ts <= left_ts <= right_ts + tolerance. Left rows without one keep
    null right columns. ``forward`` takes the first right row at or after the
    left one instead (the same on mirrored time), ``nearest`` the closer of
    both, the earlier one at equal distance.

    The tolerance is the bucket width, so the answer lies in the left row's
    bucket or, failing that, is the last right row of the previous bucket.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction: {direction}")
    width = tolerance_s * 1_000_000
    rcols = [right_ts, *[c for c in right_cols if c != right_ts]]
    if direction == "nearest":
        both = left
        for p, d in (("_before_", "backward"), ("_after_", "forward")):
            both = asof_join(both, right, by, left_ts, right_ts, tolerance_s, right_cols, p, d)
        at = _epoch_us(F.col(left_ts))
        since, until = at - _epoch_us(F.col("_before_" + right_ts)), _epoch_us(F.col("_after_" + right_ts)) - at
        earlier = until.isNull() | (since <= until)
        return both.select(*left.columns, *[
            F.when(earlier, F.col("_before_" + c)).otherwise(F.col("_after_" + c)).alias(prefix + c) for c in rcols])
    sign = -1 if direction == "forward" else 1
    lt = _epoch_us(F.col(left_ts)) * sign
    rt = _epoch_us(F.col(right_ts)) * sign
    lft = left.withColumns({"_t": lt, "_side": F.lit(1)})
    rgt = right.select(by, *rcols).withColumns({"_t": rt, "_side": F.lit(0)})
    lft = lft.withColumn("_b", F.floor(F.col("_t") / width))
    rgt = rgt.withColumn("_b", F.floor(F.col("_t") / width))
    payload = F.struct(*[F.col(c).alias(prefix + c) for c in rcols], F.col("_t").alias("_rt"))
    # last right row of each (key, bucket), offered to the next bucket
    carry = rgt.groupBy(by, "_b").agg(F.max_by(payload, F.col("_t")).alias("_carry")) \
        .withColumn("_b", F.col("_b") + 1)
    lcols = left.columns
    both = lft.select(by, "_b", "_t", "_side", F.struct(*[F.col(c) for c in lcols]).alias("_l"),
                      F.lit(None).cast(rgt.select(payload.alias("p")).schema["p"].dataType).alias("_r")) \
        .unionByName(rgt.select(by, "_b", "_t", "_side", F.lit(None).cast(
            lft.select(F.struct(*[F.col(c) for c in lcols]).alias("l")).schema["l"].dataType).alias("_l"),
            payload.alias("_r")))
    # right rows sort before left rows at equal time: right_ts <= left_ts is inclusive
    w = Window.partitionBy(by, "_b").orderBy("_t", "_side") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    seen = seen.join(carry, [by, "_b"], "left")
    best = F.coalesce(F.col("_last"), F.col("_carry"))
    ok = best.isNotNull() & ((F.col("_t") - best["_rt"]) <= width)
    out = seen.select(*[F.col("_l")[c].alias(c) for c in lcols],
                      *[F.when(ok, best[prefix + c]).alias(prefix + c) for c in rcols])
    return out


def interval_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str,
                  gap_s: int, lsuffix: str = "_l", rsuffix: str = "_r") -> DataFrame:
    """Pairs (l, r) with equal key and left_ts <= right_ts <= left_ts + gap.

    The right side is offered to its own bucket and the one before it, so the
    equi-key (key, bucket) finds every pair and spreads a hot key by time.
    """
    width = gap_s * 1_000_000
    l2 = left.select(*[F.col(c).alias(c + lsuffix) for c in left.columns])
    l2 = l2.withColumns({"_k": F.col(by + lsuffix), "_lt": _epoch_us(F.col(left_ts + lsuffix))}) \
        .withColumn("_b", F.floor(F.col("_lt") / width))
    r2 = right.select(*[F.col(c).alias(c + rsuffix) for c in right.columns])
    r2 = r2.withColumns({"_k": F.col(by + rsuffix), "_rt": _epoch_us(F.col(right_ts + rsuffix))})
    own = F.floor(F.col("_rt") / width)
    r2 = r2.withColumn("_b", F.explode(F.array(own, own - 1)))
    j = l2.join(r2, ["_k", "_b"]).where((F.col("_rt") >= F.col("_lt")) & (F.col("_rt") - F.col("_lt") <= width))
    return j.drop("_k", "_b", "_lt", "_rt")


def range_join(points: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str,
               bin_width: float) -> DataFrame:
    """points x intervals with lo <= value <= hi, by bins of bin_width.

    Each interval is exploded to the bins it covers (wide intervals cover
    more bins; choose bin_width near the typical interval length).
    """
    pts = points.withColumn("_bin", F.floor(F.col(value) / bin_width).cast("long"))
    ivs = intervals.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col(lo) / bin_width).cast("long"), F.floor(F.col(hi) / bin_width).cast("long"))))
    return pts.join(ivs, "_bin").where((F.col(value) >= F.col(lo)) & (F.col(value) <= F.col(hi))).drop("_bin")


def range_counts(points: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, name: str = "n") -> DataFrame:
    """The intervals that hold a point, with the number of points in lo <= value <= hi.

    No pair is formed: points are counted per distinct value, values and interval
    ends are put in one order (range partitions, running sums in blocks), and an
    interval's number is the count up to its upper end less that before its lower one.
    """
    from tessera.operators import blocks
    ends = intervals.select(F.col(lo).cast("double").alias("_lo"), F.col(hi).cast("double").alias("_hi")) \
        .where(F.col("_lo") <= F.col("_hi")).distinct()
    # at equal values: lower ends, then points, then upper ends
    marks = points.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()) \
        .groupBy("_v").agg(F.count(F.lit(1)).alias("_w")).select("_v", F.lit(1).alias("_kind"), "_w")
    sides = ends.select(F.explode(F.array(F.struct(F.col("_lo").alias("_v"), F.lit(0).alias("_kind")),
                                          F.struct(F.col("_hi").alias("_v"), F.lit(2).alias("_kind")))).alias("_s"))
    marks = marks.unionByName(sides.select("_s.*").distinct().withColumn("_w", F.lit(0).cast("long")))
    upto = blocks.running(blocks.placed(marks, [], ["_v", "_kind"]), [], {"_upto": ("sum", F.col("_w"))})
    below = upto.where("_kind = 0").select(F.col("_v").alias("_lo"), F.col("_upto").alias("_below"))
    within = upto.where("_kind = 2").select(F.col("_v").alias("_hi"), F.col("_upto").alias("_within"))
    counts = ends.join(below, "_lo").join(within, "_hi") \
        .select("_lo", "_hi", (F.col("_within") - F.col("_below")).alias(name)).where(F.col(name) > 0)
    return intervals.withColumns({"_lo": F.col(lo).cast("double"), "_hi": F.col(hi).cast("double")}) \
        .join(counts, ["_lo", "_hi"]).drop("_lo", "_hi")


def row_index(df: DataFrame, order_col: str, num_partitions: int | None = None,
              name: str = "idx") -> DataFrame:
    """0-based consecutive index in the global order of order_col (unique).

    Range partitions are written once as a checkpoint (their boundaries come
    from sampling and must not change between the two passes), counted per
    partition, and each row gets its partition's offset plus its rank inside
    the partition. No single-partition window.
    """
    n = num_partitions or df.sparkSession.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id()) \
        .checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.fillna(0, ["_off"])
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_pid").orderBy(order_col)) - 1)
    return local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid") \
        .withColumn(name, F.col("_off") + F.col("_r")).drop("_pid", "_off", "_r")
