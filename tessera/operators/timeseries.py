"""Window-based time-series operators: rolling/expanding stats, EWM, fills, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK_ROWS, placed, running


def rolling(df: DataFrame, by: list[str], order: list, value: str, window: int,
            min_periods: int | None = None, prefix: str = "roll_") -> DataFrame:
    """Row-count rolling stats; null until min_periods rows are in the frame."""
    mp = window if min_periods is None else min_periods
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    cnt = F.count(value).over(w)

    def gate(c: Column) -> Column:
        return F.when(cnt >= mp, c)
    v = F.col(value)
    return df.withColumns({
        f"{prefix}count": cnt,
        f"{prefix}sum": gate(F.sum(v).over(w)),
        f"{prefix}mean": gate(F.avg(v).over(w)),
        f"{prefix}min": gate(F.min(v).over(w)),
        f"{prefix}max": gate(F.max(v).over(w)),
        f"{prefix}std": gate(F.stddev_samp(v).over(w)),
        f"{prefix}var": gate(F.var_samp(v).over(w)),
    })


def expanding(df: DataFrame, by: list[str], order: list, value: str, min_periods: int = 1,
              prefix: str = "exp_") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cnt = F.count(value).over(w)
    v = F.col(value)
    return df.withColumns({
        f"{prefix}count": cnt,
        f"{prefix}sum": F.when(cnt >= min_periods, F.sum(v).over(w)),
        f"{prefix}mean": F.when(cnt >= min_periods, F.avg(v).over(w)),
        f"{prefix}max": F.when(cnt >= min_periods, F.max(v).over(w)),
        f"{prefix}std": F.when(cnt >= min_periods, F.stddev_samp(v).over(w)),
    })


def frame_shape(df: DataFrame, by: list[str], order: list, value: str, window: int | None,
                min_periods: int = 4, quantiles: dict[str, float] | None = None,
                prefix: str = "roll_") -> DataFrame:
    """Minimum, variance, skewness and excess kurtosis (both corrected for the
    sample size) of the last ``window`` rows, or of all rows so far when it is
    None, and interpolated quantiles of the former; null below min_periods
    known values, skewness below 3, kurtosis below 4.

    A quantile buffers its frame, so it needs a window: a growing frame would
    be sorted anew at every row.
    """
    if window is None and quantiles:
        raise ValueError("quantiles need a window")
    first = Window.unboundedPreceding if window is None else -(window - 1)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(first, 0)
    v, n = F.col(value), F.count(value).over(w)
    g1, g2 = F.skewness(v).over(w), F.kurtosis(v).over(w)
    shape = {
        "min": F.min(v).over(w),
        "var": F.var_samp(v).over(w),
        "skew": F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurt": F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
        **{name: F.percentile(v, p).over(w) for name, p in (quantiles or {}).items()},
    }
    return df.withColumns({prefix + k: F.when(n >= min_periods, c) for k, c in shape.items()})


def ewm_mean(df: DataFrame, by: list[str], order: list, value: str, alpha: float,
             out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean with pandas' adjust=True weights (1-alpha)^age
    over the known values, full history, in linear work.

    Known values are cut into blocks in which the weights span 300 binary
    places. Inside a block the weighted sum is a running sum of x / r^p, scaled
    back by r^p (r = 1-alpha, p the place in the block). A block starts from
    the sums at the ends of the eight blocks before it: what lies further back
    is scaled by less than 2^-2400, below any ratio of two doubles. The sum of
    the weights has a closed form.
    """
    r = 1.0 - alpha
    size = 1 if r <= 0 else max(1, int(300 * math.log(2) / -math.log(r)))
    back = 8
    run = lambda *keys: Window.partitionBy(*by, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda e: F.pow(F.lit(r), e)
    d = df.withColumn("_n", F.count(value).over(run()))
    d = d.withColumns({"_b": F.floor((F.col("_n") - 1) / size), "_p": F.pmod(F.col("_n") - 1, F.lit(size))})
    d = d.withColumn("_own", power(F.col("_p")) * F.sum(F.col(value).cast("double") / power(F.col("_p"))).over(run("_b")))
    ends = d.groupBy(*by, "_b").agg(F.max_by("_own", "_n").alias("_end"))
    chain = Window.partitionBy(*by).orderBy("_b")
    before = sum((F.coalesce(F.lag("_end", k + 1).over(chain), F.lit(0.0)) * power(F.lit(float(size * k)))
                  for k in range(back)), F.lit(0.0))
    ends = ends.select(*[F.col(c).alias(f"_{c}_end") for c in by], F.col("_b").alias("_block"), before.alias("_before"))
    same = F.col("_b") == F.col("_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_end"))
    weight = F.col("_n").cast("double") if r >= 1 else (1 - power(F.col("_n"))) / (1 - r)
    out_col = (F.col("_own") + power(F.col("_p") + 1) * F.col("_before")) / weight
    return d.join(ends, same, "left").select(*df.columns, F.when(F.col("_n") > 0, out_col).alias(out))


def fill_and_interpolate(df: DataFrame, by: list[str], order: list[str], value: str,
                         size: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill, backward fill and linear interpolation by row position,
    in blocks of ``size`` rows, so that one long group is spread."""
    known_pos = F.when(F.col(value).isNotNull(), F.col("_pos"))
    df = running(placed(df, by, order, size), by, {
        "ffill": ("last", F.col(value)), "bfill": ("next", F.col(value)),
        "_pp": ("last", known_pos), "_np": ("next", known_pos)})
    frac = (F.col("_pos") - F.col("_pp")) / (F.col("_np") - F.col("_pp"))
    interp = F.when(F.col(value).isNotNull(), F.col(value)) \
        .when(F.col("_pp").isNotNull() & F.col("_np").isNotNull(),
              F.col("ffill") + (F.col("bfill") - F.col("ffill")) * frac)
    return df.withColumn("interp", interp).drop("_pos", "_blk", "_pp", "_np")


def resample(df: DataFrame, ts: str, by: str, value: str, unit: str = "hour") -> DataFrame:
    """Per key, buckets of `unit` from the first to the last bucket of the whole
    table with sum/mean/min/max/std/var; empty buckets are kept (count 0).

    The bucket spine is a per-key sequence between two scalar subqueries
    (first and last bucket), so no cross join is planned.
    """
    b = F.date_trunc(unit, F.col(ts))
    agg = df.groupBy(by, b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("var"))
    lo = df.select(F.min(b)).scalar()
    hi = df.select(F.max(b)).scalar()
    spine = df.select(by).distinct().select(
        by, F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL 1 {unit.upper()}"))).alias("bucket"))
    return spine.join(agg, [by, "bucket"], "left").fillna(0, ["n"])
