"""Exact order statistics and tie-averaged ranks without buffering a group.

Everything starts from counts per distinct value (combined map-side). The
counts are range-partitioned by (group, value) and written once, because range
bounds are sampled and must not change between two reads. A partition's share
of a group is then one number, so the rows of a group before a value are the
group's earlier partitions plus a running sum inside the partition: a group
that holds most rows is spread over many tasks, and no task sorts more than
one range of distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.iterate import write_table


def _same(left: str, right: str, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def cumulative_counts(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by..., value, n, before, total: the rows of the group with this value,
    with a smaller one, and with any (nulls count nowhere, but a group of nulls
    only keeps its row with total 0). ``weight`` holds rows counted before."""
    n = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0))
    counts = df.groupBy(*by, value).agg(n.alias("n"))
    parts = df.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = write_table(counts.repartitionByRange(parts, *by, value)
                         .withColumn("_pid", F.spark_partition_id()), "value-counts")
    # a group lies in neighbouring partitions: at most groups + partitions rows
    shares = ranged.groupBy(*by, "_pid").agg(F.sum("n").alias("_share"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*by, "_pid", F.coalesce(F.sum("_share").over(earlier), F.lit(0)).alias("_earlier"),
                           F.sum("_share").over(group).alias("total"))
    inside = Window.partitionBy("_pid", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.alias("l").join(shares.alias("s"), _same("l", "s", ["_pid", *by])) \
        .select(*[F.col(f"l.{c}") for c in [*by, value, "n"]],
                (F.col("_earlier") + F.col("_inside")).alias("before"), "total")


def exact_percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """One row per group: the linearly interpolated percentiles ``points``
    (name -> fraction) of a numeric column. Nulls are ignored; a group of nulls
    gives nulls."""
    cum = cumulative_counts(df, by, value)
    v, before, after = F.col(value).cast("double"), F.col("before"), F.col("before") + F.col("n")
    picks, out = [], []
    for k, (name, p) in enumerate(points.items()):
        place = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((before <= rank) & (rank < after), v)).alias(f"_{side}{k}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_part{k}"))
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        out.append((lo + (hi - lo) * F.col(f"_part{k}")).alias(name))
    return cum.groupBy(*by).agg(*picks).select(*by, *out)


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Every row with its rank from 1 in the order of ``value``; equal values
    share the mean of their ranks. A null has no rank."""
    cum = cumulative_counts(df, [], value).where(F.col(value).isNotNull()) \
        .select(F.col(value).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(cum, F.col(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, r: the correlation of the tie-averaged ranks of two columns, over
    the rows where both are known (null where a column doesn't vary).

    Rows are first counted per pair of values, so repeated values cost one row
    each. The mean rank is known, so the sums are taken about it."""
    results = []
    for a, b in pairs:
        both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()) \
            .groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("w"))
        both = write_table(both, "value-pairs")
        off = F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
        ra = cumulative_counts(both, [], "a", "w").select("a", off.alias("da"))
        rb = cumulative_counts(both, [], "b", "w").select("b", off.alias("db"))
        w, da, db = F.col("w"), F.col("da"), F.col("db")
        sums = both.join(ra, "a").join(rb, "b").agg(
            F.sum(w * da * db).alias("ab"), F.sum(w * da * da).alias("aa"), F.sum(w * db * db).alias("bb"))
        spread = F.sqrt("aa") * F.sqrt("bb")
        results.append(sums.select(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                   F.when(spread > 0, F.col("ab") / spread).alias("r")))
    return reduce(DataFrame.unionByName, results)
