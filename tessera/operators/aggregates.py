"""Aggregations that need more than one built-in call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AGGS = {"sum": F.sum, "count": None, "min": F.min, "max": F.max}


def user_average(df: DataFrame, key: str, value: str) -> DataFrame:
    """An average as a (sum, count) buffer: Spark merges the buffers map-side
    (partial aggregation) like a typed Aggregator's reduce/merge/finish."""
    return df.groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("n")) \
        .select(key, (F.col("_s") / F.col("n")).alias("avg_price"), "n")


def salted_agg(df: DataFrame, keys: list[str], aggs: dict, salts: int = 16) -> DataFrame:
    """Two-stage aggregation for keys that may hold a large share of rows.

    Stage one groups by (keys, salt) where the salt is a hash of the row, so
    one hot key is reduced by `salts` tasks; stage two merges at most `salts`
    partial rows per key. aggs: name -> (kind, column) with kind in
    sum/count/min/max (all decomposable).
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = []
    for name, (kind, col) in aggs.items():
        if kind == "count":
            first.append(F.count(F.lit(1)).alias(name))
        else:
            first.append(_AGGS[kind](col).alias(name))
    partial = df.groupBy(*keys, salt.alias("_salt")).agg(*first)
    second = []
    for name, (kind, _) in aggs.items():
        merge = F.sum if kind in ("sum", "count") else _AGGS[kind]
        second.append(merge(name).alias(name))
    return partial.groupBy(*keys).agg(*second)


def log_stats(lines: DataFrame, col: str, by: tuple[str, ...] = ("client", "account", "path"),
              size: str = "size") -> DataFrame:
    """Lines of space-separated key=value fields: count and summed size per
    client, account and path. A field that is missing or not a number is null."""
    fields = lines.select(F.str_to_map(F.col(col), F.lit(" "), F.lit("=")).alias("f"))
    parsed = fields.select(*[F.col("f")[k].alias(k) for k in by], F.expr(f"try_cast(f['{size}'] AS BIGINT)").alias("_size"))
    return parsed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))


def word_count(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    """Token counts of whole texts split on a separator (map-side combined)."""
    return df.select(F.explode(F.split(F.col(col), sep)).alias("word")) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def values_of(df: DataFrame, col: str, known: list[str], most: int = 10_000) -> list[str]:
    """The known values and all others of a column, for pivots; more than
    ``most`` values raise instead of being left out."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col}: more than {most} values to pivot")
    return [*known, *sorted(set(found) - set(known))]
