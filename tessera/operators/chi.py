"""Pearson's chi-square test of every feature of a vector against a label.

pyspark.ml's test takes no feature of more than 10,000 distinct values. Here the
contingency table is a DataFrame: non-zero entries are counted per (feature,
value, label), zeros follow from the label's totals, and a feature's sum is added
up over its cells. The driver sees one row per label and per feature.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def survival(x: float, degrees: int) -> float:
    """1 - P(degrees / 2, x / 2): the chance of a chi-square value above x."""
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = 0
        while abs(term / total) > 1e-16:
            n += 1
            term *= x / (a + n)
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300         # Lentz's continued fraction of Q
    d = h = 1 / b
    n = 0
    while True:
        n += 1
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16 or n > 100_000:
            return 1 - (1 - scale * h)          # as the test does: 0 below rounding


def chi_square(df: DataFrame, features: str, label: str) -> DataFrame:
    """feature, degrees, statistic, p_value: one row per dimension. A feature (or
    label) of one value has no degrees, statistic 0 and p-value 1."""
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"))
    sizes = {r.label: (r.n, r.dim) for r in rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).collect()}       # one row per class
    if None in sizes:
        raise ValueError("chi_square: null labels")
    spark, n = df.sparkSession, sum(v[0] for v in sizes.values())
    schema = "feature int, degrees int, statistic double, p_value double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = max(v[1] for v in sizes.values())
    totals = F.broadcast(spark.createDataFrame([(k, v[0]) for k, v in sizes.items()], "label double, col long"))
    found = rows.select("label", F.posexplode("x").alias("feature", "value")).where(F.col("value") != 0) \
        .groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("o"))
    every = F.broadcast(spark.range(dim).select(F.col("id").cast("int").alias("feature"))).crossJoin(totals)
    zeros = every.join(found.groupBy("feature", "label").agg(F.sum("o").alias("seen")), ["feature", "label"], "left") \
        .select("feature", F.lit(0.0).alias("value"), "label", (F.col("col") - F.coalesce("seen", F.lit(0))).alias("o")) \
        .where("o > 0")
    cells = found.unionByName(zeros).join(totals, "label")
    pair = F.struct("o", "col")
    by_value = cells.groupBy("feature", "value").agg(F.sum("o").alias("row"), F.collect_list(pair).alias("cells"))   # a cell per class
    expected = lambda c: F.col("row") * c["col"] / F.lit(float(n))      # noqa: E731
    # a class without the value adds its expected number; all expected numbers of a row add up to the row
    part = F.aggregate("cells", F.col("row").cast("double"),
                       lambda acc, c: acc + (c["o"] - expected(c)) * (c["o"] - expected(c)) / expected(c) - expected(c))
    sums = by_value.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum(part).alias("s")).collect()  # dimensions
    out = []
    for r in sums:
        degrees = (r.values - 1) * (len(sizes) - 1)
        out.append((r.feature, degrees, max(r.s, 0.0), survival(r.s, degrees)) if degrees else (r.feature, 0, 0.0, 1.0))
    return spark.createDataFrame(out, schema)
