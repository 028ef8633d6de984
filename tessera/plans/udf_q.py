"""User functions: row UDFs, Arrow and pandas UDFs, grouped and mapped pandas, UDTFs.

Python runs only where no built-in expression exists. Grouped pandas forms
need whole groups by definition; the queries group by supplier, whose line
count is fixed by the schema (lines per supplier do not grow with scale),
so each Python call gets a few hundred rows and per-call overhead amortises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.registry import register
from tessera.sources.tables import read


def t(spark, sf_dir, name):
    return read(spark, sf_dir, name)


def word_shape(s: str | None) -> str | None:
    """Letters to x/X, digits to d, anything else kept."""
    if s is None:
        return None
    return "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in s)


SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace(p_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g')"


@register("udf_scalar", f"SELECT p_partkey, {SHAPE_SQL} AS shape, {SHAPE_SQL} AS shape_sql FROM part")
def q_udf_scalar(spark, sf_dir):
    """A row UDF, also registered for SQL."""
    shape = F.udf(word_shape, T.StringType())
    spark.udf.register("word_shape", word_shape, T.StringType())
    p = t(spark, sf_dir, "part")
    p.createOrReplaceTempView("part_udf")
    via_sql = spark.sql("SELECT p_partkey, word_shape(p_name) AS shape_sql FROM part_udf")
    return p.select("p_partkey", shape("p_name").alias("shape")).join(via_sql, "p_partkey")


@register("udf_arrow", f"SELECT p_partkey, {SHAPE_SQL} AS shape FROM part")
def q_udf_arrow(spark, sf_dir):
    shape = F.udf(word_shape, T.StringType(), useArrow=True)
    return t(spark, sf_dir, "part").select("p_partkey", shape("p_name").alias("shape"))


@F.pandas_udf(T.DoubleType())
def unit_price(price: pd.Series, qty: pd.Series) -> pd.Series:
    return price / qty


@F.pandas_udf(T.DoubleType())
def net_iter(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for price, disc in batches:
        yield price * (1 - disc)


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def price_band(price: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"lo": (price // 1000) * 1000, "hi": (price // 1000) * 1000 + 1000})


@register("udf_pandas_scalar", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit,
       l_extendedprice * (1 - l_discount) AS net,
       floor(l_extendedprice / 1000) * 1000 AS band_lo, floor(l_extendedprice / 1000) * 1000 + 1000 AS band_hi
FROM lineitem""")
def q_udf_pandas_scalar(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     unit_price("l_extendedprice", "l_quantity").alias("unit"),
                     net_iter("l_extendedprice", "l_discount").alias("net"),
                     price_band("l_extendedprice").alias("band")) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "unit", "net",
                F.col("band.lo").alias("band_lo"), F.col("band.hi").alias("band_hi"))


@F.pandas_udf(T.DoubleType())
def mean_udaf(v: pd.Series) -> float:
    return float(v.mean())


@register("udaf_pandas", """
SELECT l_suppkey, round(avg(l_discount), 9) AS mean_disc, round(avg(l_quantity), 9) AS mean_qty_w
FROM lineitem GROUP BY 1""")
def q_udaf_pandas(spark, sf_dir):
    """A Series-to-scalar pandas UDF as a grouped aggregate and over a window."""
    li = t(spark, sf_dir, "lineitem")
    agg = li.groupBy("l_suppkey").agg(F.round(mean_udaf("l_discount"), 9).alias("mean_disc"))
    w = Window.partitionBy("l_suppkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    win = li.select("l_suppkey", F.round(mean_udaf("l_quantity").over(w), 9).alias("mean_qty_w")).distinct()
    return agg.join(win, "l_suppkey")


def demean(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(centered=pdf["l_quantity"] - pdf["l_quantity"].mean())[
        ["l_orderkey", "l_linenumber", "l_partkey", "centered"]]


@register("udf_grouped_map", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS centered
FROM lineitem""")
def q_udf_grouped_map(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = li.groupBy("l_suppkey").applyInPandas(
        demean, "l_orderkey long, l_linenumber int, l_partkey long, centered double")
    return out.withColumn("centered", F.round("centered", 6))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def with_tax(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(gross=(pdf["l_extendedprice"] * (1 + pdf["l_tax"])).round(4))[[*KEYS, "gross", "l_quantity"]]


def flag_big(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pc.greater(b.column(4), 40.0)],
                                         names=[*KEYS, "gross", "big"])


@register("udf_map", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + l_tax), 4) AS gross, l_quantity > 40 AS big
FROM lineitem""")
def q_udf_map(spark, sf_dir):
    """mapInPandas for the gross price, then mapInArrow for a flag, batch by batch."""
    li = t(spark, sf_dir, "lineitem").select(*KEYS, "l_extendedprice", "l_tax", "l_quantity")
    step1 = li.mapInPandas(with_tax, "l_orderkey long, l_linenumber int, l_partkey long, gross double, l_quantity double")
    return step1.mapInArrow(flag_big, "l_orderkey long, l_linenumber int, l_partkey long, gross double, big boolean")


@F.udtf(returnType=T.StructType([T.StructField("line_no", T.IntegerType()),
                                 T.StructField("n_words", T.IntegerType())]))
class LineStats:
    """One row per line of a whole text: its number and word count."""

    def eval(self, text: str):
        if text is None:
            return
        for k, line in enumerate(text.split("\n")):
            yield k + 1, len(line.split(" "))


@F.udtf(returnType=T.StructType([T.StructField("lang", T.StringType()),
                                 T.StructField("n_docs", T.IntegerType())]))
class CountByPartition:
    """Table argument partitioned by lang: counts rows, emits in terminate."""

    def __init__(self):
        self.lang = None
        self.n = 0

    def eval(self, row: Row):
        self.lang = row["lang"]
        self.n += 1

    def terminate(self):
        yield self.lang, self.n


@register("udtf_lateral", """
SELECT doc_id, CAST(k AS INTEGER) AS line_no, CAST(len(string_split(line, ' ')) AS INTEGER) AS n_words
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k
      FROM documents)""")
def q_udtf_lateral(spark, sf_dir):
    spark.udtf.register("line_stats", LineStats)
    t(spark, sf_dir, "documents").createOrReplaceTempView("documents_udtf")
    return spark.sql("SELECT d.doc_id, s.line_no, s.n_words FROM documents_udtf d, LATERAL line_stats(d.text) s")


@register("udtf_table_arg", "SELECT lang, CAST(count(*) AS INTEGER) AS n_docs FROM documents GROUP BY 1")
def q_udtf_table_arg(spark, sf_dir):
    spark.udtf.register("count_by_partition", CountByPartition)
    t(spark, sf_dir, "documents").createOrReplaceTempView("documents_udtf2")
    return spark.sql("SELECT * FROM count_by_partition(TABLE(SELECT lang FROM documents_udtf2) PARTITION BY lang)")
