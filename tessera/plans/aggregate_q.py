"""Aggregation: global, grouped, distinct, subtotals, pivots, statistics, sketches."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators.ranks import exact_percentiles
from tessera.plans.registry import register
from tessera.sources.tables import read


def t(spark, sf_dir, name):
    return read(spark, sf_dir, name)


def r(c, d=6):
    return F.round(F.col(c).cast("double"), d).alias(c)


@register("agg_global", """
SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS avg_qty,
       min(l_shipdate) AS first_ship, max(l_discount) AS max_disc FROM lineitem""")
def q_agg_global(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_discount").alias("max_disc"))


@register("agg_grouped", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS avg_disc,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1, 2""")
def q_agg_grouped(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"))


@register("agg_distinct", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders,
       sum(DISTINCT l_quantity) AS distinct_qty_sum FROM lineitem GROUP BY 1""")
def q_agg_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("n_parts"), F.countDistinct("l_orderkey").alias("n_orders"),
        F.sum_distinct("l_quantity").alias("distinct_qty_sum"))


@register("agg_rollup", """
SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid,
       CAST(grouping(l_linestatus) AS TINYINT) AS g_status, sum(l_quantity) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q_agg_rollup(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.grouping_id("l_returnflag", "l_linestatus").alias("gid"), F.grouping("l_linestatus").alias("g_status"),
        F.sum("l_quantity").alias("qty"))


@register("agg_cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def q_agg_cube(spark, sf_dir):
    return t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("agg_grouping_sets", """
SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer
GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def q_agg_grouping_sets(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return c.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("agg_pivot", """
SELECT o_orderpriority,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS P
FROM orders GROUP BY 1""")
def q_agg_pivot(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("o_orderstatus", F.coalesce("o_orderstatus", F.lit("null")))
    states = A.values_of(o, "o_orderstatus", ["F", "O", "P"])
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", states).agg(F.count(F.lit(1))).fillna(0, states)


@register("agg_stats", """
WITH mu AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(var_samp(l_quantity), 6) AS var_q, round(stddev_samp(l_quantity), 6) AS sd_q,
       round(avg(pow(l_quantity - m, 3)) / pow(avg(pow(l_quantity - m, 2)), 1.5), 6) AS skew_q,
       round(avg(pow(l_quantity - m, 4)) / pow(avg(pow(l_quantity - m, 2)), 2) - 3, 6) AS kurt_q,
       round(covar_samp(l_quantity, l_extendedprice), 4) AS cov_qp, round(corr(l_quantity, l_extendedprice), 6) AS corr_qp,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem l JOIN mu ON mu.l_returnflag = l.l_returnflag GROUP BY 1""")
def q_agg_stats(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.var_samp(q), 6).alias("var_q"), F.round(F.stddev_samp(q), 6).alias("sd_q"),
        F.round(F.skewness(q), 6).alias("skew_q"), F.round(F.kurtosis(q), 6).alias("kurt_q"),
        F.round(F.covar_samp(q, p), 4).alias("cov_qp"), F.round(F.corr(q, p), 6).alias("corr_qp"),
        F.round(F.regr_slope(p, q), 6).alias("slope"), F.round(F.regr_intercept(p, q), 4).alias("intercept"))


@register("agg_percentile", """
WITH cnt AS (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2),
md AS (SELECT l_returnflag, l_quantity AS mode_q FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY c DESC, l_quantity) AS rn FROM cnt) WHERE rn = 1)
SELECT l.l_returnflag, round(quantile_cont(l_discount, 0.25), 6) AS p25, round(median(l_extendedprice), 4) AS med_price,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, any_value(md.mode_q) AS mode_q
FROM lineitem l JOIN md ON md.l_returnflag = l.l_returnflag GROUP BY 1""")
def q_agg_percentile(spark, sf_dir):
    """Exact percentiles from counts per value in range partitions; the mode
    from counts too, the smallest of the most frequent."""
    li, flag = t(spark, sf_dir, "lineitem"), ["l_returnflag"]
    discount = exact_percentiles(li, flag, "l_discount", {"p25": 0.25})
    price = exact_percentiles(li, flag, "l_extendedprice", {"med_price": 0.5, "p90": 0.9})
    mode = li.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("l_returnflag").agg(F.max_by("l_quantity", F.struct("c", -F.col("l_quantity"))).alias("mode_q"))
    return discount.join(price, "l_returnflag").join(mode, "l_returnflag").select(
        "l_returnflag", F.round("p25", 6).alias("p25"), F.round("med_price", 4).alias("med_price"),
        F.round("p90", 4).alias("p90"), "mode_q")


@register("agg_percentile_approx")
def q_agg_percentile_approx(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75], 10000).alias("quartiles"))


@register("agg_approx_distinct")
def q_agg_approx_distinct(spark, sf_dir):
    """HyperLogLog++ estimate, and mergeable HLL sketches built per flag and unioned."""
    li = t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", 12).alias("sk"),
                                         F.approx_count_distinct("l_partkey", 0.02).alias("approx"),
                                         F.count_distinct("l_partkey").alias("exact"))
    union = per.agg(F.hll_sketch_estimate(F.hll_union_agg("sk")).alias("union_est"))
    return per.select("l_returnflag", "approx", "exact", F.hll_sketch_estimate("sk").alias("sketch_est")) \
        .unionByName(union.select(F.lit("ALL").alias("l_returnflag"), F.col("union_est").alias("sketch_est")),
                     allowMissingColumns=True)


@register("agg_sketch_count_min")
def q_agg_sketch_count_min(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_min_sketch(F.col("l_partkey"), F.lit(0.001), F.lit(0.99), F.lit(42)).alias("cms"))


@register("agg_collect", """
SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities,
       list_sort(list(DISTINCT o_orderstatus)) AS statuses,
       list_sort(list(o_orderkey) FILTER (WHERE rn <= 3)) AS top3_orders
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
GROUP BY 1""")
def q_agg_collect(spark, sf_dir):
    """Sets over bounded domains, and a list of at most three per key (the
    window group limit keeps only three rows per key before the shuffle)."""
    o = t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top3 = o.withColumn("rn", F.row_number().over(w)).where("rn <= 3") \
        .groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("top3_orders"))
    sets = o.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"),
                                      F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"))
    return sets.join(top3, "o_custkey")


@register("agg_arg", """
SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS priciest,
       arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS earliest, any_value(o_custkey * 0) AS any_zero
FROM orders GROUP BY 1""")
def q_agg_arg(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("priciest"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("earliest"),
        F.any_value(F.col("o_custkey") * 0).alias("any_zero"))


@register("agg_first_last")
def q_agg_first_last(spark, sf_dir):
    """first/last are order-dependent: rows only."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.first("o_orderkey", ignorenulls=True).alias("first_key"), F.last("o_orderkey").alias("last_key"))


@register("agg_bool_bit", """
SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_big, bool_or(o_orderstatus = 'P') AS any_pending,
       bit_and(o_orderkey) AS k_and, bit_or(o_orderkey) AS k_or, bit_xor(o_orderkey) AS k_xor
FROM orders GROUP BY 1""")
def q_agg_bool_bit(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_and(F.col("o_totalprice") > 50000).alias("all_big"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"),
        F.bit_and("o_orderkey").alias("k_and"), F.bit_or("o_orderkey").alias("k_or"),
        F.bit_xor("o_orderkey").alias("k_xor"))


@register("agg_bitmap")
def q_agg_bitmap(spark, sf_dir):
    """Distinct part keys per flag through bitmaps (positions within 32768-key buckets)."""
    li = t(spark, sf_dir, "lineitem")
    bm = li.groupBy("l_returnflag", F.bitmap_bucket_number("l_partkey").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("l_partkey")).alias("bm"))
    return bm.groupBy("l_returnflag").agg(F.sum(F.bitmap_count("bm")).alias("n_parts"))


@register("agg_histogram", """
SELECT CAST(CASE WHEN l_extendedprice < 0 THEN 0
                 WHEN l_extendedprice >= 100000 THEN 11
                 ELSE floor(l_extendedprice / 10000) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM lineitem GROUP BY 1""")
def q_agg_histogram(spark, sf_dir):
    """Fixed-width bins by width_bucket (0 and n+1 are the overflow bins)."""
    li = t(spark, sf_dir, "lineitem")
    return li.groupBy(F.width_bucket("l_extendedprice", F.lit(0.0), F.lit(100000.0), F.lit(10)).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("agg_histogram_numeric")
def q_agg_histogram_numeric(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.histogram_numeric("l_quantity", F.lit(10)).alias("h"))


@register("agg_describe", """
SELECT 'count' AS summary, CAST(count(l_quantity) AS DOUBLE) AS l_quantity, CAST(count(l_discount) AS DOUBLE) AS l_discount FROM lineitem
UNION ALL SELECT 'mean', round(avg(l_quantity), 6), round(avg(l_discount), 6) FROM lineitem
UNION ALL SELECT 'stddev', round(stddev_samp(l_quantity), 6), round(stddev_samp(l_discount), 6) FROM lineitem
UNION ALL SELECT 'min', min(l_quantity), min(l_discount) FROM lineitem
UNION ALL SELECT 'max', max(l_quantity), max(l_discount) FROM lineitem""")
def q_agg_describe(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").describe()
    return d.select("summary", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("l_quantity", "l_discount")])


@register("agg_summary_quartiles")
def q_agg_summary_quartiles(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").summary("25%", "50%", "75%")


@register("agg_crosstab_freq", """
SELECT l_returnflag AS l_returnflag_l_linestatus,
       count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O
FROM lineitem GROUP BY 1""")
def q_agg_crosstab_freq(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").crosstab("l_returnflag", "l_linestatus")


@register("agg_freq_items_corr")
def q_agg_freq_items_corr(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    fi = li.freqItems(["l_returnflag", "l_linestatus"], support=0.3)
    return fi.withColumns({"corr_qp": F.lit(li.corr("l_quantity", "l_extendedprice")),
                           "cov_qp": F.lit(li.cov("l_quantity", "l_extendedprice"))})


@register("agg_higher_order", """
SELECT vec_id, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda a, b: a + b), 6) AS sq_norm,
       round(sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda a, b: a + b)), 6) AS norm
FROM embeddings""")
def q_agg_higher_order(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    sq = F.aggregate("embedding", F.lit(0.0).cast("double"),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.reduce("embedding", F.lit(0.0).cast("double"),
                    lambda acc, x: acc + x.cast("double") * x.cast("double"), lambda acc: F.sqrt(acc))
    return e.select("vec_id", F.round(sq, 6).alias("sq_norm"), F.round(norm, 6).alias("norm"))


@register("agg_observe", """
SELECT count(*) AS rows, max(l_quantity) AS max_qty, count(*) FILTER (WHERE l_discount > 0.05) AS kept FROM lineitem""")
def q_agg_observe(spark, sf_dir):
    """Metrics gathered while the query runs, read after the action."""
    obs = Observation("lineitem_metrics")
    li = t(spark, sf_dir, "lineitem").observe(obs, F.count(F.lit(1)).alias("rows"),
                                              F.max("l_quantity").alias("max_qty"))
    n = li.where("l_discount > 0.05").count()
    metrics = obs.get
    return spark.createDataFrame([(int(metrics["rows"]), float(metrics["max_qty"]), n)],
                                 "rows long, max_qty double, kept long")


@register("agg_typed_udaf", """
SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 6) AS avg_price, count(*) AS n FROM orders GROUP BY 1""")
def q_agg_typed_udaf(spark, sf_dir):
    """A user average as a (sum, count) buffer merged by partial aggregation."""
    return A.user_average(t(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice") \
        .select("o_orderstatus", r("avg_price"), "n")


@register("agg_skewed", """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1""")
def q_agg_skewed(spark, sf_dir):
    """Three flags each hold about a third of all rows. The aggregates merge, so
    every map task sends one row per flag and no salt is needed."""
    li = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"),
                                          F.round(F.sum("l_extendedprice"), 2).alias("price"))


@register("log_query_stats", """
SELECT 'c' || (page_id % 7) AS client, CASE WHEN page_id % 5 <> 0 THEN 'u' || (page_id % 3) END AS account,
       regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS path, count(*) AS n,
       CAST(sum(CASE WHEN page_id % 11 <> 0 THEN length(html) END) AS BIGINT) AS bytes
FROM pages GROUP BY ALL""")
def q_log_query_stats(spark, sf_dir):
    """Request lines made of the pages: every fifth has no account, every
    eleventh a size that is no number; the requested host is the path."""
    p = t(spark, sf_dir, "pages")
    field = lambda key, value: F.concat(F.lit(f"{key}="), value)
    lines = p.select(F.concat_ws(
        " ", field("client", F.concat(F.lit("c"), (F.col("page_id") % 7).cast("string"))),
        F.when(F.col("page_id") % 5 != 0, field("account", F.concat(F.lit("u"), (F.col("page_id") % 3).cast("string")))),
        field("path", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)),
        field("size", F.when(F.col("page_id") % 11 != 0, F.length("html").cast("string")).otherwise("?"))).alias("line"))
    return A.log_stats(lines, "line")


@register("word_count", """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1""")
def q_word_count(spark, sf_dir):
    return A.word_count(t(spark, sf_dir, "documents"), "text")
