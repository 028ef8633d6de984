"""Window functions and the grouped time-series operators built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import timeseries as TS
from tessera.operators.aggregates import values_of
from tessera.operators.ranks import exact_percentiles
from tessera.plans.registry import register
from tessera.sources.tables import read


def t(spark, sf_dir, name):
    return read(spark, sf_dir, name)


def r(c, d=6):
    return F.round(F.col(c).cast("double"), d).alias(c)


_CUST_W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"


@register("win_rank", f"""
SELECT o_orderkey, o_custkey, row_number() OVER ({_CUST_W}) AS rn, rank() OVER ({_CUST_W}) AS rk,
       dense_rank() OVER ({_CUST_W}) AS drk, round(percent_rank() OVER ({_CUST_W}), 6) AS prk,
       ntile(4) OVER ({_CUST_W}) AS quart, round(cume_dist() OVER ({_CUST_W}), 6) AS cd
FROM orders""")
def q_win_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"),
        F.dense_rank().over(w).alias("drk"), F.round(F.percent_rank().over(w), 6).alias("prk"),
        F.ntile(4).over(w).alias("quart"), F.round(F.cume_dist().over(w), 6).alias("cd"))


_EV_W = "PARTITION BY user_id ORDER BY ts, event_id"


@register("win_offset", f"""
SELECT event_id, lag(value, 1) OVER ({_EV_W}) AS prev_value, lead(event_type, 2, 'none') OVER ({_EV_W}) AS next2_type,
       nth_value(value, 3) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third_value
FROM events""")
def q_win_offset(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t(spark, sf_dir, "events").select(
        "event_id", F.lag("value", 1).over(w).alias("prev_value"),
        F.lead("event_type", 2, "none").over(w).alias("next2_type"),
        F.nth_value("value", 3).over(full).alias("third_value"))


@register("win_rows_frame", f"""
SELECT event_id, round(sum(value) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running,
       round(avg(value) OVER ({_EV_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving3
FROM events""")
def q_win_rows_frame(spark, sf_dir):
    rows = B.placed(t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    rows = B.moving(rows, ["user_id"], 2, {"moving3": F.avg("value").over})
    out = B.running(rows, ["user_id"], {"running": ("sum", F.col("value"))})
    return out.select("event_id", r("running"), r("moving3"))


@register("win_range_frame", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                                        RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 6) AS last_hour,
       count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_last_hour
FROM events""")
def q_win_range_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))) \
        .rangeBetween(-3600 * 1_000_000, 0)
    return t(spark, sf_dir, "events").select(
        "event_id", F.round(F.sum("value").over(w), 6).alias("last_hour"), F.count(F.lit(1)).over(w).alias("n_last_hour"))


@register("win_aggregate", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS cust_total,
       count(*) OVER (PARTITION BY o_custkey) AS cust_orders,
       round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share_of_max
FROM orders""")
def q_win_aggregate(spark, sf_dir):
    out = B.with_totals(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], {
        "total": F.sum("o_totalprice"), "cust_orders": F.count(F.lit(1)), "top": F.max("o_totalprice")})
    return out.select("o_orderkey", r("total", 2).alias("cust_total"), "cust_orders",
                      F.round(F.col("o_totalprice") / F.col("top"), 6).alias("share_of_max"))


_LI_W = ("PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_extendedprice "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


@register("win_cumulative", f"""
SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER ({_LI_W}) AS cumsum,
       max(l_quantity) OVER ({_LI_W}) AS cummax, min(l_quantity) OVER ({_LI_W}) AS cummin,
       round(product(1 + l_discount) OVER ({_LI_W}), 6) AS cumprod, count(*) OVER ({_LI_W}) - 1 AS cumcount
FROM lineitem""")
def q_win_cumulative(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount",
                                                 "l_extendedprice") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(w).alias("cumsum"),
        F.max("l_quantity").over(w).alias("cummax"), F.min("l_quantity").over(w).alias("cummin"),
        F.round(F.product(1 + F.col("l_discount")).over(w), 6).alias("cumprod"),
        (F.count(F.lit(1)).over(w) - 1).alias("cumcount"))


_R5 = f"{_EV_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"


@register("win_rolling", f"""
SELECT event_id, count(value) OVER ({_R5}) AS roll_count,
       CASE WHEN count(value) OVER ({_R5}) >= 3 THEN round(sum(value) OVER ({_R5}), 6) END AS roll_sum,
       CASE WHEN count(value) OVER ({_R5}) >= 3 THEN round(avg(value) OVER ({_R5}), 6) END AS roll_mean,
       CASE WHEN count(value) OVER ({_R5}) >= 3 THEN min(value) OVER ({_R5}) END AS roll_min,
       CASE WHEN count(value) OVER ({_R5}) >= 3 THEN max(value) OVER ({_R5}) END AS roll_max,
       CASE WHEN count(value) OVER ({_R5}) >= 3 THEN round(stddev_samp(value) OVER ({_R5}), 6) END AS roll_std,
       CASE WHEN count(value) OVER ({_R5}) >= 3 THEN round(var_samp(value) OVER ({_R5}), 6) END AS roll_var
FROM events""")
def q_win_rolling(spark, sf_dir):
    out = TS.rolling(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5, 3)
    return out.select("event_id", "roll_count", r("roll_sum"), r("roll_mean"), "roll_min", "roll_max",
                      r("roll_std"), r("roll_var"))


_R9 = f"{_EV_W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW"
_EXP = f"{_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("win_expanding", f"""
SELECT event_id, count(value) OVER ({_EXP}) AS exp_count,
       CASE WHEN count(value) OVER ({_EXP}) >= 2 THEN round(sum(value) OVER ({_EXP}), 6) END AS exp_sum,
       CASE WHEN count(value) OVER ({_EXP}) >= 2 THEN round(avg(value) OVER ({_EXP}), 6) END AS exp_mean,
       CASE WHEN count(value) OVER ({_EXP}) >= 2 THEN max(value) OVER ({_EXP}) END AS exp_max,
       CASE WHEN count(value) OVER ({_EXP}) >= 2 THEN round(stddev_samp(value) OVER ({_EXP}), 6) END AS exp_std
FROM events""")
def q_win_expanding(spark, sf_dir):
    out = TS.expanding(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 2)
    return out.select("event_id", "exp_count", r("exp_sum"), r("exp_mean"), "exp_max", r("exp_std"))


def _gated(frame, n, least, expr):
    return f"CASE WHEN count(value) OVER ({frame}) >= {n} THEN {expr} END AS {least}"


@register("win_rolling_shape", f"""
SELECT event_id, {_gated(_R9, 5, "roll_q25", f"round(quantile_cont(value, 0.25) OVER ({_R9}), 6)")},
       {_gated(_R9, 5, "roll_median", f"round(quantile_cont(value, 0.5) OVER ({_R9}), 6)")},
       {_gated(_R9, 5, "roll_skew", f"round(skewness(value) OVER ({_R9}), 5)")},
       {_gated(_R9, 5, "roll_kurt", f"round(kurtosis(value) OVER ({_R9}), 5)")} FROM events""")
def q_win_rolling_shape(spark, sf_dir):
    """Quantiles, skewness and excess kurtosis (unbiased) of each user's last nine values."""
    out = TS.frame_shape(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 9, 5,
                         {"q25": 0.25, "median": 0.5})
    return out.select("event_id", r("roll_q25"), r("roll_median"), r("roll_skew", 5), r("roll_kurt", 5))


@register("win_expanding_shape", f"""
SELECT event_id, {_gated(_EXP, 4, "exp_min", f"min(value) OVER ({_EXP})")},
       {_gated(_EXP, 4, "exp_var", f"round(var_samp(value) OVER ({_EXP}), 5)")},
       {_gated(_EXP, 4, "exp_skew", f"round(skewness(value) OVER ({_EXP}), 5)")},
       {_gated(_EXP, 4, "exp_kurt", f"round(kurtosis(value) OVER ({_EXP}), 5)")} FROM events""")
def q_win_expanding_shape(spark, sf_dir):
    """Minimum, variance, skewness and excess kurtosis of each user's values so far."""
    out = TS.frame_shape(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", None, 4, prefix="exp_")
    return out.select("event_id", "exp_min", r("exp_var", 5), r("exp_skew", 5), r("exp_kurt", 5))


@register("win_ewm", """
WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, a.user_id, round(sum(b.value * pow(0.7, a.n - b.n)) / sum(pow(0.7, a.n - b.n)), 6) AS ewm
FROM r a JOIN r b ON b.user_id = a.user_id AND b.n <= a.n GROUP BY 1, 2""")
def q_win_ewm(spark, sf_dir):
    out = TS.ewm_mean(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", alpha=0.3)
    return out.select("event_id", "user_id", r("ewm"))


def _quotient(a, b):
    """a / b of doubles where b may be zero: infinite, or NaN for 0 / 0 (the plain
    division raises under ANSI)."""
    down = (a < 0) != b.cast("string").startswith("-")
    at_zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), F.lit(float("nan"))) \
        .when(down, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


@register("win_diff", f"""
SELECT event_id, lag(value, 1, 0.0) OVER ({_EV_W}) AS shifted, round(value - lag(value, 1) OVER ({_EV_W}), 6) AS diff,
       round(value / lag(value, 2) OVER ({_EV_W}) - 1, 6) AS pct_change2
FROM events""")
def q_win_diff(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return t(spark, sf_dir, "events").select(
        "event_id", F.lag(v, 1, 0.0).over(w).alias("shifted"), F.round(v - F.lag(v, 1).over(w), 6).alias("diff"),
        F.round(_quotient(v, F.lag(v, 2).over(w)) - 1, 6).alias("pct_change2"))


_GAP = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"


@register("win_fill", f"""
WITH e AS (SELECT event_id, user_id, ts, {_GAP} AS v,
                  row_number() OVER ({_EV_W}) AS pos FROM events),
f AS (SELECT *,
        last_value(v IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
        first_value(v IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill,
        last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
        first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
      FROM e)
SELECT event_id, ffill, bfill,
       round(CASE WHEN v IS NOT NULL THEN v WHEN pp IS NOT NULL AND np IS NOT NULL
                  THEN ffill + (bfill - ffill) * ((pos - pp) / (np - pp)) END, 6) AS interp
FROM f""")
def q_win_fill(spark, sf_dir):
    ev = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value").withColumn(
        "v", F.when(F.col("event_type") != "error", F.col("value")))
    out = TS.fill_and_interpolate(ev, ["user_id"], ["ts", "event_id"], "v")
    return out.select("event_id", "ffill", "bfill", r("interp"))


@register("ts_resample", """
WITH b AS (SELECT event_type, date_trunc('hour', ts) AS bucket, value FROM events),
agg AS (SELECT event_type, bucket, count(*) AS n, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean,
               min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std,
               round(var_samp(value), 6) AS var FROM b GROUP BY 1, 2),
spine AS (SELECT event_type, unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b),
                                                     INTERVAL 1 HOUR)) AS bucket
          FROM (SELECT DISTINCT event_type FROM events))
SELECT s.event_type, s.bucket, coalesce(a.n, 0) AS n, a.sum, a.mean, a.min, a.max, a.std, a.var
FROM spine s LEFT JOIN agg a ON a.event_type = s.event_type AND a.bucket = s.bucket""")
def q_ts_resample(spark, sf_dir):
    out = TS.resample(t(spark, sf_dir, "events"), "ts", "event_type", "value", "hour")
    return out.select("event_type", "bucket", "n", r("sum"), r("mean"), "min", "max", r("std"), r("var"))


@register("group_head_tail_nth", """
SELECT o_custkey, o_orderkey, rn_asc, rn_desc FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn_asc,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn_desc FROM orders)
WHERE rn_asc <= 2 OR rn_desc <= 2 OR rn_asc = 4""")
def q_group_head_tail_nth(spark, sf_dir):
    """head(2), tail(2) and nth(3) (0-based) of every customer's orders by date."""
    asc = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    desc = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(asc).alias("rn_asc"),
                    F.row_number().over(desc).alias("rn_desc")) \
        .where("rn_asc <= 2 OR rn_desc <= 2 OR rn_asc = 4")


@register("group_robust_stats", """
WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mu FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(avg(abs(l_quantity - mu)), 6) AS mad,
       round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem,
       round(quantile_cont(l_quantity, 0.75), 6) AS q75, count(DISTINCT l_quantity) AS nunique,
       round(product(1 + l_discount / 100), 6) AS prod
FROM lineitem l JOIN m ON m.l_returnflag = l.l_returnflag GROUP BY 1""")
def q_group_robust_stats(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    mu = li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mu"))
    q75 = exact_percentiles(li, ["l_returnflag"], "l_quantity", {"q": 0.75})
    stats = li.join(mu, "l_returnflag").groupBy("l_returnflag").agg(
        F.round(F.avg(F.abs(F.col("l_quantity") - F.col("mu"))), 6).alias("mad"),
        F.round(F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1))), 6).alias("sem"),
        F.count_distinct("l_quantity").alias("nunique"),
        F.round(F.product(1 + F.col("l_discount") / 100), 6).alias("prod"))
    return stats.join(q75, "l_returnflag").withColumn("q75", F.round("q", 6)).drop("q")


@register("table_pivot_dummies", """
SELECT c_custkey,
       CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS seg_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_BUILDING,
       CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_FURNITURE, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_HOUSEHOLD,
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_MACHINERY,
       coalesce(p.F, 0) AS F, coalesce(p.O, 0) AS O, coalesce(p.P, 0) AS P
FROM customer LEFT JOIN (
  SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F,
         round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O,
         round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1) p
  ON p.o_custkey = c_custkey""")
def q_table_pivot_dummies(spark, sf_dir):
    """pivot_table of order value by status per customer, plus one-hot segments."""
    c = t(spark, sf_dir, "customer")
    segments = values_of(c, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    dummies = c.select("c_custkey", *[(F.col("c_mktsegment") == s).cast("int").alias(f"seg_{s}") for s in segments])
    o = t(spark, sf_dir, "orders").withColumn("o_orderstatus", F.coalesce("o_orderstatus", F.lit("null")))
    states = values_of(o, "o_orderstatus", ["F", "O", "P"])
    piv = o.groupBy("o_custkey").pivot("o_orderstatus", states).agg(F.round(F.sum("o_totalprice"), 2))
    return dummies.join(piv, dummies.c_custkey == piv.o_custkey, "left").drop("o_custkey") \
        .fillna(0, states)


@register("time_of_day_filter", """
SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events
WHERE strftime(ts, '%H:%M:%S') >= '09:00:00' AND strftime(ts, '%H:%M:%S') < '17:30:00'""")
def q_time_of_day_filter(spark, sf_dir):
    clock = F.date_format("ts", "HH:mm:ss")
    return t(spark, sf_dir, "events").select("event_id", clock.alias("clock")) \
        .where((F.col("clock") >= "09:00:00") & (F.col("clock") < "17:30:00"))


@register("clip_mask", """
SELECT event_id, least(greatest(value, 10.0), 50.0) AS clipped,
       CASE WHEN event_type = 'view' THEN value ELSE -1.0 END AS where_view,
       CASE WHEN event_type = 'view' THEN -1.0 ELSE value END AS mask_view,
       coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0.0) AS combined
FROM events""")
def q_clip_mask(spark, sf_dir):
    v = F.col("value")
    view = F.col("event_type") == "view"
    return t(spark, sf_dir, "events").select(
        "event_id", F.least(F.greatest(v, F.lit(10.0)), F.lit(50.0)).alias("clipped"),
        F.when(view, v).otherwise(-1.0).alias("where_view"), F.when(view, -1.0).otherwise(v).alias("mask_view"),
        F.coalesce(F.when(F.col("event_type") != "error", v), F.lit(0.0)).alias("combined"))
