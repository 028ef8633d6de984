"""Registered queries of the basket graph pipeline, with their DuckDB SQL.

Roles on the driver tables: basket = lineitem grouped by l_orderkey,
item = l_partkey, order date = orders.o_orderdate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import basket as B
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources.tables import read

FREQ_DAYS = 7
NORM_THRESHOLD = 0.002
NUM_PARTITIONS = 4


def tpch_baskets(spark, sf_dir):
    return B.from_tpch(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"))


def pipeline_parts(spark, sf_dir):
    orders, op = tpch_baskets(spark, sf_dir)
    windows = B.order_windows(orders, FREQ_DAYS)
    items = B.basket_items(op, windows)
    return orders, op, windows, items


def scored_edges(spark, sf_dir):
    _, _, windows, items = pipeline_parts(spark, sf_dir)
    return B.score_edges(B.counted_pairs(items, windows))


def edges(spark, sf_dir, use_npmi=True):
    return B.filter_edges(scored_edges(spark, sf_dir), NORM_THRESHOLD, use_npmi)


def partitioned(spark, sf_dir):
    return B.partition_edges(edges(spark, sf_dir), NUM_PARTITIONS)


def r6(c):
    return F.round(F.col(c).cast("double"), 6).alias(c)


# ----------------------------------------------------------------- SQL text
CTE = f"""
ow AS (SELECT o_orderkey AS order_id,
              CAST(floor(date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders),
                                   CAST(o_orderdate AS DATE)) / {FREQ_DAYS}.0) AS INTEGER) AS window_id
       FROM orders),
bi AS (SELECT DISTINCT ow.window_id, l.l_orderkey AS order_id, l.l_partkey AS product_id
       FROM lineitem l JOIN ow ON l.l_orderkey = ow.order_id),
pairs AS (SELECT a.window_id, a.order_id, a.product_id AS i, b.product_id AS j
          FROM bi a JOIN bi b ON a.window_id = b.window_id AND a.order_id = b.order_id
                              AND a.product_id < b.product_id),
cooc AS (SELECT window_id, i, j, count(*) AS cooc_count FROM pairs GROUP BY ALL),
items AS (SELECT window_id, product_id, count(*) AS item_count FROM bi GROUP BY ALL),
totals AS (SELECT window_id, count(DISTINCT order_id) AS total_orders FROM ow GROUP BY ALL),
marg AS (SELECT c.window_id, c.i, c.j, c.cooc_count, a.item_count AS count_i,
                b.item_count AS count_j, t.total_orders
         FROM cooc c JOIN items a ON a.window_id = c.window_id AND a.product_id = c.i
                     JOIN items b ON b.window_id = c.window_id AND b.product_id = c.j
                     JOIN totals t ON t.window_id = c.window_id),
sc1 AS (SELECT *, CAST(cooc_count / sqrt(CAST(greatest(count_i * count_j, 1) AS DOUBLE)) AS REAL) AS norm_score,
               CASE WHEN cooc_count > 0 AND count_i > 0 AND count_j > 0
                    THEN ln((cooc_count / total_orders) / ((count_i / total_orders) * (count_j / total_orders)))
               END AS pmi
        FROM marg),
scored AS (SELECT *, CAST(CASE WHEN pmi IS NULL THEN NULL
                               WHEN cooc_count / total_orders < 1 THEN pmi / (-ln(cooc_count / total_orders))
                               ELSE 0.0 END AS REAL) AS npmi
           FROM sc1),
edges AS (SELECT window_id, i, j, cooc_count, count_i, count_j, norm_score, npmi FROM scored
          WHERE npmi IS NOT NULL AND CAST(norm_score AS DOUBLE) >= {NORM_THRESHOLD} AND npmi > 0),
pe AS (SELECT *, CAST(i % {NUM_PARTITIONS} AS INTEGER) AS i_partition,
              CAST(j % {NUM_PARTITIONS} AS INTEGER) AS j_partition,
              CAST(least(i % {NUM_PARTITIONS}, j % {NUM_PARTITIONS}) AS INTEGER) AS edge_partition
       FROM edges),
ce AS (SELECT * FROM pe WHERE i_partition <> j_partition),
bnodes AS (SELECT DISTINCT node, partition FROM (
             SELECT i AS node, i_partition AS partition FROM ce UNION ALL
             SELECT j, j_partition FROM ce UNION ALL
             SELECT i, j_partition FROM ce UNION ALL
             SELECT j, i_partition FROM ce))"""


def with_cte(body: str) -> str:
    return "WITH " + CTE + "\n" + body


# ----------------------------------------------------------------- queries

@register("src_csv_tables", with_cte("""
SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id, CAST(o.o_orderdate AS DATE) AS order_date,
       p.p_type AS department
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey"""))
def q_src_csv_tables(spark, sf_dir):
    """Write the basket roles as header CSVs, read them back with fixed schemas."""
    base = scratch_path(spark, "basket-csv")
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.date_format("o_orderdate", "H:mm").alias("order_time"))
    op = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("add_to_cart_order"))
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("aisle"), F.col("p_type").alias("department"))
    for name, df in (("orders", o), ("order_products", op), ("products", p)):
        df.write.mode("overwrite").option("header", True).csv(f"{base}/{name}")
    orders, order_products, products = B.load_csv_tables(
        spark, f"{base}/orders", f"{base}/order_products", f"{base}/products", id_type="bigint")
    return order_products.join(orders, "order_id").join(products, "product_id") \
        .select("order_id", "product_id", "order_date", "department")


@register("week_window", with_cte("SELECT order_id, window_id FROM ow"))
def q_week_window(spark, sf_dir):
    orders, _ = tpch_baskets(spark, sf_dir)
    return B.order_windows(orders, FREQ_DAYS)


@register("basket_items", with_cte("""
SELECT window_id, order_id, list_sort(list(product_id)) AS products FROM bi GROUP BY ALL"""))
def q_basket_items(spark, sf_dir):
    return B.basket_sets(pipeline_parts(spark, sf_dir)[3])


@register("basket_pairs", with_cte("SELECT window_id, order_id, i, j FROM pairs"))
def q_basket_pairs(spark, sf_dir):
    return B.basket_pairs(pipeline_parts(spark, sf_dir)[3])


@register("cooc_count", with_cte("SELECT window_id, i, j, cooc_count FROM cooc"))
def q_cooc_count(spark, sf_dir):
    _, _, windows, items = pipeline_parts(spark, sf_dir)
    return B.cooccurrence(items, windows)[0]


@register("item_count", with_cte("SELECT window_id, product_id, item_count FROM items"))
def q_item_count(spark, sf_dir):
    _, _, windows, items = pipeline_parts(spark, sf_dir)
    return B.cooccurrence(items, windows)[1]


@register("window_totals", with_cte("SELECT window_id, total_orders FROM totals"))
def q_window_totals(spark, sf_dir):
    _, _, windows, items = pipeline_parts(spark, sf_dir)
    return B.cooccurrence(items, windows)[2]


@register("attach_marginals", with_cte(
    "SELECT window_id, i, j, cooc_count, count_i, count_j, total_orders FROM marg"))
def q_attach_marginals(spark, sf_dir):
    _, _, windows, items = pipeline_parts(spark, sf_dir)
    return B.counted_pairs(items, windows) \
        .select("window_id", "i", "j", "cooc_count", "count_i", "count_j", "total_orders")


@register("norm_score", with_cte(
    "SELECT window_id, i, j, round(CAST(norm_score AS DOUBLE), 6) AS norm_score FROM scored"))
def q_norm_score(spark, sf_dir):
    return scored_edges(spark, sf_dir).select("window_id", "i", "j", r6("norm_score"))


@register("pmi", with_cte("SELECT window_id, i, j, round(pmi, 6) AS pmi FROM scored"))
def q_pmi(spark, sf_dir):
    return scored_edges(spark, sf_dir).select("window_id", "i", "j", r6("pmi"))


@register("npmi", with_cte("SELECT window_id, i, j, round(CAST(npmi AS DOUBLE), 6) AS npmi FROM scored"))
def q_npmi(spark, sf_dir):
    return scored_edges(spark, sf_dir).select("window_id", "i", "j", r6("npmi"))


@register("edge_filter", with_cte("SELECT * FROM edges"))
def q_edge_filter(spark, sf_dir):
    return edges(spark, sf_dir)


@register("edge_filter_norm_only", with_cte(f"""
SELECT window_id, i, j, cooc_count, count_i, count_j, norm_score, CAST(NULL AS REAL) AS npmi
FROM scored WHERE CAST(norm_score AS DOUBLE) >= {NORM_THRESHOLD}"""))
def q_edge_filter_norm_only(spark, sf_dir):
    return edges(spark, sf_dir, use_npmi=False)


@register("node_partition", with_cte("SELECT * FROM pe"))
def q_node_partition(spark, sf_dir):
    return partitioned(spark, sf_dir)


@register("cross_edges", with_cte("SELECT * FROM ce"))
def q_cross_edges(spark, sf_dir):
    return B.cross_edges(partitioned(spark, sf_dir))


@register("boundary_nodes", with_cte("SELECT node, partition FROM bnodes"))
def q_boundary_nodes(spark, sf_dir):
    return B.boundary_nodes(partitioned(spark, sf_dir))


@register("partition_edges", with_cte(
    "SELECT edge_partition, count(*) AS n_edges, round(sum(CAST(norm_score AS DOUBLE)), 6) AS weight "
    "FROM pe GROUP BY ALL"))
def q_partition_edges(spark, sf_dir):
    """Edge count and weight of every partition's edge set."""
    return partitioned(spark, sf_dir).groupBy("edge_partition").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.round(F.sum(F.col("norm_score").cast("double")), 6).alias("weight"))


@register("sink_partitioned_edges", with_cte("SELECT * FROM pe"))
def q_sink_partitioned_edges(spark, sf_dir):
    """Partitioned Parquet + CSV sink, read back with partition discovery."""
    spark_pe = partitioned(spark, sf_dir)
    out = scratch_path(spark, "partitioned-edges")
    B.export_partitioned_edges(spark_pe, B.boundary_nodes, out)
    back = spark.read.parquet(f"{out}/edges")
    return back.select(*spark_pe.columns).withColumn("edge_partition", F.col("edge_partition").cast("int"))


@register("graph_density", with_cte("""
SELECT n_orders, n_lines, n_items, n_pairs,
       round(n_lines / n_orders, 6) AS items_per_order,
       round(n_items * (n_items - 1) / 2.0, 6) AS possible_edges,
       round(n_orders * ((n_lines / n_orders) * ((n_lines / n_orders) - 1) / 2) * 0.1
             / (n_items * (n_items - 1) / 2.0) * 100, 6) AS est_density_pct,
       round(n_pairs / (n_items * (n_items - 1) / 2.0) * 100, 6) AS density_pct
FROM (SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_orders,
             (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS n_lines,
             (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_items,
             (SELECT count(*) FROM (SELECT DISTINCT i, j FROM pairs)) AS n_pairs)"""))
def q_graph_density(spark, sf_dir):
    orders, op, _, items = pipeline_parts(spark, sf_dir)
    return B.graph_density(orders, op, B.basket_pairs(items))
