"""Ranking quality per query, as joins and sums: no list of a query's relevant
items is ever collected, only its predictions (at most k rows) are numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(predicted: DataFrame, relevant: DataFrame, query: str, item: str, rank: str,
                    k: int) -> DataFrame:
    """One row: queries, precision_at_k, recall_at_k, map_at_k and ndcg_at_k,
    each the mean over the queries of ``relevant`` (a query without
    predictions scores 0; predictions for other queries don't count).

    predicted: query, item, rank from 1; relevant: query, item, repeats allowed.
    Average precision divides by the number of relevant items.
    """
    truth = relevant.select(query, item).distinct()
    sizes = truth.groupBy(query).agg(F.count(F.lit(1)).alias("_size"))
    hits = predicted.where(F.col(rank) <= k).select(query, item, rank).join(truth, [query, item])
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    found = hits.withColumn("_nth", F.count(F.lit(1)).over(w)).groupBy(query).agg(
        F.count(F.lit(1)).alias("_hits"), F.sum(F.col("_nth") / F.col(rank)).alias("_ap"),
        F.sum(1 / F.log2(F.col(rank) + 1.0)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_size"), F.lit(k)).cast("int")), F.lit(0.0),
                        lambda acc, x: acc + 1 / F.log2(x + 1.0))
    per = sizes.join(found, query, "left").fillna(0, ["_hits", "_ap", "_dcg"])
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("_hits") / k).alias("precision_at_k"),
                   F.avg(F.col("_hits") / F.col("_size")).alias("recall_at_k"),
                   F.avg(F.col("_ap") / F.col("_size")).alias("map_at_k"),
                   F.avg(F.col("_dcg") / ideal).alias("ndcg_at_k"))
