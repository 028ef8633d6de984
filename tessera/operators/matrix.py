"""Tall matrices: rows are a table's vectors, columns the vector's dimensions.

The Gram matrix is a sum over rows, so each task adds up its own rows and
sends one dim x dim matrix; nothing depends on the number of rows after that.
Singular values and right vectors come from its eigenvectors in the driver,
whose size depends on the dimensions alone; left vectors stay distributed.
Null vectors are left out; vectors of different lengths raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gram(df: DataFrame, vector: str) -> DataFrame:
    """i, j, g: entries of A^T A, i and j from 0."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int64), "row": list(total)})

    rows = df.select(F.col(vector).alias("v")).where(F.col("v").isNotNull()) \
        .mapInPandas(partial, "i long, row array<double>")
    return rows.select("i", F.posexplode("row").alias("j", "g")) \
        .groupBy("i", F.col("j").cast("long").alias("j")).agg(F.sum("g").alias("g"))


def svd(df: DataFrame, key: str, vector: str, k: int | None = None) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(s, V, U): the k largest singular values, falling (all that are not
    zero to rounding when k is None), right vectors as columns of V, and per
    row ``key`` its left vector ``u``."""
    entries = gram(df, vector).collect()          # dim * dim numbers
    dim = 1 + max((r.i for r in entries), default=-1)
    g = np.zeros((dim, dim))
    for r in entries:
        g[r.i, r.j] = r.g
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > (values[0] if dim else 0.0) * dim * np.finfo(float).eps).sum())
    keep = rank if k is None else min(k, rank)
    s, v = np.sqrt(values[:keep]), vectors[:, :keep]

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["_v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({key: batch[key], "u": list(x @ v / s)})

    kind = df.schema[key].dataType.simpleString()
    u = df.select(key, F.col(vector).alias("_v")).where(F.col("_v").isNotNull()) \
        .mapInPandas(left, f"`{key}` {kind}, u array<double>")
    return s, v, u


def column_similarities(df: DataFrame, vector: str) -> DataFrame:
    """i < j, sim: cosine of two columns over all rows (exact; null where a
    column is zero)."""
    g = gram(df, vector)
    norms = g.where("i = j").select(F.col("i").alias("k"), F.sqrt("g").alias("norm"))   # one row per dimension
    a, b = F.broadcast(norms.alias("a")), F.broadcast(norms.alias("b"))
    length = F.col("a.norm") * F.col("b.norm")
    return g.where("i < j").join(a, F.col("i") == F.col("a.k")).join(b, F.col("j") == F.col("b.k")) \
        .select("i", "j", F.when(length > 0, F.col("g") / length).alias("sim"))


BLOCK_LEFT, BLOCK_RIGHT = 1 << 16, 1 << 18      # rows of a cell's two sides, about
TILE_LEFT, TILE_RIGHT = 512, 8192


def _best_of_cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lid = left["id"].to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({"left_id": lid[:0], "right_id": lid[:0], "score": np.empty(0, np.float32)})
        u, v = (np.stack(x["features"].to_numpy()).astype(np.float32) for x in (left, right))
        size = np.linalg.norm(v.astype(np.float64), axis=1)
        order = np.argsort(-size)
        v, size, rid = v[order], size[order], right["id"].to_numpy()[order]
        out = []
        for a in range(0, len(u), TILE_LEFT):
            part = u[a:a + TILE_LEFT]
            # the best so far: rows, ids and scores, and the k-th best score of a row
            row, item, score = np.empty(0, np.int64), rid[:0], np.empty(0, np.float32)
            least = np.full(len(part), -np.inf, np.float32)
            own = np.linalg.norm(part.astype(np.float64), axis=1) * (1 + 1e-5)
            for b in range(0, len(v), TILE_RIGHT):
                if (own * size[b] < least).all():           # longest first: no later one can be better
                    break
                s = part @ v[b:b + TILE_RIGHT].T
                if not b and s.shape[1] > k:
                    first = s[:, :1024]
                    least = np.partition(first, max(0, first.shape[1] - k), axis=1)[:, max(0, first.shape[1] - k)]
                x, y = np.nonzero(s >= least[:, None])
                row, item, score = np.concatenate([row, x]), np.concatenate([item, rid[b + y]]), np.concatenate([score, s[x, y]])
                by = np.lexsort((-item, -score, row))
                row, item, score = row[by], item[by], score[by]
                start = np.searchsorted(row, np.arange(len(part)))
                nth = np.arange(len(row)) - start[row]
                full = nth == k - 1
                least[row[full]] = score[full]
                row, item, score = row[nth < k], item[nth < k], score[nth < k]
            out.append(pd.DataFrame({"left_id": lid[a + row], "right_id": item, "score": score}))
        return pd.concat(out)
    return run


def top_products(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(left_id, right_id, score): the k right rows (id, features) of largest inner
    product for every left row, ties to the larger id. Exact.

    Both sides are cut into blocks of bounded size by a hash of their ids, a task
    holds one block of each and returns k rows of each left row, merged after.
    The products are as many as the pairs; within a task the right rows come
    longest first, and those too short to be among the best are left out."""
    n_left, n_right = (max(1, math.ceil(x.count() / size)) for x, size in ((left, BLOCK_LEFT), (right, BLOCK_RIGHT)))

    def placed(rows, own, other, n_own, n_other):
        return rows.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
    kind = left.schema["id"].dataType.simpleString()
    a = placed(left, "x", "y", n_left, n_right).repartition(n_left * n_right, "x", "y").groupBy("x", "y")
    b = placed(right, "y", "x", n_right, n_left).repartition(n_left * n_right, "x", "y").groupBy("x", "y")
    best = a.cogroup(b).applyInPandas(_best_of_cell(k), f"left_id {kind}, right_id {kind}, score float")
    by = Window.partitionBy("left_id").orderBy(F.desc("score"), F.desc("right_id"))
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
