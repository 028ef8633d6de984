"""Exact top-k inner-product search by columnar branch-and-bound.

Queries are dealt into blocks whose vectors take about QUERY_BYTES; a block goes
to every task, and the candidates are read where they lie: no vector is
shuffled. A task turns them chunk by chunk into a vertical layout, one row per
dimension. A query adds up its products one block of dimensions at a time.
After each, the mass that is left bounds what a candidate can still gain
(Cauchy-Schwarz on the remaining components), candidates that can't reach the
query's k-th best score any more are dropped, and the survivors are compacted.

The k-th best is a bound that all tasks share: a pilot of about PILOT candidates
is searched first, and each query's k-th best score there goes out with the
block. It rises inside a task with each chunk. A task hands on its k best of
each query that reach the bound, and a window over them gives the final k; the
pilot's rows are read again in the pass over all rows.

Components become floor(1024 * x). Sums are exact: in doubles while every sum
stays below 2^53, else in Python integers without bounds, and a score outside
the range of a long stops at its end.

Edge cases: vectors that are null or hold a null or non-finite component, and
rows with a null id, take no part; shorter vectors count as padded with zeros;
a repeated query row (same id and vector) is answered once; of the candidates
equal to the query in id and vector one is the query's own row and is left
out, further ones count; ties go to the smaller id; an empty table gives an
empty result; only the named columns are read, so others can't clash; texts
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_table
from tessera.session import scratch_path

SCALE = 1024
QUERY_BYTES = 16 << 20   # of query vectors that go to every task at once
QUERY_GROUP, CHUNK = 256, 8192
PILOT = 8192             # candidates that set the shared bounds
DIMS = 8                 # dimensions added between two prunings
EXACT = float(1 << 53)
LONG_MAX = (1 << 63) - 1

FOUND = "query int, vec_id long, rid long, score long"


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def quantized(vector: str) -> Column:
    """Whole numbers held in doubles (exact to 2^53; larger ones are whole anyway)."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * float(SCALE)
        # floor() gives a long: beyond 2^53 a double is whole as it is
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, whole)


def _columns(vectors: pa.Array, width: int) -> np.ndarray:
    """(width, rows): one row of the matrix per dimension."""
    out = np.zeros((width, len(vectors)))
    at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    for i in range(len(vectors)):
        out[:at[i + 1] - at[i], i] = values[at[i]:at[i + 1]]
    return out


def remaining(m: np.ndarray, dims: int) -> np.ndarray:
    """Row b: the length of what is left of each column from dimension b * dims on."""
    return np.array([np.sqrt((m[a:] ** 2).sum(axis=0)) * (1 + 1e-12) for a in range(0, len(m), dims)] + [np.zeros(m.shape[1])])


def search_columns(q: np.ndarray, rest_q: np.ndarray, c: np.ndarray, rest_c: np.ndarray, k: int, floor: np.ndarray,
                   dims: int = DIMS) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the (candidate indices, scores) that reach its ``floor``
    and the k-th best score here, and the number of products added up.
    q: (width, queries), c: (width, candidates). Exact for sums below 2^53."""
    width, n = c.shape
    first = q[:dims].T @ c[:dims]                   # the first block for all queries at once
    spent, out = first.size * min(dims, width), []
    for j in range(q.shape[1]):
        score, kth, alive = first[j], floor[j], np.arange(n)
        for b, lo in enumerate(range(dims, width, dims), 1):
            bound = score + rest_q[b, j] * rest_c[b, alive]
            stay = bound >= kth
            if b == 1 and stay.sum() > 8 * k:       # those of the best bounds in full
                lead = np.argpartition(-bound, 4 * k)[:4 * k]
                full = q[:, j] @ c[:, lead]
                spent += len(lead) * width
                kth = max(kth, -np.partition(-full, k - 1)[k - 1])
                stay = bound >= kth
            alive, score = alive[stay], score[stay]
            if not len(alive):
                break
            score = score + q[lo:lo + dims, j] @ c[lo:lo + dims, alive]
            spent += len(alive) * len(q[lo:lo + dims])
        stay = score >= kth
        if stay.sum() > k:
            stay &= score >= -np.partition(-score, k - 1)[k - 1]
        out.append((alive[stay], score[stay]))
    return out, spent


def _exact(q: list, c: list) -> list:
    """Every score in Python integers, for sums that a double can't hold."""
    whole = [[int(x) for x in v] for v in c]
    return [np.array([max(-LONG_MAX - 1, min(LONG_MAX, sum(int(a) * b for a, b in zip(x, y)))) for y in whole], np.int64)
            for x in q]


def _scan(block: dict, k: int, wide: bool):
    """The best k candidates of this task for each query of the block that reach
    its bound. block: the queries' rid, v (width, queries), rest and floor."""
    q, own, width = block["v"], block["rid"], len(block["v"])

    def keep(held: tuple, ids: np.ndarray, rids: np.ndarray, score: np.ndarray) -> tuple:
        ids, rids, score = (np.concatenate(x) for x in zip(held, (ids, rids, score)))
        best = np.lexsort((rids, ids, -score))[:k]
        return ids[best], rids[best], score[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = block["floor"].copy()
        none = np.empty(0, np.int64)
        best = [(none, none, none)] * q.shape[1]
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                part = b.slice(start, CHUNK)
                ids, rids = (part.column(n).to_numpy() for n in ("vec_id", "rid"))
                c = _columns(pa.concat_arrays([part.column("v")]), width)
                rest = None if wide else remaining(c, DIMS)
                for g in range(0, q.shape[1], QUERY_GROUP):
                    cut = slice(g, g + QUERY_GROUP)
                    if wide:
                        found = [(np.arange(len(ids)), s) for s in _exact(q[:, cut].T, c.T)]
                    else:                           # one more, as the query's own row may be among them
                        found, _ = search_columns(q[:, cut], block["rest"][:, cut], c, rest, k + 1, floor[cut])
                    for j, (at, score) in enumerate(found, g):
                        other = rids[at] != own[j]
                        if other.any():
                            at, score = at[other], score[other].astype(np.int64)
                            best[j] = keep(best[j], ids[at], rids[at], score)
                            if len(best[j][2]) == k and not wide:
                                floor[j] = max(floor[j], best[j][2][-1])
        sizes = [len(x[0]) for x in best]
        query = np.repeat(np.arange(len(best), dtype=np.int32), sizes)
        ids, rids, score = (np.concatenate([x[i] for x in best]) for i in range(3))
        for at in range(0, len(query), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (query, ids, rids, score)],
                                             names=["query", "vec_id", "rid", "score"])
    return run


def _best(rows: DataFrame, block: dict, k: int, wide: bool) -> DataFrame:
    found = rows.mapInArrow(_scan(block, k, wide), FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(asked: DataFrame, width: int) -> tuple[dict, np.ndarray]:
    """A block's queries (about QUERY_BYTES) as arrays, and their ids."""
    t = asked.select("rid", "vec_id", "v").orderBy("rid").toArrow()
    q = _columns(t.column("v").combine_chunks(), width)
    return {"rid": t.column("rid").to_numpy(), "v": q, "rest": remaining(q, DIMS),
            "floor": np.full(q.shape[1], -np.inf)}, t.column("vec_id").to_numpy()


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
          query_bytes: int = QUERY_BYTES, pilot_rows: int = PILOT) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``queries`` holds,
    against all rows but the query's own."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = vectors.where(usable(vector) & F.col(id_col).isNotNull()) \
        .select(F.col(id_col).cast("long").alias("vec_id"), quantized(vector).alias("v"),
                F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = write_table(rows.withColumn("rid", F.monotonically_increasing_id()), "topk-vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                     F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
    width, top = max(1, facts["width"] or 0), facts["top"] or 0.0
    wide = top * top * width >= EXACT
    once = rows.where("is_query").groupBy("vec_id", "v").agg(F.min("rid").alias("rid")).select("rid")
    asked = write_table(rows.where("is_query").join(once, "rid", "left_semi").select("rid", "vec_id", "v"), "topk-queries")
    every = max(1, facts["n"] // pilot_rows)
    pilot = write_table(rows.where(F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(every)) == 0), "topk-pilot")
    blocks = -(-asked.count() * width * 8 // query_bytes)
    out = scratch_path(spark, "topk")
    for i in range(blocks):
        block, ids = _block(asked.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == i), width)
        if not len(ids):
            continue
        if not wide:                                # one row per query of the block
            for r in _best(pilot, block, k, wide).where(F.col("rank") == k).select("query", "score").collect():
                block["floor"][r["query"]] = r["score"]
        named = F.broadcast(spark.createDataFrame([(j, int(x)) for j, x in enumerate(ids)], "query int, query_id long"))
        _best(rows, block, k, wide).join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score") \
            .write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if blocks else spark.createDataFrame([], schema)
