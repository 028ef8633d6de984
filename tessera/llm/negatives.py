"""Hard-negative mining with segment summaries.

Vectors become whole numbers floor(256 * c) and are cut into LEVELS of ever
finer segments of equal length. Each row is stored with the mean and deviation
of every segment: over a segment of L components the inner product of q and c
is L * mean_q * mean_c, plus or minus at most L * deviation_q * deviation_c.
The sums over a level's segments bound the score from both sides. A pair whose
bounds miss every range it could matter for is dropped; the others go on to the
next finer level, and those that pass all levels are scored exactly.

Anchors are dealt into blocks of about ANCHOR_BLOCK rows. A block goes to every
task, the stored rows are read where they lie (no vector is shuffled), and a
task hands on the best rows of each anchor only. Two passes make a block: the
positives (best rows of the same label), then for each positive the best rows of
other labels whose score lies between LOW and HIGH hundredths of its score.
Before a pass, a pilot of about PILOT rows sets a lower bound for each anchor's
last place, so that tasks hand on little more than what is returned; all rows,
the pilot's too, are read in the pass itself.

Scores are exact: in doubles while all of them stay below 2^46, else in Python
integers without the bounds; a score beyond a long stops at its end, and ranges
are taken of the score so stopped.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; shorter vectors count as padded with zeros; a repeated
anchor row (same id, label and vector) is answered once, and its further copies
are other rows; ties go to the smaller vec_id, then to the row read first; a
positive score below 0 has an empty range; an anchor without other rows of its
label gives no rows; an empty table gives an empty result; only the named
columns are read, so others can't clash; texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_table
from tessera.llm.topk import EXACT, LONG_MAX, usable
from tessera.session import scratch_path

SCALE = 256
LEVELS = (1, 4, 16)          # segments of a vector
LOW, HIGH = 30, 90           # hundredths of the positive's score
POSITIVES, NEGATIVES = 5, 10
ANCHOR_BLOCK = 8192          # anchors that go to every task: 8192 x 64 doubles and summaries are 7 MB
CHUNK_ANCHORS, CHUNK_ROWS = 256, 4096
PILOT = 2048

FOUND = "anchor int, place int, vec_id long, rid long, score long"


def quantized(vector: str) -> Column:
    """Whole numbers held in doubles."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * float(SCALE)
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, whole)


# ---- stored summaries -----------------------------------------------------

def summarize(v: np.ndarray, levels=LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations), each (rows, all levels' segments), times the square
    root of the segment length, so that bounds are plain products. Widths that
    don't divide are padded with zeros."""
    means, devs = [], []
    for s in levels:
        size = -(-v.shape[1] // s)
        padded = np.zeros((len(v), size * s))
        padded[:, :v.shape[1]] = v
        cut = padded.reshape(len(v), s, size)
        mean = cut.mean(axis=2)
        means.append(mean * np.sqrt(size))
        devs.append(np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2)))
    return np.concatenate(means, axis=1), np.concatenate(devs, axis=1)


def _lists(column: pa.Array) -> np.ndarray:
    """(rows, width) of a list column whose lists have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _store(width: int, levels: tuple[int, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((b.num_rows, width))
            for i, x in enumerate(b.column(b.num_columns - 1)):
                x = x.values.to_numpy(zero_copy_only=False)
                v[i, :len(x)] = x
            mean, dev = summarize(v, levels)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (v, mean, dev)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], schema=schema)
    return run


def with_summaries(rows: DataFrame, width: int, levels=LEVELS) -> DataFrame:
    """The rows with their last column, a vector, replaced by the vector padded
    to ``width`` (v), its segments' means (mean) and deviations (dev)."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    out = T.StructType([*rows.schema.fields[:-1]])
    for name in ("v", "mean", "dev"):
        out = out.add(name, T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_store(width, tuple(levels), to_arrow_schema(out)), out)


# ---- one task -------------------------------------------------------------

class Best:
    """The best k rows per key so far, with each key's last score as a floor."""

    def __init__(self, keys: int, k: int, floor: np.ndarray, floors: bool = True):
        self.k, self.floor, self.floors = k, floor.astype(float).copy(), floors
        self.rows = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]   # key, score, vec_id, rid

    def add(self, key, score, vec_id, rid) -> None:
        if not len(key):
            return
        key, score, vec_id, rid = (np.concatenate([a, b]) for a, b in zip(self.rows, (key, score, vec_id, rid)))
        order = np.lexsort((rid, vec_id, -score, key))
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        stay = place < self.k
        order, key = order[stay], key[stay]
        self.rows = [key, score[order], vec_id[order], rid[order]]
        last = (place[stay] == self.k - 1) & self.floors
        self.floor[key[last]] = np.maximum(self.floor[key[last]], score[order][last])


def survivors(qm, qd, cm, cd, need, top, levels, may) -> np.ndarray:
    """Pairs (anchors x rows) that ``may`` matter and whose bounds on some
    range [need, top] of the anchor allow it, level by level; rows and anchors
    left without a pair are compacted away between levels."""
    a, c, at = np.arange(len(qm)), np.arange(len(cm)), 0
    alive = may
    for s in levels:
        live_a, live_c = alive.any(axis=1), alive.any(axis=0)
        a, c, alive = a[live_a], c[live_c], alive[np.ix_(live_a, live_c)]
        if not len(a):
            break
        seg = slice(at, at + s)
        at += s
        middle = qm[a][:, seg] @ cm[c][:, seg].T
        spread = qd[a][:, seg] @ cd[c][:, seg].T
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
        upper, lower = middle + spread + slack, middle - spread - slack
        ok = np.zeros(alive.shape, bool)
        for w in range(need.shape[1]):
            ok |= (upper >= need[a, w][:, None]) & (lower <= top[a, w][:, None])
        alive &= ok
    out = np.zeros(may.shape, bool)
    out[np.ix_(a, c)] = alive
    return out


def exact_scores(q: np.ndarray, c: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return q @ c.T
    whole = [[int(x) for x in row] for row in c]
    return np.array([[max(-LONG_MAX - 1, min(LONG_MAX, sum(int(x) * y for x, y in zip(row, other)))) for other in whole]
                     for row in q], object).reshape(len(q), len(c))


def _scan(block: dict, k: int, same: bool, levels: tuple[int, ...], wide: bool):
    """Best k rows of this task per (anchor, range). block: anchors' rid, label,
    v, mean, dev, and per range low, high (inclusive, in hundredths) and floor."""
    ranges = block["low"].shape[1]

    def scan(batches) -> Best:
        best = Best(len(block["rid"]) * ranges, k, block["floor"].ravel(), floors=not wide)   # a double may round a floor up
        for b in batches:
            for start in range(0, b.num_rows, CHUNK_ROWS):
                part = b.slice(start, CHUNK_ROWS)
                rid, vec_id, label = (part.column(n).to_numpy(zero_copy_only=False) for n in ("rid", "vec_id", "label"))
                v, mean, dev = (_lists(part.column(n)) for n in ("v", "mean", "dev"))
                for g in range(0, len(block["rid"]), CHUNK_ANCHORS):
                    own = np.arange(g, min(g + CHUNK_ANCHORS, len(block["rid"])))
                    may = (block["label"][own][:, None] == label[None, :]) == same
                    may &= block["rid"][own][:, None] != rid[None, :]
                    keys = own[:, None] * ranges + np.arange(ranges)
                    need = np.maximum(block["low"][own] / 100, best.floor[keys])
                    high = block["high"][own]
                    if not wide:
                        may = survivors(block["mean"][own], block["dev"][own], mean, dev, need, high / 100, levels, may)
                    a, c = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                    if not len(a):
                        continue
                    score = exact_scores(block["v"][own[a]], v[c], wide)
                    may = may[np.ix_(a, c)]
                    for w in range(ranges):
                        fits = may & (100 * score >= block["low"][own[a], w][:, None]) \
                            & (100 * score <= high[a, w][:, None]) & (score >= best.floor[keys[a, w]][:, None])
                        held = np.where(fits, score, -np.inf).astype(float)
                        if len(c) > k:      # the row's own k-th best is a floor too
                            fits &= held >= -np.partition(-held, k - 1, axis=1)[:, k - 1:k]
                        x, y = np.nonzero(fits)
                        best.add(keys[a, w][x], score[x, y].astype(np.int64), vec_id[c[y]], rid[c[y]])
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, score, vec_id, rid = scan(batches).rows
        for at in range(0, len(key), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array((key[cut] // ranges).astype(np.int32)), pa.array((key[cut] % ranges).astype(np.int32)),
                 pa.array(vec_id[cut]), pa.array(rid[cut]), pa.array(score[cut])],
                names=["anchor", "place", "vec_id", "rid", "score"])
    return run


# ---- passes ---------------------------------------------------------------

def _best(rows: DataFrame, block: dict, k: int, same: bool, levels, wide: bool) -> DataFrame:
    found = rows.mapInArrow(_scan(block, k, same, tuple(levels), wide), FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(pilot: DataFrame, block: dict, k: int, same: bool, levels, wide: bool) -> np.ndarray:
    """The k-th best score that the pilot's rows reach, per anchor and range."""
    out = np.full(block["low"].shape, -np.inf)
    if wide:
        return out
    for r in _best(pilot, block, k, same, levels, wide).where(F.col("rank") == k).select("anchor", "place", "score").collect():
        out[r["anchor"], r["place"]] = r["score"]
    return out


def _block(anchors: DataFrame) -> dict:
    """A block's anchors (about ANCHOR_BLOCK rows) as arrays."""
    t = anchors.select("rid", "vec_id", "label", "v", "mean", "dev").orderBy("rid").toArrow()
    block = {n: t.column(n).to_numpy() for n in ("rid", "vec_id", "label")}
    for n in ("v", "mean", "dev"):
        block[n] = _lists(t.column(n).combine_chunks())
    return block


def _ranges(block: dict, low, high) -> dict:
    return block | {"low": low, "high": high, "floor": np.full(low.shape, -np.inf)}


def mine(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, levels=LEVELS, anchor_block: int = ANCHOR_BLOCK,
         pilot_rows: int = PILOT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for the rows where ``anchors`` holds, against all rows; ``label`` is a whole number."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"), quantized(vector).alias("v"))
    rows = write_table(rows.withColumn("rid", F.monotonically_increasing_id())
                       .select("rid", "vec_id", "label", "is_anchor", "v"), "negatives-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                     F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
    width, top = facts["width"] or 0, facts["top"] or 0.0
    out = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width:
        return spark.createDataFrame([], schema)
    wide = top * top * width >= float(1 << 46)
    table = write_table(with_summaries(rows, width, levels), "negatives-summaries")
    every = max(1, facts["n"] // pilot_rows)
    pilot = write_table(table.where(F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(every)) == 0), "negatives-pilot")
    asked = table.where("is_anchor").groupBy("vec_id", "label", "v").agg(F.min("rid").alias("rid")).select("rid")
    asked = write_table(table.where("is_anchor").join(asked, "rid", "left_semi"), "negatives-anchors")
    blocks = -(-asked.count() // anchor_block) or 1
    for i in range(blocks):
        block = _block(asked.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == i))
        n = len(block["rid"])
        if not n:
            continue
        first = _ranges(block, np.full((n, 1), -np.inf), np.full((n, 1), np.inf))
        first["floor"] = _floors(pilot, first, positives, True, levels, wide)
        # bounded by the block: a handful of rows per anchor
        found = _best(table, first, positives, True, levels, wide).select("anchor", "rank", "vec_id", "score").collect()
        ids = np.zeros((n, positives), np.int64)
        scores = np.zeros((n, positives), np.int64)
        known = np.zeros((n, positives), bool)
        for r in found:
            ids[r["anchor"], r["rank"] - 1], scores[r["anchor"], r["rank"] - 1] = r["vec_id"], r["score"]
            known[r["anchor"], r["rank"] - 1] = True
        kind = object if wide else np.int64
        low = np.where(known, scores.astype(kind) * LOW, np.inf)
        second = _ranges(block, low, np.where(known, scores.astype(kind) * HIGH, -np.inf))
        if wide:
            second["low"], second["high"] = second["low"].astype(object), second["high"].astype(object)
        second["floor"] = _floors(pilot, second, negatives, False, levels, wide)
        negative = _best(table, second, negatives, False, levels, wide)
        named = F.broadcast(spark.createDataFrame(        # one row per anchor of the block
            [(j, int(block["vec_id"][j]), ids[j].tolist(), scores[j].tolist()) for j in range(n)],
            "anchor int, anchor_id long, ids array<long>, scores array<long>"))
        negative.join(named, "anchor").select(
            "anchor_id", F.get("ids", F.col("place")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"), F.get("scores", F.col("place")).alias("positive_score"),
            F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if asked.head() is not None else spark.createDataFrame([], schema)
