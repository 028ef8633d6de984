"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every partition hashes its rows and sends, per owner of a fingerprint
   range, its sorted distinct fingerprints as Golomb-Rice coded gaps, with one
   bit for those it holds more than once.
2. An owner decodes what all senders sent for its range and answers each
   sender with a bitmap: 1 where the fingerprint occurs more than once.
3. Senders mark suspects by their bitmaps. Only suspects' texts are shuffled
   and compared byte for byte (grouped by the text itself).

Fingerprints are cut to 48 bits: fewer bits to send; accidental equals are
told apart in step 3. Edge cases: a null text counts as empty; rows equal in
text and id are one group of which one row stays; a null id loses to any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_few, pack_row, text_or_empty, write_table

FP_BITS = 48
BLOCK_ROWS = 1 << 20      # rows a sender holds at a time
OWNER_ROWS = 1 << 19      # rows an owner gets, about


def fingerprint(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FP_BITS)


def golomb_encode(sorted_values: np.ndarray, low: int, repeated: np.ndarray) -> bytes:
    """Rising distinct ints >= low as Rice-coded gaps: header (count, k), the
    unary quotients, the k-bit remainders, the repeat bits."""
    n = len(sorted_values)
    gaps = np.diff(sorted_values.astype(np.int64), prepend=np.int64(low))
    k = max(0, int(gaps.mean()).bit_length() - 1) if n else 0
    q = gaps >> k
    ends = np.cumsum(q + 1)
    unary = np.ones(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return np.array([n, k, len(unary)], "<i4").tobytes() + b"".join(
        np.packbits(x).tobytes() for x in (unary, rest, repeated.astype(np.uint8)))


def golomb_decode(blob: bytes, low: int) -> tuple[np.ndarray, np.ndarray]:
    n, k, bits = (int(x) for x in np.frombuffer(blob, "<i4", 3))
    raw = np.frombuffer(blob, np.uint8, offset=12)
    at = (bits + 7) // 8
    end = at + (n * k + 7) // 8
    stops = np.flatnonzero(np.unpackbits(raw[:at], count=bits) == 0)
    q = np.diff(stops, prepend=-1) - 1
    rest = np.unpackbits(raw[at:end], count=n * k).reshape(n, k).astype(np.int64)
    gaps = (q.astype(np.int64) << k) + rest @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    return low + np.cumsum(gaps), np.unpackbits(raw[end:], count=n).astype(bool)


def _range_low(owner: int, owners: int) -> int:
    return -(-(owner << FP_BITS) // owners)


def _send(owners: int, id_type: pa.DataType, schema: pa.Schema):
    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        fp = t["fp"].to_numpy()
        distinct, pos, count = np.unique(fp, return_inverse=True, return_counts=True)
        lows = np.array([_range_low(o, owners) for o in range(owners + 1)], np.int64)
        cut = np.searchsorted(distinct, lows)
        owner = np.searchsorted(lows, distinct, "right") - 1
        n, sender = len(t), t["rid"][0].as_py()
        own = owner[pos].astype(np.int32)
        cols = [t["rid"], t["doc_id"], t["fp"], t["sha"], pa.array(np.full(n, sender)), pa.array(own),
                pa.array((pos - cut[own]).astype(np.int32)), pa.nulls(n, pa.binary())]
        out = pa.table(dict(zip(schema.names, cols))).cast(schema)
        yield from out.combine_chunks().to_batches()
        sent = [(o, golomb_encode(distinct[a:b], int(lows[o]), count[a:b] > 1))
                for o, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        m = len(sent)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
             pa.array(np.full(m, sender)), pa.array([o for o, _ in sent], pa.int32()),
             pa.nulls(m, pa.int32()), pa.array([b for _, b in sent], pa.binary())], schema=schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BLOCK_ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)
    return send


def _answer(owners: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        owner = int(pdf["owner"].iloc[0])
        got = [golomb_decode(b, _range_low(owner, owners)) for b in pdf["blob"]]
        values = np.concatenate([v for v, _ in got])
        _, back, count = np.unique(values, return_inverse=True, return_counts=True)
        seen = count[back] > 1
        at, maps = 0, []
        for v, repeated in got:
            maps.append(np.packbits(seen[at:at + len(v)] | repeated).tobytes())
            at += len(v)
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": maps})
    return answer


def exchange(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: rid (row number of this run), doc_id, fp, sha,
    suspect (its fingerprint occurs more than once). Steps 1 to 3's marks."""
    spark = docs.sparkSession
    body = text_or_empty(text)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       fingerprint(body).alias("fp"), F.unhex(F.sha2(body, 256)).alias("sha"))
    owners = max(64, -(-docs.count() // OWNER_ROWS))
    id_type = rows.schema["doc_id"].dataType
    fields = f"rid long, doc_id {id_type.simpleString()}, fp long, sha binary, sender long, owner int, pos int, blob binary"
    from pyspark.sql.pandas.types import to_arrow_type
    at = to_arrow_type(id_type)
    schema = pa.schema([("rid", pa.int64()), ("doc_id", at), ("fp", pa.int64()), ("sha", pa.binary()),
                        ("sender", pa.int64()), ("owner", pa.int32()), ("pos", pa.int32()), ("blob", pa.binary())])
    sent = write_table(rows.mapInArrow(_send(owners, at, schema), fields), "dedup-sent")
    bitmaps = sent.where("rid IS NULL").select("sender", "owner", "blob").groupBy("owner") \
        .applyInPandas(_answer(owners), "sender long, owner int, bitmap binary")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.col("pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("(byte_ >> (7 - pos % 8)) & 1")
    own = sent.where("rid IS NOT NULL").select("rid", "doc_id", "fp", "sha", "sender", "owner", "pos")
    marked = own.join(bitmaps, ["sender", "owner"]).withColumn("byte_", byte)
    return write_table(marked.select("rid", "doc_id", "fp", "sha", (bit == 1).alias("suspect")), "dedup-marked")


def verified_texts(docs: DataFrame, suspects: DataFrame, text: str = "text") -> DataFrame:
    """(fp, sha, n): the suspects' texts, equal byte for byte, and how often
    each occurs. The grouping key is the text; a map task sends each of its
    distinct texts once, so a hot text doesn't meet in one task."""
    fps = broadcast_if_few(write_table(suspects.select("fp").distinct(), "dedup-fps"))
    body = text_or_empty(text)
    texts = docs.select(body.alias("body"), fingerprint(body).alias("fp")).join(fps, "fp", "left_semi")
    same = texts.groupBy("fp", "body").agg(F.count(F.lit(1)).alias("n"))
    return same.select("fp", F.unhex(F.sha2("body", 256)).alias("sha"), "n")


def classify(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.
    Of equal texts the row with the largest id stays."""
    marked = exchange(docs, id_col, text)
    suspects = marked.where("suspect")
    texts = verified_texts(docs, suspects, text).groupBy("fp", "sha") \
        .agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    stays = suspects.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", (-F.col("rid")).alias("r"))).alias("k"))
    groups = stays.join(texts, ["fp", "sha"]).select(
        "fp", "sha", "k", F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share one SHA-256"))).alias("group_size"))
    # as a table, so that the join's row side has a shuffle of its own that a hot group can be split in
    groups = broadcast_if_few(write_table(groups, "dedup-groups"))
    dup = suspects.join(groups, ["fp", "sha"]).select(
        "doc_id", F.col("k.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == -F.col("k.r")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    one = marked.where("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return one.union(dup)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: rows whose fingerprint is
    alone as they are, and of each group of equal texts the row with the
    largest id (then the largest of the other columns)."""
    suspects = exchange(docs, id_col, text).where("suspect")
    fps = broadcast_if_few(write_table(suspects.select("fp").distinct(), "dedup-fps"))
    body = text_or_empty(text)
    packed = pack_row(docs, fp=fingerprint(body))
    alone = packed.join(fps, "fp", "left_anti").select("row_.*")
    again = pack_row(docs, fp=fingerprint(body), body=body, id_=F.col(id_col))
    rest = F.to_json(F.struct(*[F.col(f"row_.`{c}`") for c in docs.columns if c != text]))
    again = again.join(fps, "fp", "left_semi").groupBy("fp", "body") \
        .agg(F.max_by("row_", F.struct("id_", rest)).alias("row_"))
    return alone.unionByName(again.select("row_.*"))
