"""SimHash near-dedup with vantage-point trees.

Fingerprints: per bit the majority over the XXH64 hashes of all 3-word
shingles. Links (at most RADIUS differing bits) between distinct fingerprints
come from a vantage-point tree. A node holds a vantage fingerprint and a mask
of 16 bits; its children are the shells of equal masked Hamming distance. By
the triangle inequality two fingerprints within r bits differ by at most r in
their distances to the vantage, so a query only enters shells within r of its
own. The masks along a path are disjoint until all 64 bits are used, so the
gaps of one round of masks also add up to at most r: a query that spent its
radius at one node stays in its own shells below. That keeps the number of
shards a fingerprint visits small at any table size.

The tree is built from a bounded sample (SAMPLE fingerprints at most) and
splits until a shard is expected to hold SHARD fingerprints. Every fingerprint
goes to its home shard, and as a query to the shards its ball overlaps that
are numbered above its home (the pair is found from the lower side once). A
shard finds its pairs with the same bounds, splitting again around its own
vantage points where it is large, and returns a forest of its links: at most
one per fingerprint, however dense the group. Nothing is capped; the links'
components are joined exactly.

Edge cases: texts that are null or without words have fingerprint 0 and are
linked like any other; fewer than three words make one shingle; rows equal in
fingerprint are one class; null ids never become a component id unless the
whole class has none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, broadcast_if_few, pack_row, texts_in, write_table
from tessera.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
SAMPLE, SHARD = 1 << 15, 1024
MASK_BITS = 16
PAIR_CELLS = 1 << 22         # cells of a shard's distance table held at a time
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 without words."""
    words = [w for w in ascii_lower(text or "").translate(_SPACES).split(" ") if w]
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g.encode("utf-8", "surrogatepass"), SEED) for g in grams), np.uint64)
    # ones per bit by counting byte values per byte position
    cells = h.astype(">u8").view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    ones = (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(schema: pa.Schema, shingle: int, field: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts_in(b, field)
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([*(b.columns if field else b.columns[:-1]), pa.array(fps.view(np.int64))],
                                             schema=schema)
    return run


def with_fingerprints(rows: DataFrame, shingle: int = SHINGLE, field: str | None = None) -> DataFrame:
    """The rows with their last column, a text, replaced by ``fp`` (the 64 bits
    as a long); with ``field``, the last column is a packed row that stays, and
    the text is that field of it."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    kept = T.StructType([*(rows.schema.fields if field else rows.schema.fields[:-1])]).add("fp", T.LongType())
    return rows.mapInArrow(_fingerprints(to_arrow_schema(kept), shingle, field), kept)


# ---- the tree -------------------------------------------------------------

def _masks() -> list[int]:
    """Disjoint masks of MASK_BITS bits, each spread over the whole word."""
    step = 64 // MASK_BITS
    return [sum(1 << b for b in range(i, 64, step)) for i in range(step)]


MASKS = _masks()


def _gap(fps: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def build_tree(sample: np.ndarray, scale: float, shard: int = SHARD, depth: int = 0) -> tuple:
    """(vantage, mask, children by distance) or () for a shard. ``scale``:
    fingerprints per sampled one. Two rounds of masks at most: a third could
    only split what two rounds of 64 bits could not."""
    if len(sample) < 4 or len(sample) * scale <= shard or depth == 2 * len(MASKS):
        return ()
    vantage, mask = int(sample[len(sample) // 2]), MASKS[depth % len(MASKS)]
    d = _gap(sample, vantage, mask)
    return (vantage, mask, [build_tree(sample[d == k], scale, shard, depth + 1) for k in range(MASK_BITS + 1)])


def number_shards(tree: tuple, first: int = 0) -> tuple[tuple, int]:
    """The tree with its leaves numbered in order; the next free number."""
    if not tree:
        return (first,), first + 1
    children = []
    for c in tree[2]:
        child, first = number_shards(c, first)
        children.append(child)
    return (tree[0], tree[1], children), first


def visits(tree: tuple, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is_home) for every shard that the rows' balls overlap."""
    out: list[tuple] = []

    def walk(node, rows, spare, home, depth):
        if not len(rows):
            return
        if len(node) == 1:
            out.append((rows, np.full(len(rows), node[0], np.int64), home))
            return
        if depth % len(MASKS) == 0:
            spare = np.full(len(rows), radius)
        d = _gap(fps[rows], node[0], node[1])
        for k, child in enumerate(node[2]):
            far = np.abs(d - k)
            ok = far <= spare
            walk(child, rows[ok], (spare - far)[ok], (home & (far == 0))[ok], depth + 1)

    n = len(fps)
    walk(tree, np.arange(n), np.full(n, radius), np.ones(n, bool), 0)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int),) * 2 + (np.empty(0, bool),)


def _route(tree: tuple, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            rows, shard, home = visits(tree, fps, radius)
            own = np.empty(len(fps), np.int64)
            own[rows[home]] = shard[home]
            ok = shard >= own[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[ok]), pa.array(fps[rows[ok]].view(np.int64)), pa.array(home[ok])],
                names=["shard", "fp", "home"])
    return run


# ---- inside a shard -------------------------------------------------------

def near_pairs(homes: np.ndarray, others: np.ndarray, fps: np.ndarray, radius: int,
               depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, other) within the radius. A large table is split
    around one of its homes, whose shells prune as in the tree above; homes
    split into disjoint shells, others enter each shell within the radius."""
    if not len(homes) or not len(others):
        return
    if len(homes) * len(others) > 4 * PAIR_CELLS and depth < 2 * len(MASKS):
        vantage, mask = int(fps[homes[len(homes) // 2]]), MASKS[depth % len(MASKS)]
        dh, do = _gap(fps[homes], vantage, mask), _gap(fps[others], vantage, mask)
        for k in np.unique(dh):
            yield from near_pairs(homes[dh == k], others[np.abs(do - k) <= radius], fps, radius, depth + 1)
        return
    step = max(1, PAIR_CELLS // len(others))
    for i in range(0, len(homes), step):
        block = homes[i:i + step]
        close = np.bitwise_count(fps[block][:, None] ^ fps[others][None, :]) <= radius
        a, b = np.nonzero(close)
        yield block[a], others[b]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index linked to each of n items: pairs are merged as they come,
    by hooking roots to smaller ones and halving paths."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def _shard_links(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", kind="stable")
        fps = pdf["fp"].to_numpy().view(np.uint64)
        homes = np.flatnonzero(pdf["home"].to_numpy())
        root = forest(len(fps), near_pairs(homes, np.arange(len(fps)), fps, radius))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        signed = pdf["fp"].to_numpy()
        return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})
    return run


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius
    among the distinct values of column fp."""
    n = distinct.count()
    every = max(8, -(-n // (sample // 2)))      # at most one in eight reaches the driver
    taken = distinct.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(every)) == 0).select("fp").limit(sample)
    points = np.sort(np.array([r[0] for r in taken.collect()], np.int64)).view(np.uint64)
    np.random.default_rng(7).shuffle(points)
    tree, _ = number_shards(build_tree(points, n / max(1, len(points)), shard))
    routed = distinct.select("fp").mapInArrow(_route(tree, radius), "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long")


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for every distinct fp of a written table of (doc_id,
    fp): the smallest doc_id reachable over links of at most radius bits."""
    distinct = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = write_table(components(write_table(link_fingerprints(distinct, radius), "simhash-links")), "simhash-roots")
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left") \
        .select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    linked = write_table(linked, "simhash-classes")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return linked.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = write_table(with_fingerprints(rows, shingle), "simhash-prints")
    classes = write_table(near_classes(prints, radius).select("fp", "component_id"), "simhash-ids")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                     radius: int = RADIUS) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the
    smallest id (nulls last; then the first read). Row numbers and fingerprints
    are written with the rows, so the fingerprints are computed once."""
    rows = pack_row(docs, rid=F.monotonically_increasing_id(), doc_id=F.col(id_col)).select("rid", "doc_id", "row_")
    table = write_table(with_fingerprints(rows, shingle, field=text), "simhash-rows")
    prints = table.select("rid", "doc_id", "fp")
    classes = write_table(near_classes(prints, radius).select("fp", "root"), "simhash-ids")
    per = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("k"))
    stays = per.join(classes, "fp").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.rid").alias("rid"))
    gone = write_table(prints.select("rid").join(stays, "rid", "left_anti"), "simhash-gone")
    return table.join(broadcast_if_few(gone), "rid", "left_anti").select("row_.*")
