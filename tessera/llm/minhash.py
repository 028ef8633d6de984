"""MinHash near-dedup: one-permutation hashing, banded buckets, star edges.

A document's set holds the 64-bit hashes of its distinct word shingles; equal
sets are one class from here on. One permutation: the hash itself. Its first
bits pick one of BINS bins, and a bin's value is the least hash that fell into
it. Empty bins borrow by optimal densification: bin i looks at the bins that a
fixed hash of (i, attempt) names until one is filled, the same ones for every
document. ROWS bins in a row make a band's key, and equal keys a bucket. At the
threshold of 0.85 two sets miss all BANDS bands with a chance below 1e-8.

A bucket's candidate edges are a star: its center, the member whose hash is
least, against all others, so their number is that of the members. Candidates
are confirmed on the full sets. A star alone would lose links between members
that aren't near the center. So a bucket whose members aren't all of one
component after that has its rest, the members outside its largest component,
compared with all of it, exactly. Up to SMALL members, each of the rest is the
center of one more star (the same few pairs in many bands, confirmed once). In
larger buckets rest and main part are cut into blocks of bounded size; a task
holds two blocks, counts the shingles that each pair shares by a product of 0/1
matrices and returns a forest of the links, no pairs. So every pair that
shares a bucket is confirmed, refused, or joined by links already found; nothing
is capped, and no task holds a bucket.

Edge cases: texts that are null or without words have an empty set and are
linked with nothing; fewer words than a shingle make one; rows with equal sets
(repeated rows too) are linked whatever their order, and the smallest doc_id
names the component; null ids never do, unless a component has no other; very
long texts are one row of their set's size; an empty table gives an empty
result; only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_few, worker_state, write_table
from tessera.llm.components import components
from tessera.llm.simhash import forest

SHINGLE = 5
BINS, ROWS = 512, 8
BANDS = BINS // ROWS
SIMILAR = 85                 # hundredths
SMALL = 16                   # members of a bucket whose rest is settled by further stars
BLOCK_ROWS, BLOCK_HASHES = 512, 1 << 20     # of a block, about
COLUMNS = 8192               # shingles of a block's matrix held at a time
CACHE_WORDS = 1 << 18
SEED = 11
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Of UTF-8 bytes, lower() changes A-Z alone and split() cuts at space and
    the controls tab to carriage return alone."""
    return text.lower().split()


def word_hashes(words: list[bytes], cache: dict) -> np.ndarray:
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w, SEED)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _folded(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix((out ^ h[i:i + n]) + _ODD)
    return out


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE, cache: dict | None = None) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles; all words as
    one where there are fewer. The texts' words are hashed as one sequence."""
    words = [words_of(t or b"") for t in texts]
    h = word_hashes([w for doc in words for w in doc], {} if cache is None else cache)
    runs, out, at = _folded(h, size), [], 0
    for doc in words:
        n = len(doc)
        own = runs[at:at + n - size + 1] if n >= size else _folded(h[at:at + n], n) if n else np.empty(0, np.uint64)
        out.append(np.unique(own))
        at += n
    return out


def _probes() -> np.ndarray:
    """(attempts, bins): the bin that an empty bin looks at. After these, any
    filled one is found by walking on from its own place."""
    i = np.arange(BINS, dtype=np.uint64)
    return np.stack([mix(i * _ODD + np.uint64(t + 1)) % np.uint64(BINS) for t in range(4 * BINS)]).astype(np.int64)


PROBES = _probes()


def one_permutation(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS): the densified bin values of sets of sorted hashes, none empty."""
    n = len(sets)
    hashes = np.concatenate(sets) if n else np.empty(0, np.uint64)
    place = np.repeat(np.arange(n) * BINS, [len(x) for x in sets]) \
        + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))      # sorted: a bin's first hash is its least
    value, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    value[place[first]], filled[place[first]] = hashes[first], True
    empty = np.flatnonzero(~filled)
    for look in PROBES:
        if not len(empty):
            break
        at = empty - empty % BINS + look[empty % BINS]
        ok = filled[at]
        value[empty[ok]] = value[at[ok]]
        empty = empty[~ok]
    for e in empty:
        own = np.flatnonzero(filled[e - e % BINS:e - e % BINS + BINS])
        value[e] = value[e - e % BINS + own[np.searchsorted(own, e % BINS) % len(own)]]
    return value.reshape(n, BINS)


def band_keys(value: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of (sets, BINS) values."""
    rows = value.reshape(len(value), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, rows.shape[:2])
    for r in range(ROWS):
        keys = mix((keys ^ rows[:, :, r]) + _ODD)
    return keys.view(np.int64)


def _sets_of(shingle: int, with_sets: bool, schema: pa.Schema):
    """The columns but the last, a text in UTF-8, then n and key of its set and
    the set itself or its bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state("minhash").setdefault("words", {})
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                sets = shingle_sets(part.column(part.num_columns - 1).to_pylist(), shingle, cache)
                filled = [s for s in sets if len(s)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if with_sets:
                    lists = [s.view(np.int64) for s in sets]
                else:
                    bands = iter(band_keys(one_permutation(filled)))
                    lists = [next(bands) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(lists, pa.list_(pa.int64()))], schema=schema)
    return run


def with_sets(rows: DataFrame, shingle: int, name: str) -> DataFrame:
    """The rows with their last column, a text, replaced by n, key and ``name``:
    bands or hashes. An empty set has no key and no bands."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    text = rows.columns[-1]
    rows = rows.withColumn(text, F.encode(F.col(text).cast("string"), "UTF-8"))
    out = T.StructType([*rows.schema.fields[:-1]]).add("n", T.LongType()).add("key", T.BinaryType()) \
        .add(name, T.ArrayType(T.LongType()))
    return rows.mapInArrow(_sets_of(shingle, name == "hashes", to_arrow_schema(out)), out)


# ---- links ----------------------------------------------------------------

def _alike(common, a, b, similar: int):
    return 100 * common >= similar * (a + b - common)


def _pair(x, y) -> list:
    """a, b of a pair: first the one of the smaller hash, a star's center, so that
    few classes come first."""
    first = F.xxhash64(x) < F.xxhash64(y)      # of one long the hash is one-to-one
    return [F.when(first, x).otherwise(y).alias("a"), F.when(first, y).otherwise(x).alias("b")]


def sets_of(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """The sets that a side of the (written) pairs asks for; no other is shuffled."""
    asked = broadcast_if_few(pairs.select(F.col(side).alias("rep")).distinct())
    return sets.join(asked, "rep", "left_semi").select(F.col("rep").alias(side), F.col("hashes").alias(f"h{side}"))


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; a written table."""
    a, b = sets_of(pairs, "a", sets), sets_of(pairs, "b", sets)
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    return pairs.join(a, "a").join(b, "b") \
        .where(_alike(common, F.size("ha").cast("long"), F.size("hb").cast("long"), similar)).select("a", "b")


def stars(members: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) between each bucket's center and its others
    whose size allows a link. One class is the center of most of its buckets, so
    that their pairs are the same."""
    center = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n")).alias("c"))
    near = members.join(center, "bucket").where(
        (F.col("rep") != F.col("c.rep")) & (100 * F.least("n", F.col("c.n")) >= SIMILAR * F.greatest("n", F.col("c.n"))))
    return near.select(*_pair(F.col("rep"), F.col("c.rep"))).distinct()


def more_stars(members: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) between the rest of small buckets and members
    of other components."""
    centers = members.where("NOT main").select("bucket", F.col("rep").alias("c"), F.col("n").alias("cn"), F.col("comp").alias("ccomp"))
    near = members.join(centers, "bucket").where(
        (F.col("comp") != F.col("ccomp")) & (100 * F.least("n", "cn") >= SIMILAR * F.greatest("n", "cn")))
    return near.select(*_pair(F.col("rep"), F.col("c"))).distinct()


def open_members(members: DataFrame) -> DataFrame:
    """The members (bucket, rep, n, comp) of buckets that hold several components,
    with ``main``: of the bucket's largest one, the bucket's rows and the numbers
    of blocks that the rest and the main part take."""
    per = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    top = F.max(F.struct("rows", "hashes", "comp"))
    most = per.groupBy("bucket").agg(top.alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("rows").alias("rows"),
                                     F.sum("hashes").alias("hashes")).where("comps > 1")

    def blocks(rows, hashes):
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(hashes / BLOCK_HASHES)).cast("int")
    most = most.select("bucket", F.col("top.comp").alias("top"), "rows",
                       blocks(F.col("rows") - F.col("top.rows"), F.col("hashes") - F.col("top.hashes")).alias("rest_blocks"),
                       blocks(F.col("top.rows"), F.col("top.hashes")).alias("main_blocks"))
    return members.join(most, "bucket").select("bucket", "rep", "n", "comp", (F.col("comp") == F.col("top")).alias("main"),
                                               "rows", "rest_blocks", "main_blocks")


def cells(members: DataFrame) -> DataFrame:
    """(bucket, i, j, rep, comp, block): a row per cell a member belongs to. Cell
    (i, j) holds block i of the rest and block j, which is of the rest as well or,
    from rest_blocks on, of the main part."""
    rest, both = F.col("rest_blocks"), F.col("rest_blocks") + F.col("main_blocks")
    own = F.when(F.col("main"), rest + F.pmod(F.xxhash64("rep"), F.col("main_blocks"))) \
        .otherwise(F.pmod(F.xxhash64("rep"), rest)).cast("int")
    placed = members.withColumn("block", own)
    other = F.when(F.col("main"), F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), both - 1))
    return placed.withColumn("other", F.explode(other)).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "comp", "block")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of hashes in common, by products of 0/1 matrices."""
    both = left + right
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    several = times[column] > 1
    _, column = np.unique(column[several], return_inverse=True)
    row = row[several]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((len(both), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        out += (m[:len(left)] @ m[len(left):].T).astype(np.int64)
    return out


def _cell_links(similar: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        sets = [np.asarray(x) for x in pdf["hashes"]]
        left = np.flatnonzero(pdf["block"] == key[1])
        right = np.flatnonzero(pdf["block"] == key[2])
        n, comp, rep = np.array([len(x) for x in sets], np.int64), pdf["comp"].to_numpy(), pdf["rep"].to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        common = shared_counts([sets[x] for x in left], [sets[x] for x in right])
        linked = _alike(common, n[left][:, None], n[right][None, :], similar) & (comp[left][:, None] != comp[right][None, :])
        x, y = np.nonzero(linked)
        root = forest(len(sets), iter([(left[x], right[y])]))
        at = np.flatnonzero(root != np.arange(len(sets)))
        return pd.DataFrame({"a": rep[root[at]], "b": rep[at]})
    return run


def shared_buckets(bands: DataFrame) -> DataFrame:
    """The members (bucket, rep, n) of buckets with more than one class, of
    classes (rep, n, bands)."""
    buckets = bands.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = write_table(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket"),
                         "minhash-buckets")
    return buckets.join(broadcast_if_few(shared), "bucket").select("bucket", "rep", "n")      # a long each


def similar_components(members: DataFrame, hashes: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(node, root) of the classes that link to others; hashes: (rep, hashes) of
    every class in ``members``, a written table as well."""
    pairs = write_table(stars(members), "minhash-pairs")
    links = write_table(confirmed(pairs, hashes, similar), "minhash-links")
    roots = write_table(components(links), "minhash-roots")
    named = members.join(roots, members["rep"] == roots["node"], "left") \
        .select("bucket", "rep", "n", F.coalesce("root", "rep").alias("comp"))
    rest = write_table(open_members(named), "minhash-open")
    few = F.col("rows") <= SMALL
    again = more_stars(rest.where(few)).join(pairs, ["a", "b"], "left_anti")
    more = confirmed(write_table(again, "minhash-pairs"), hashes, similar)
    large = rest.where(~few)
    asked = broadcast_if_few(large.select("rep").distinct())
    found = cells(large).join(hashes.join(asked, "rep", "left_semi"), "rep").groupBy("bucket", "i", "j") \
        .applyInPandas(_cell_links(similar), "a long, b long")
    more = write_table(more.union(found).distinct(), "minhash-links")
    return roots if more.isEmpty() else write_table(components(links.union(more)), "minhash-roots")


def one_of_each(hashes: DataFrame) -> DataFrame:
    """(rep, hashes) with one row per rep. The rows of a rep are equal, and several
    come of rows of one id and set alone, so that mostly no set is shuffled."""
    several = write_table(hashes.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rep"), "minhash-repeated")
    if several.isEmpty():
        return hashes
    several = broadcast_if_few(several)
    one = hashes.join(several, "rep", "left_semi").groupBy("rep").agg(F.first("hashes").alias("hashes"))
    return write_table(hashes.join(several, "rep", "left_anti").unionByName(one), "minhash-hashes")


def first_rows(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """The prints of the classes' first rows. Copies are looked for by key and left
    out by rid (a long each): they are the fewer, so that mostly no bands are shuffled."""
    several = broadcast_if_few(classes.where("rows > 1").select("key", "rep"))
    copies = write_table(prints.select("rid", "key").join(several, "key").where("rid <> rep").select("rid"), "minhash-copies")
    return prints.join(broadcast_if_few(copies), "rid", "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. The sets of
    classes that share a bucket with another are made again from their texts;
    no other set is stored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    prints = write_table(with_sets(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), shingle,
                                   "bands"), "minhash-prints")
    # the copies of a set: its first row stands for them
    filled = prints.where("key IS NOT NULL")
    classes = filled.groupBy("key").agg(
        F.min(F.struct("rid", "doc_id")).alias("first"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"))
    classes = write_table(classes.select("key", F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("rep_doc"),
                                         "least_id", "rows"), "minhash-classes")
    bands = first_rows(filled, classes).select(F.col("rid").alias("rep"), "n", "bands")
    members = write_table(shared_buckets(bands), "minhash-members")
    asked = write_table(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "rep_doc", "key"),
                        "minhash-asked")
    # rows of the asked documents, by id; among rows of one id the key tells
    few = broadcast_if_few(asked.select(F.col("rep_doc").alias("id_")).distinct())
    again = with_sets(rows.join(few, rows["doc_id"].eqNullSafe(few["id_"]), "left_semi"), shingle, "hashes")
    hashes = one_of_each(write_table(again.join(broadcast_if_few(asked.select("key", "rep")), "key").select("rep", "hashes"), "minhash-hashes"))
    roots = similar_components(members, hashes)
    named = classes.join(roots, classes["rep"] == roots["node"], "left") \
        .select("key", "least_id", F.coalesce("root", "rep").alias("root"))
    named = write_table(named, "minhash-named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = named.join(least, "root").select("key", "component_id")
    out = prints.select("doc_id", "n", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
