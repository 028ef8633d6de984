"""Vector best-fit packing of token sequences.

A document's ids are those of the tokenizer, then the end id. Documents longer
than a sequence are cut into full pieces and a rest. Each piece uses three
resources of a sequence: tokens, one document, and attention cost (its length
squared). Pieces are dealt evenly into shards; a shard packs its pieces,
longest first, each into the open sequence that fits under every capacity and
is left with the smallest weighted norm of its residuals (or, as an option, has
the largest weighted dot-product of need and residual), else into a new one.
WEIGHTS make a token count for more than all of the other two, whose capacities
follow from the token limit by default and bind only where they are given.

What a shard leaves part-filled is packed again: pieces of sequences below FULL
are dealt into fewer shards, round by round, until one shard holds the rest or a
round leaves more than half of its pieces so.

Where the tokenizer's file says that it splits at white space before anything
else, the ids of a text are those of its words in order, and words are tokenized
once per worker and kept (a bounded cache). Where it also says that it lower-cases
and parts letters from marks, a word's ids are those of its stem and closing mark.
Other tokenizers read whole texts.

Edge cases: a null or empty text is one piece holding the end id; repeated
rows are packed each; very long texts are cut, never dropped; ties go to the
sequence opened first; a null id stays null; an empty table gives an empty
result; only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import worker_state, write_table

MAX_TOKENS, END_ID = 4096, 1
SHARD_PIECES = 1 << 12
CACHE_WORDS = 1 << 20
MARKS = ".,;:!?|"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
WEIGHTS = (1.0, 1e-8, 1e-8)
FULL = 0.99                  # of a sequence's tokens: left alone by further rounds
WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def splits(path: str) -> tuple[bool, bool]:
    """(at white space, lower-cases and parts letters from marks) by the tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    def parts(node, many):
        return (node or {}).get(many) or ([node] if node else [])
    first = (parts(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # the matches are kept, and none holds white space
    words = first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed" \
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not re.search(r"\\s(?!\\p)| ", pattern)
    lower = any(n.get("type") == "Lowercase" for n in parts(spec.get("normalizer"), "normalizers"))
    return words, words and lower


def _load(path: str) -> dict:
    state = worker_state("packing")
    if state.get("path") != path:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        words, stems = splits(path)
        state.update(path=path, tokenizer=Tokenizer.from_file(path), wordwise=words, stems=stems, words={}, older={})
    return state


def _encoded(state: dict, texts: list[str]) -> Iterator[bytes]:
    for e in state["tokenizer"].encode_batch_fast(texts, add_special_tokens=False):
        yield array("I", e.ids).tobytes() if LITTLE else np.array(e.ids, "<u4").tobytes()


def encode_words(words: set[str], state: dict, cache_words: int = CACHE_WORDS) -> dict[str, bytes]:
    """A dict that holds the little-endian unsigned 32-bit ids of each word,
    from the cache or the tokenizer. The cache has two generations of
    cache_words words: words in use move to the younger, the older is let go."""
    known, older = state["words"], state["older"]
    new = words.difference(known)
    if len(known) + len(new) > cache_words:
        known, older, new = {}, known, words
        state.update(words=known, older=older)
    get = older.get
    ask, made = [], []
    for w in new:
        if (ids := get(w)) is not None:
            known[w] = ids
        elif state["stems"] and w[-1] in MARKS and w[:-1].isalpha():
            made.append(w)          # its ids are those of its stem and closing mark
        else:
            ask.append(w)
    for x in {x for w in made for x in (w[:-1], w[-1])}.difference(known, ask):
        if (ids := get(x)) is not None:
            known[x] = ids
        else:
            ask.append(x)
    known.update(zip(ask, _encoded(state, ask)))
    for w in made:
        known[w] = known[w[:-1]] + known[w[-1]]
    return known


def words_of(text: str) -> list[str]:
    """Words between Unicode white space. Python's split() also cuts at the four
    ASCII separators, which the tokenizer doesn't take for white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in WHITE_SPACE.split(text) if w]
    return text.split()


def encode_texts(texts: list[str], path: str, cache_words: int = CACHE_WORDS) -> list[bytes]:
    state = _load(path)
    if not state["wordwise"]:
        return list(_encoded(state, texts))
    if state["stems"]:
        texts = [t.lower() if t.isascii() else t for t in texts]
    words = [words_of(t) for t in texts]
    known = encode_words(set().union(*words), state, cache_words)
    return [b"".join(map(known.__getitem__, w)) for w in words]


def pieces_of(ids: bytes, limit: int, end_id: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, bytes) of a document's ids and the end id."""
    ids += int(end_id).to_bytes(4, "little")
    for k, at in enumerate(range(0, len(ids), 4 * limit)):
        part = ids[at:at + 4 * limit]
        yield k, at // 4, len(part) // 4, part


def _cut(path: str, limit: int, end_id: int, with_ids: bool, cache_words: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows, out = [], []
                texts = [t or "" for t in b.column(1).slice(at, 256).to_pylist()]
                for i, ids in enumerate(encode_texts(texts, path, cache_words), at):
                    for piece in pieces_of(ids, limit, end_id):
                        rows.append(i)
                        out.append(piece)
                k, start, length, part = zip(*out)
                cols = [b.column(0).take(pa.array(rows)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in part], pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in part], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 limit: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False,
                 cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces to pack."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_cut(tokenizer or default_tokenizer(), limit, end_id, with_ids, cache_words,
                                to_arrow_schema(out)), out)


def best_fit(lengths: np.ndarray, limit: int = MAX_TOKENS, max_docs: int = MAX_TOKENS,
             max_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS,
             rule: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first. ``rule``: residual (the
    smallest weighted norm of what stays free) or dot (the largest weighted
    dot-product of the piece's needs and what is free)."""
    cost = float(limit) ** 2 if max_cost is None else float(max_cost)
    cap = np.array([limit, max_docs, cost])
    scale = np.sqrt(np.array(weights))[:, None] / cap[:, None]
    free = np.empty((3, max(16, len(lengths))))
    used, full = 0, 0               # bins [0, used); the first `full` can't take anything any more
    order = np.argsort(-lengths, kind="stable")
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    ids = np.empty(free.shape[1], np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        left = free[:, full:used] - need[:, None]
        fits = (left >= 0).all(axis=0)
        if fits.any():
            at = np.flatnonzero(fits)
            if rule == "dot":
                score = -((free[:, full:used][:, at] * scale) * (need[:, None] * scale)).sum(axis=0)
            else:
                score = ((left[:, at] * scale) ** 2).sum(axis=0)
            k = full + int(at[np.argmin(score)])
        else:
            k = used
            ids[k] = used
            free[:, k] = cap
            used += 1
        seq[i], off[i] = ids[k], limit - int(free[0, k])
        free[:, k] -= need
        if free[0, k] < least or free[1, k] < 1:
            # closed: swap to the front, out of the search
            free[:, [full, k]] = free[:, [k, full]]
            ids[[full, k]] = ids[[k, full]]
            full += 1
    return seq, off


def _pack(limit: int, rnd: int, options: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        seq, off = best_fit(lengths, limit, **options)
        used = np.bincount(seq, lengths)
        return pd.DataFrame({"rid": pdf["rid"], "length": lengths, "offset": off, "fill": used[seq] / limit,
                             "sequence_id": (rnd << 56) + (int(pdf["shard"].iloc[0]) << 24) + seq})
    return run


def placed_pieces(loose: DataFrame, limit: int, shard_pieces: int, options: dict) -> DataFrame:
    """(rid, sequence_id, offset) of pieces (rid, length), in rounds."""
    if not 0 < shard_pieces < 1 << 24:
        raise ValueError("shard_pieces must be below 2^24")
    done, rnd, n = [], 0, loose.count()
    while n:
        shards = -(-n // shard_pieces)
        dealt = loose.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(rnd)), F.lit(shards)).cast("long").alias("shard"))
        packed = write_table(dealt.groupBy("shard").applyInPandas(
            _pack(limit, rnd, options), "rid long, length long, offset long, fill double, sequence_id long"), "packed")
        open_ = packed.where(F.col("fill") < FULL)
        left = open_.count() if shards > 1 else 0
        if not left or 2 * left > n:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= FULL))
        loose, n, rnd = open_, left, rnd + 1
    out = [d.select("rid", "sequence_id", "offset") for d in done]
    return reduce(DataFrame.union, out) if out else loose.select("rid", F.lit(0).cast("long").alias("sequence_id"),
                                                                 F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         limit: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, shard_pieces: int = SHARD_PIECES,
         cache_words: int = CACHE_WORDS, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset. Full pieces are sequences of their own; the others are
    packed in shards, and only (row number, length) goes there. ``cache_words``
    bounds a worker's word cache and changes no result."""
    cut = token_pieces(docs, id_col, text, tokenizer, limit, end_id, with_ids, cache_words)
    table = write_table(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    alone = F.col("length") == limit
    placed = placed_pieces(table.where(~alone).select("rid", "length"), limit, shard_pieces, options)
    own = table.where(alone).withColumns({"sequence_id": (F.lit(-1) - F.col("rid")).cast("long"), "offset": F.lit(0).cast("long")})
    return table.where(~alone).join(placed, "rid").unionByName(own).drop("rid")
