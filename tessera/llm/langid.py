"""Language ID by segmentation-marginalised unigrams.

The vocabulary is that of a public piece tokenizer; only its piece strings are
used. Each language has a probability per piece, learned by EM from word
counts: the probability of a word is the sum over all its segmentations into
pieces (forward algorithm), and the expected piece counts come from the
forward and backward sums. A text scores the sum of its words' log
probabilities; the languages' scores give the posterior.

Learning takes about LEARN_DOCS documents per language (all, if fewer; else
the lowest share of the rows' hashes), whole texts; scoring reads every whole
text. Words are runs of letters, lower-cased, behind a word-start mark;
letters outside the vocabulary cost one floor piece each. Every word is summed
whole: those up to LONG letters in batches, longer ones (text without spaces
too) by the same recurrence in logarithms, which needs the sums at the last
PIECE places only and can't underflow. Learning alone counts a run over LONG
letters in parts of that length.

Edge cases: a null text or one without letters is ``und`` with score 0; ties
go to the language first by code point; repeated rows are answered each; with
no row to learn from, every text is ``und``; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pack_row, texts_in, worker_state

LEARN_DOCS = 300
EM_ROUNDS = 4
LONG, PIECE = 40, 16          # letters of a word summed in doubles (41 floor pieces are above 1e-300); longest piece
STEP = 1 << 14                # letters of a longer word looked up at once
FLOOR = 1e-7                  # a letter outside the vocabulary; additive smoothing
CACHE_WORDS = 1 << 17
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(1_000_003)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[str]:
    """The distinct piece strings of letters (and the word-start mark)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()))
    return sorted({p for p in pieces if 0 < len(p) <= PIECE and p != START and LETTERS.fullmatch(p.removeprefix(START))}
                  | {START})


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def learning_words(text: str) -> list[str]:
    return [w[i:i + LONG] for w in words_of(text) for i in range(0, len(w), LONG)]


def _hash_pieces(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


class Lattice:
    """All pieces at all places of a batch of words, found by rolling hashes."""

    def __init__(self, words: list[str], keys: np.ndarray, rank: np.ndarray):
        marked = [START + w for w in words]
        self.n, self.width = len(words), max(map(len, marked), default=0)
        codes = np.zeros((self.n, self.width), np.uint64)
        self.length = np.fromiter(map(len, marked), np.int64, self.n)
        flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        codes[np.arange(self.width) < self.length[:, None]] = flat
        # piece[l][:, i]: index of the piece codes[:, i:i+l+1], or -1
        self.piece = []
        h = np.zeros_like(codes)
        for size in range(1, min(PIECE, self.width) + 1):
            h = h[:, :self.width - size + 1] * _BASE + codes[:, size - 1:]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = (keys[at] == h) & (np.arange(self.width - size + 1) + size <= self.length[:, None])
            self.piece.append(np.where(hit, rank[at], -1))

    def forward(self, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over segmentations of each word's prefixes, (n, width + 1, langs),
        and the (n, langs) logarithm of the whole word's. probs: (pieces + 1,
        langs), the last row the floor piece."""
        alpha = np.zeros((self.n, self.width + 1, probs.shape[1]))
        alpha[:, 0] = 1.0
        for end in range(1, self.width + 1):
            total = alpha[:, end - 1] * np.where(self.piece[0][:, end - 1] >= 0, 0, FLOOR)[:, None]
            for size in range(1, min(PIECE, end) + 1):
                p = self.piece[size - 1][:, end - size]
                rows = np.flatnonzero(p >= 0)
                if len(rows):
                    total[rows] += alpha[rows, end - size] * probs[p[rows]]
            alpha[:, end] = total
        whole = alpha[np.arange(self.n), self.length]
        return alpha, np.log(np.maximum(whole, 1e-300))

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language (probs: (pieces + 1, 1))."""
        alpha, _ = self.forward(probs)
        alpha, p = alpha[:, :, 0], probs[:, 0]
        beta = np.zeros((self.n, self.width + 1))
        beta[np.arange(self.n), self.length] = 1.0
        for at in range(self.width - 1, -1, -1):
            total = beta[:, at + 1] * np.where(self.piece[0][:, at] >= 0, 0, FLOOR)
            for size in range(1, min(PIECE, self.width - at) + 1):
                k = self.piece[size - 1][:, at]
                total += np.where(k >= 0, p[k], 0) * beta[:, at + size]
            beta[:, at] = np.where(self.length == at, 1.0, total)
        share = counts / np.maximum(beta[:, 0], 1e-300)
        out = np.zeros(len(p))
        for size, k in enumerate(self.piece, 1):
            rows, at = np.nonzero(k >= 0)
            ks = k[rows, at]
            np.add.at(out, ks, share[rows] * alpha[rows, at] * p[ks] * beta[rows, at + size])
        return out


def log_probs(model: dict) -> np.ndarray:
    """The pieces' log probabilities, with a last row for "no such piece"."""
    with np.errstate(divide="ignore"):
        return np.log(np.vstack([model["probs"], np.zeros(len(model["langs"]))]))


def long_word(word: str, keys: np.ndarray, rank: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """(languages,) log probabilities of one word of any length, its places
    visited from left to right."""
    floor, none = len(logs) - 2, len(logs) - 1
    codes = np.frombuffer((START + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sums = np.full((PIECE, logs.shape[1]), -np.inf)
    sums[-1] = 0.0                                           # the empty prefix
    for at in range(0, len(codes), STEP):
        lead = min(at, PIECE - 1)                            # a piece may start before the step
        part = codes[at - lead:at + STEP]
        piece = np.full((len(part), PIECE), none)            # by last letter and PIECE - length
        h = np.zeros(len(part), np.uint64)
        for size in range(1, min(PIECE, len(part)) + 1):
            h = h[:len(part) - size + 1] * _BASE + part[size - 1:]
            found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            piece[size - 1:, PIECE - size] = np.where(keys[found] == h, rank[found], floor if size == 1 else none)
        sums = np.vstack([sums, np.empty((len(part) - lead, logs.shape[1]))])
        for end, row in enumerate(piece[lead:]):
            terms = sums[end:end + PIECE] + logs[row]
            top = terms.max(axis=0)
            sums[end + PIECE] = top + np.log(np.exp(terms - top).sum(axis=0))
        sums = sums[-PIECE:]
    return sums[-1]


def learn(samples: dict[str, dict[str, int]], path: str | None = None, rounds: int = EM_ROUNDS) -> dict:
    """Model from word counts per language: sorted piece keys, their ranks, the
    languages and their piece probabilities."""
    pieces = vocabulary(path)
    keys = _hash_pieces(pieces)
    order = np.argsort(keys)
    keys, rank = keys[order], order.astype(np.int64)
    langs = sorted(samples)
    probs = np.full((len(pieces) + 1, len(langs)), 1.0 / len(pieces))
    probs[-1] = FLOOR
    for j, lang in enumerate(langs):
        words = sorted(samples[lang], key=len)
        counts = np.array([samples[lang][w] for w in words], float)
        blocks = [(Lattice(words[i:i + 4096], keys, rank), counts[i:i + 4096]) for i in range(0, len(words), 4096)]
        for _ in range(rounds):
            got = sum((lat.expected(probs[:, j:j + 1], c) for lat, c in blocks), np.zeros(len(pieces) + 1))[:-1]
            probs[:-1, j] = (got + FLOOR * got.sum()) / (got.sum() * (1 + FLOOR * len(pieces)))
    return {"keys": keys, "rank": rank, "langs": langs, "probs": probs}


def score_words(words: list[str], model: dict) -> np.ndarray:
    """(words, languages) log probabilities."""
    out = np.empty((len(words), len(model["langs"])))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for i in range(0, len(order), 2048):
        part = order[i:i + 2048]
        out[part] = Lattice([words[j] for j in part], model["keys"], model["rank"]).forward(model["probs"])[1]
    return out


def _predict(model: dict, schema: pa.Schema, field: str | None):
    langs = np.array([*model["langs"], "und"], object)
    logs = log_probs(model)

    def batch(texts: list[str | None], known: dict, table: list) -> tuple[np.ndarray, np.ndarray]:
        split = [words_of(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if len(w) <= LONG and w not in known})
        if new:
            got = score_words(new, model)
            start = len(known)
            known.update(zip(new, range(start, start + len(new))))
            table.append(got)
            if len(table) > 1:
                table[:] = [np.concatenate(table)]
        best, score = np.full(len(texts), len(langs) - 1), np.zeros(len(texts))
        for i, ws in enumerate(split):
            if len(langs) > 1 and any(c.isalpha() for w in ws for c in w):
                total = sum((long_word(w, model["keys"], model["rank"], logs) for w in ws if len(w) > LONG), np.zeros(len(langs) - 1))
                short = [known[w] for w in ws if len(w) <= LONG]
                if short:
                    total = total + table[0][short].sum(axis=0)
                k = int(np.argmax(total))
                best[i], score[i] = k, 1.0 / np.exp(np.maximum(total - total[k], -700)).sum()
        return best, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("langid")
        for b in batches:
            texts = texts_in(b, field)
            best, score = [], []
            for at in range(0, len(texts), 128):
                if state.get("mark") != model["mark"] or len(state["words"]) > CACHE_WORDS:
                    state.update(mark=model["mark"], words={}, table=[])
                k, s = batch(texts.slice(at, 128).to_pylist(), state["words"], state["table"])
                best.append(k)
                score.append(s)
            yield pa.RecordBatch.from_arrays(
                [*(b.columns if field else b.columns[:-1]), pa.array(langs[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))],
                schema=schema)
    return run


def sample_words(docs: DataFrame, id_col: str, text: str, lang: str, limit: int = LEARN_DOCS) -> dict[str, dict[str, int]]:
    """Word counts per language of about `limit` rows: those whose hash is in
    the lowest limit / rows of all hashes (copies of a row count once). Only
    counts per language are needed to know the share, no ranking."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.lit(11)).alias("h"),
                F.col(text).cast("string").alias("text"))
    n = dict(rows.groupBy("lang").count().collect())         # a row per language
    if not n:
        return {}
    top = {k: int(min(1.0, limit / v) * (1 << 64)) - (1 << 63) for k, v in n.items()}
    tops = F.create_map(*[F.lit(x) for k, v in top.items() for x in (k, min(v, (1 << 63) - 1))])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        n: dict[str, int] = {}
        for t in pdf["text"]:
            for word in learning_words(t):
                n[word] = n.get(word, 0) + 1
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(n), "word": list(n), "n": list(n.values())}, dtype=object)

    taken = rows.where(F.col("h") <= tops[F.col("lang")]).dropDuplicates(["lang", "h"])
    counted = taken.withColumn("part", F.pmod("h", F.lit(32))).groupBy("lang", "part") \
        .applyInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {k: {} for k in n}
    for r in counted.collect():                              # bounded by the sample
        out[r["lang"]][r["word"]] = r["n"]
    return {k: v for k, v in out.items() if v}


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        vocabulary_path: str | None = None, limit: int = LEARN_DOCS) -> dict:
    model = learn(sample_words(docs.where(~held_out(id_col)), id_col, text, lang, limit), vocabulary_path)
    model["mark"] = hash(model["probs"].tobytes())
    return model


def predict(rows: DataFrame, model: dict, field: str | None = None) -> DataFrame:
    """The rows with their last column, a text, replaced by lang_pred and score;
    with ``field``, the last column is a packed row that stays, and the text is
    that field of it."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    kept = [*(rows.schema.fields if field else rows.schema.fields[:-1])]
    out = T.StructType(kept).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return rows.mapInArrow(_predict(model, to_arrow_schema(out), field), out)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col, text, **fitting)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text"))
    return predict(rows, model)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """The rows whose language is recognised, with all their columns."""
    model = fit(docs, id_col, text, **fitting)
    return predict(pack_row(docs), model, field=text).where("lang_pred <> 'und'").select("row_.*")
