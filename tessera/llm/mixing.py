"""Mixing sources to target weights.

Words are summed per source, each source gets a target, the rate is target
over size, and a document is emitted floor(rate) times plus once more when a
coin seeded by its hash falls below the fraction. Expressions only.

Edge cases: a null text has size 0; null sources form one source that sorts
last; rows without words keep their source's rate (and take no words); a
source without words has target 0 and rate 0, so its rows go; exact
repetitions of a row share one coin; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, broadcast_if_few, pack_row, text_or_empty, write_table
from tessera.operators.joins import row_index

COIN_DIGITS = 13  # hex digits of the MD5 that make the coin: 52 bits, exact in a double


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def coin(seed: int, id_col: str, text: str) -> Column:
    """A number in [0, 1) fixed by the seed, the row's id and its text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("~")),
                      F.md5(text_or_empty(text)))
    return F.conv(F.substring(F.md5(key), 1, COIN_DIGITS), 16, 10).cast("double") / float(16 ** COIN_DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources weigh ``weights`` in turn, by code point, null last. They share
    ``share`` times all words; a target stops at ``max_repeat`` times its
    source, and what is above goes to the others by weight until none is
    above: level = (total - capped targets) / (weight of the others), raised
    until the set of capped sources stays the same. Only sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("key_", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"),
                                          F.coalesce("source", F.lit(""))))
    per = row_index(per, "key_", name="rank_")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("rank_") % len(weights) + 1).cast("int"))
    per = write_table(per.select("source", "source_size", w.alias("w_"),
                                 (F.col("source_size") * F.lit(max_repeat)).alias("cap_")), "mix-sources")
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("cap_") <= F.col("w_") * level
        got = per.agg(F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, F.col("cap_"))), F.lit(0.0)),
                      F.coalesce(F.sum(F.when(~capped, F.col("w_"))), F.lit(0.0))).first()
        if got[0] == n_capped or not got[2]:
            break
        n_capped, level = got[0], (total - got[1]) / got[2]
    target = F.least(F.col("cap_"), F.col("w_") * F.lit(level))
    return per.select("source", "source_size", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _copies(rate: Column, u: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
             seed: int = 17, **mix) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate,
    copies. The text is read once; sizes and coins are written as a table."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       word_count(text).alias("size"), coin(seed, id_col, text).alias("u_"))
    base = write_table(base, "mix-base")
    targets = broadcast_if_few(source_targets(base, **mix).withColumnRenamed("source", "s_"))
    j = base.join(targets, F.col("source").eqNullSafe(F.col("s_")))
    return j.select("doc_id", "source", "size", "source_size", "target", "rate",
                    _copies(F.col("rate"), F.col("u_")).alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                seed: int = 17, **mix) -> DataFrame:
    """The mixed corpus: every input row as often as its copies, same columns."""
    sizes = docs.select(F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    targets = broadcast_if_few(source_targets(sizes, **mix).select(F.col("source").alias("s_"), "rate"))
    packed = pack_row(docs, k_=F.col(source).cast("string"), u_=coin(seed, id_col, text))
    j = packed.join(targets, F.col("k_").eqNullSafe(F.col("s_")))
    out = j.select("row_", _copies(F.col("rate"), F.col("u_")).alias("n_")).where("n_ > 0")
    return out.select("row_", F.explode(F.sequence(F.lit(1), F.col("n_"))).alias("copy_")).select("row_.*")
