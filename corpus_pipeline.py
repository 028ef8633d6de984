"""The corpus pipeline: five stages over `documents`, each one of the corpus
operators, each written as Parquet and read again before the next.

Language ID drops rows without a recognised language, exact dedup keeps one of
equal texts, SimHash near-dedup one of each group, mixing repeats or drops rows
to the sources' target weights, packing turns what is left into sequences.
Every stage keeps the columns of `documents`, but for the last, which returns
one row per packed piece. Null, empty and repeated rows follow the operators'
own rules (see their modules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, langid, mixing, packing, simhash
from tessera.llm.common import write_table
from tessera.sources.tables import read

#: Packing runs in workers beside a JVM that the earlier stages have grown, so
#: its word cache is smaller here than alone: less memory, some more CPU time.
PACK_CACHE_WORDS = 1 << 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cache_words=PACK_CACHE_WORDS)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("simhash_near_dedup", near_copies),
          ("mix_sources", mix), ("pack", pack)]

#: Learned language models, XXH64 and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name}")
    return docs
