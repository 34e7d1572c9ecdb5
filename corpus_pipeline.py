"""The corpus pipeline: documents in, digests of encoded clean documents out.

Each stage calls one operator, works on everything its predecessor kept, and
returns the columns of documents; the last returns the encoding digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import chunk_reuse, decontamination, language_id, simhash, substring_dedup
from tracewise.llm.common import stored
from tracewise.llm.queries import WORD_BPE, tokenizer_path
from tracewise.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (null or letterless texts)."""
    return language_id.keep_identified(docs, language_id.train(docs.filter(~language_id.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences under non-first repeated spans are cut; the character count follows the text."""
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark text go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return chunk_reuse.encode_decode(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe_encode_decode", encode),
]

ORACLE_SQL = None  # fingerprints, learned prototypes and token ids are beyond SQL; tests/llm holds brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
