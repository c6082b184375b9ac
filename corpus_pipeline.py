"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

Language identification drops what it rejects, near-duplicate linking keeps one document of each group, repeated strings
are cut out, contaminated documents go, and what is left is encoded. All stages but the last return documents' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, decontaminate, language, minhash, suffix_dedup
from tidemark.llm._common import drop_folder, prepare, table, written

#: Words of a shingle and the similarity, in percent, of near duplicates.
SHINGLE = 5
PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told with a wide enough margin; their own lang stays as it is. Documents without
    text or without a letter go; null ids and repeated rows do not matter; an empty table stays empty."""
    prepare(spark)
    model = language.learn_dictionaries(docs.filter(~language.held_out()))
    return language.keep_accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that with the smallest id. Documents without an id stay."""
    prepare(spark)
    dropped = minhash.link(docs, size=SHINGLE, percent=PERCENT).filter("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes that occur before out of the texts; documents of which nothing is left go. n_chars follows the text."""
    prepare(spark)
    kept = suffix_dedup.cut_texts(docs).filter("text IS NULL OR text <> ''")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents into which a test item leaked. Null and empty texts stay, as do null ids and repeated rows; an empty
    table stays empty."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to; a null text has no tokens, null ids and
    repeated rows stay, an empty table gives an empty result."""
    prepare(spark)
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe_codec", encode),
]

#: SQL does not express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is dropped once the next one's is written; the last one, which the result
    reads, stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, path = written(docs, f"stage-{name}")
            if before is not None:
                drop_folder(spark, before)
            before = path
    return docs
