"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, repeated passages, mixing, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gets all that the stage before kept.  All
but the last return the columns of ``documents``.  ``run`` applies them to the table, each written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import bpe, mixing, near_dups, quality, substrings
from tabsense.session import checkpoint_dir, materialize
from tabsense.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents scored lower are rejected.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compression classifier: documents that it rejects go; null and empty texts are scored as empty texts."""
    checkpoint_dir(spark)
    scored = quality.score(docs.select(*COLUMNS), quality.fit(docs, read_table(spark, sf_dir, "labels")), out="_score")
    return scored.where(F.col("_score") >= QUALITY).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BagMinHash near-dedup: of each class the document with the smallest id stays."""
    checkpoint_dir(spark)
    return near_dups.classified(docs.select(*COLUMNS)).where("doc = class_id").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of 20-word windows that also start earlier go (a changed text is its words left, joined by
    single spaces; a text that loses nothing stays as it is)."""
    checkpoint_dir(spark)
    left = substrings.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                                                    .otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1, at most three epochs each: a document is there as often as it is taken (the last
    time perhaps only its first words); documents without words are never taken."""
    checkpoint_dir(spark)
    mixed = mixing.repeat_rows(mixing.mix(docs.select(*COLUMNS)), COLUMNS)
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of every text, and the digest of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded_documents(docs.select("doc_id", "source", "text"), path, pattern)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("substrings", substring_stage),
          ("mixing", mixing_stage), ("tokens", token_stage)]

#: Trained scores and byte pair merges are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
