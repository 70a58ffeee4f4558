"""One query a corpus operator over the whole driver tables, with production parameters, and SQL where it can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import bpe, content_sort, filter_audit, fingerprints, id_files, langid, lexical, mixing, near_dups, neighbors, oracles, quality, substrings, token_counts
from tabsense.llm.samples import fold
from tabsense.session import checkpoint_dir
from tabsense.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op4_substring_dedup": oracles.SUBSTRING_DEDUP, "op6_near_duplicates": oracles.NEAR_DUPLICATES,
                           "op8_mixing": oracles.MIXING,
                           "op11_lexical_search": oracles.LEXICAL_SEARCH, "op12_filter_audit": oracles.FILTER_AUDIT,
                           "op13_exact_dedup": oracles.EXACT_DEDUP}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    return read_table(spark, sf_dir, "documents")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that executors and driver share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabsense-mat/{name}-{uuid.uuid4().hex}"


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back: digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


@query
def op2_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lempel-Ziv fingerprints of every text and of its edited text, and their likeness."""
    return fingerprints.fingerprint_chain(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text through a digest cache (a new cache each call, so every distinct text is encoded)."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(
        docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")),
        scratch(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.json"), "before_spaces")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of 20-word windows that also start earlier."""
    left = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the folds other than 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", "text", held), langid.fit(docs), keep=["doc_id", "held_out"])


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every text: five-word shingles, weighted Jaccard similarity of 0.8 or more."""
    return near_dups.classified(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_shingles")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from labels of the folds other than 0."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = quality.score(docs.select("doc_id", "text", held), quality.fit(docs, read_table(spark, sf_dir, "labels")), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1, at most three epochs a source."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    checkpoint_dir(spark)
    return neighbors.nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@query
def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text with the end id, written to coded blocks in doc_id order and read back from them."""
    folder = scratch(spark, "token-ids")
    id_files.write_ids(documents(spark, sf_dir).select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"),
                       vocabulary=49_408, end_id=2)
    return id_files.read_ids(spark, folder, with_ids=False)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all 120 orders of five filters in every language."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return filter_audit.audit(filter_audit.document_masks(docs, read_table(spark, sf_dir, "labels")), "ABCDE")


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts; of each the row with the largest id stays."""
    return content_sort.exact_duplicates(documents(spark, sf_dir).select("doc_id", "text"), keep_largest=True)
