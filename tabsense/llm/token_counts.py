"""Token counts by a digest cache.

The digest of the normalised content (null as empty text; these tokenisers have no other normalisation that keeps
their counts) and the digest of the tokeniser version are joined to stored counts.  Only distinct contents without a
stored count are encoded, and their counts are appended to the cache, so a second call over the same or a grown
corpus encodes only what is new.  Copies cost one row of 32 bytes each, not one encoding each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import library_tokens
from tabsense.llm.common import arrow_map

CACHE_SCHEMA = "content binary, version string, n_tokens long"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokeniser version (empty before the first append)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == version).select("content", "n_tokens")


def content_digest(text: str = "text"):
    """Digest of a text's content; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def extend_cache(df: DataFrame, cache: str, path: str, rule: str, text: str = "text") -> None:
    """Encode the distinct contents of ``df`` that have no stored count and append theirs (one writer at a time;
    the append is one job, so it is there whole or not at all)."""
    spark, version = df.sparkSession, library_tokens.version(path)
    contents = df.select(content_digest(text).alias("content"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # copies are dropped before the shuffle, too: a group of any size moves one text a task
    missing = contents.dropDuplicates(["content"]).join(read_cache(spark, cache, version), "content", "left_anti")

    def count(batch: pa.RecordBatch) -> dict:
        counts = library_tokens.load(path, rule, counts=True).encode(batch.column("text").to_pylist())
        return {"content": batch.column("content"), "version": [version] * batch.num_rows, "n_tokens": counts}

    arrow_map(missing, count, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(df: DataFrame, cache: str, path: str, rule: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text as column ``out`` (replacing one of that name).

    ``cache`` is a folder on shared storage that is read, extended and read again.  Null and empty texts count 0
    (what the library gives for an empty text), repeated rows stay repeated, an empty table gives an empty one.
    """
    extend_cache(df, cache, path, rule, text)
    stored = read_cache(df.sparkSession, cache, library_tokens.version(path)).select(
        F.col("content").alias("_content"), F.col("n_tokens").alias("_counted"))
    rows = df.withColumn("_content", content_digest(text))
    kept = [c for c in df.columns if c != out]
    return rows.join(stored, "_content", "left").select(*[F.col(f"`{c}`") for c in kept], F.col("_counted").alias(out))
