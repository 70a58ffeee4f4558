"""Exact dedup by a content sort, with DataFrame functions only.

Sampled splitters deal the texts to ranges of their bytes (a prefix, then a hash that orders texts of one prefix), an
external sort inside the ranges puts equal texts next to each other, and a window over that order compares each whole
text with its neighbour.  A text with so many copies that they would fill a range is dealt to several ranges; the one
row that each of those found is compared, whole, in a second step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import stored

#: Code points of the splitters' prefix: what Spark samples for the bounds stays small however long texts are.
PREFIX = 32
#: A text is dealt to several ranges when its copies exceed this share of a range's rows.
HEAVY_SHARE = 0.25


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None,
                     keep_largest: bool = False, partitions: int | None = None) -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256), one for each row of ``df``.

    Rows whose texts are equal after ``normalise`` are a group; a null text counts as empty.  Of each group the row
    with the smallest key stays (``keep_largest``: the largest); a null key only stays where no row has another, and
    exactly one of rows that repeat the staying key stays.  Other columns don't matter; an empty table gives no rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("id"), (normalise(body) if normalise else body).alias("body")).withColumn("h", F.xxhash64("body"))

    # texts with many copies: at most n / HEAVY_SHARE of them, whatever the table
    most = max(1, int(df.count() * HEAVY_SHARE / n))
    heavy = stored(rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("ways")).where("ways > 1"), "content-heavy")

    # the place of a row in its task's input splits copies alike for all kinds of keys
    dealt = (rows.join(F.broadcast(heavy), "h", "left").withColumn("prefix", F.substring("body", 1, PREFIX))
             .withColumn("way", F.when(F.col("ways").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("ways")).cast("int")).otherwise(0)))
    ranged = dealt.repartitionByRange(n, "prefix", "h", "way")
    best = F.col("id").desc_nulls_last() if keep_largest else F.col("id").asc_nulls_last()
    equal = Window.partitionBy("prefix", "h", "way", "body")  # the ranges' order, then whole texts
    found = ranged.select("id", "h", "way", F.row_number().over(equal.orderBy(best)).alias("place"),
                          F.first("id").over(equal.orderBy(best)).alias("first"), F.count(F.lit(1)).over(equal).alias("size"),
                          F.sha2("body", 256).alias("sha"), F.when(F.col("ways").isNotNull(), F.col("body")).alias("body"))
    found = stored(found.withColumn("body", F.when(F.col("place") == 1, F.col("body"))), "content-sorted")

    # parts of one text: a row each, compared whole
    firsts = found.where("body IS NOT NULL")
    whole = Window.partitionBy("body")
    first = F.col("first").desc_nulls_last() if keep_largest else F.col("first").asc_nulls_last()
    parts = firsts.select("sha", "way", F.sum("size").over(whole).alias("all_size"), F.first("first").over(whole.orderBy(first, "way")).alias("all_first"),
                          (F.row_number().over(whole.orderBy(first, "way")) == 1).alias("wins"))
    # a row a part: at most n / HEAVY_SHARE parts and as many for what is left over
    joined = found.drop("body").join(F.broadcast(parts), ["sha", "way"], "left")
    return joined.select(F.col("id").alias(key), F.coalesce("all_first", "first").alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"),
                         ((F.col("place") == 1) & F.coalesce("wins", F.lit(True))).alias("kept"), F.col("sha").alias("text_sha256"))
