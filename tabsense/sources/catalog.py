"""The dataset catalog: originals, cleaned versions and transforms.

Catalogs are DataFrames (``original``, ``cleaned``, ``transformed``) with an
upload order column ``uploaded_seq`` (or a timestamp).  Every operation is
a join, a keyed merge or a top-k, never a collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.numeric import col
from tabsense.sources import manifest

NAME_SUFFIX_HEX = 8   # the reference draws 2 random hex digits; 8 from a hash avoid collisions


def _suffix(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, NAME_SUFFIX_HEX)


def _stem(filename: Column) -> Column:
    return F.when(filename.contains("."), F.regexp_extract(filename, r"^(.*)\.[^.]*$", 1)).otherwise(filename)


def register_dataset(uploads: DataFrame, filename: str = "original_filename", order: str = "uploaded_seq") -> DataFrame:
    """Catalog rows for uploaded files: ``dataset_<snake stem>_<hex>`` and
    the file type."""
    fn = col(filename)
    base = F.regexp_replace(F.lower(_stem(fn)), r"\W+", "_")
    return uploads.select(
        F.concat(F.lit("dataset_"), base, F.lit("_"), _suffix(fn, col(order))).alias("table_name"),
        fn.alias("original_filename"),
        F.lower(F.regexp_extract(fn, r"([^.]*)$", 1)).alias("file_type"),
        col(order).alias(order))


def register_cleaned(cleaned: DataFrame, updates: DataFrame, key: str = "table_name_cleaned",
                     order: str = "uploaded_seq") -> DataFrame:
    """Upsert: the newest row per cleaned-table name wins (small per-key
    window, no global ordering)."""
    both = cleaned.unionByName(updates)
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def register_transformed(requests: DataFrame, cleaned_col: str = "cleaned_table",
                         order: str = "uploaded_seq") -> DataFrame:
    """``dataset_transforme_<hex><cleaned name without leading 'dataset'>``."""
    base = F.regexp_replace(F.regexp_replace(F.lower(col(cleaned_col)), r"^dataset", ""), r"\W+", "_")
    return requests.select(
        F.concat(F.lit("dataset_transforme_"), _suffix(col(cleaned_col), col(order)), base).alias("table_name_transformed"),
        col(cleaned_col).alias("cleaned_table"), col(order).alias(order))


def latest_dataset(original: DataFrame, cleaned: DataFrame, order: str = "uploaded_seq") -> DataFrame:
    """The newest original; its cleaned version is the table to read when
    it exists.  Top-1 of the original catalog, then a lookup."""
    newest = original.orderBy(F.col(order).desc()).limit(1)
    c = cleaned.select(F.col("original_table").alias("table_name"), "table_name_cleaned")
    return newest.join(c, "table_name", "left").select(
        "table_name", "original_filename",
        F.coalesce("table_name_cleaned", "table_name").alias("read_table"), order)


def open_latest_dataset(original: DataFrame, cleaned: DataFrame, root: str, order: str = "uploaded_seq") -> DataFrame:
    """The table that :func:`latest_dataset` names, opened: the newest version of ``root``/<table name>."""
    newest = latest_dataset(original, cleaned, order).first()
    if newest is None:
        raise LookupError("the catalog is empty")
    return manifest.open_table(original.sparkSession, f"{root.rstrip('/')}/{newest['read_table']}")


def delete_tables(candidates: DataFrame, root: str) -> int:
    """Delete the tables that :func:`retention_candidates` names (below ``root``); how many.  Names come to the driver a
    partition at a time."""
    deleted = 0
    for row in candidates.select("table_name").distinct().toLocalIterator():
        manifest.drop(candidates.sparkSession, f"{root.rstrip('/')}/{row['table_name']}")
        deleted += 1
    return deleted


def latest_transformed(transformed: DataFrame, cleaned: DataFrame, order: str = "uploaded_seq") -> DataFrame:
    """The newest transform with its cleaned row and previous target."""
    newest = transformed.orderBy(F.col(order).desc()).limit(1)
    c = cleaned.select(F.col("table_name_cleaned").alias("cleaned_table"), "original_table")
    return newest.join(c, "cleaned_table", "inner").select(
        "table_name_transformed", "cleaned_table", "original_table", "target_column", order)


def _past_newest(df: DataFrame, name: str, order: Column, keep: int, family: str) -> DataFrame:
    newest = df.orderBy(order.desc()).limit(keep).select(col(name).alias("__keep"))
    return (df.join(newest, col(name) == F.col("__keep"), "left_anti")
            .select(F.lit(family).alias("family"), col(name).alias("table_name")))


def retention_candidates(original: DataFrame, cleaned: DataFrame, transformed: DataFrame,
                         keep: int = 2, order: str = "uploaded_seq") -> DataFrame:
    """Tables past the ``keep`` newest per family.  Originals by their own
    time and the ``dataset_`` prefix; cleaned tables by their original's
    time; transforms by their own time.  The newest rows are a top-k; the
    rest is an anti join (no global window)."""
    orig = original.where(F.col("table_name").startswith("dataset_"))
    cl = cleaned.select("table_name_cleaned", "original_table").join(
        original.select(F.col("table_name").alias("original_table"), F.col(order).alias("__t")), "original_table")
    return (_past_newest(orig, "table_name", F.col(order), keep, "original")
            .unionByName(_past_newest(cl, "table_name_cleaned", F.col("__t"), keep, "cleaned"))
            .unionByName(_past_newest(transformed, "table_name_transformed", F.col(order), keep, "transformed")))
