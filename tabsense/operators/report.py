"""Report content as tidy rows (section, item, metric, value, text).

The numbered sections of the reference's PDF report, computed with the
profiling operators and unioned; numbers stay numbers (``value``), words go
to ``text``.  Layout, rounding for display and rendering are left to the
caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.schema import data_fields
from tabsense.operators import profile, stats
from tabsense.operators.quantiles import exact_quantiles

# Fixed values of the reference's report.
EXAMPLE_CHARS = 120     # text examples are cut at 120 characters + "..."
EXAMPLE_VALUES = 5      # first 5 sorted distinct values per text column


def _tidy(section: str, frame: DataFrame, item: str, metrics: list[str]) -> DataFrame:
    types = dict(frame.dtypes)
    items = [F.struct(F.lit(m).alias("metric"),
                      (F.lit(None).cast("double") if types[m] == "string" else F.col(m).cast("double")).alias("value"),
                      (F.col(m) if types[m] == "string" else F.lit(None).cast("string")).alias("text"))
             for m in metrics]
    return frame.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"),
                        F.inline(F.array(*items)))


def report_null_summary(df: DataFrame) -> DataFrame:
    """Number of columns with nulls and the list ``col (pct%)``."""
    nulls = profile.null_profile(df).where(F.col("null_count") > 0)
    entry = F.struct(F.col("ordinal"), F.concat(F.col("column"), F.lit(" ("), F.col("null_pct").cast("string"),
                                                 F.lit("%)")).alias("text"))
    return nulls.agg(F.count(F.lit(1)).alias("columns_with_nulls"),
                     F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ", ")
                     .alias("detail"))


def report_text_examples(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """First 5 sorted distinct values per text column, joined, cut at 120
    characters with ``...``."""
    u = stats.text_uniques(df, cols, EXAMPLE_VALUES)
    joined = F.col("first_values")
    cut = F.when(F.length(joined) > EXAMPLE_CHARS,
                 F.concat(F.substring(joined, 1, EXAMPLE_CHARS), F.lit("..."))).otherwise(joined)
    return u.select("column", "n_unique", cut.alias("examples"))


def report_sections(df: DataFrame) -> DataFrame:
    """All report sections as (section, item, metric, value) text rows."""
    spark = df.sparkSession
    names = [f.name for f in data_fields(df)]
    parts = []
    shape = profile.shape(df)
    parts.append(_tidy("1 general", shape.select(F.lit("dataset").alias("item"), "rows", "columns"), "item",
                       ["rows", "columns"]))
    parts.append(_tidy("2 column types", profile.dtypes(df), "column", ["dtype"]))
    parts.append(_tidy("3 categories", profile.column_categories(df), "column", ["category"]))
    parts.append(_tidy("4 missing values", profile.null_profile(df), "column", ["null_count", "null_pct"]))
    dup = profile.duplicate_summary(df) if names else None
    if dup is not None:
        parts.append(_tidy("5 duplicates", dup.select(F.lit("dataset").alias("item"), "*"), "item",
                           ["scattered_rows", "run_groups", "rows_in_runs", "duplicated_rows"]))
    cats = profile.categories_of(df)
    if cats["numeric"]:
        quartiles = exact_quantiles(df, cats["numeric"], [0.25, 0.5, 0.75])
        parts.append(_tidy("6 descriptive statistics", stats.describe_numeric(df, cats["numeric"], quartiles), "column",
                           ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
        parts.append(_tidy("7 advanced statistics", stats.describe_advanced(df, cats["numeric"], quartiles), "column",
                           ["median", "variance", "std", "cv", "skew", "kurtosis"]))
    if cats["text"]:
        parts.append(_tidy("8 text analysis", report_text_examples(df, cats["text"]), "column",
                           ["n_unique", "examples"]))
    if not parts:
        return spark.createDataFrame([], "section string, item string, metric string, value double, text string")
    return reduce(DataFrame.unionByName, parts)
