"""Descriptive and advanced statistics, outliers, PCA and text analysis.

One wide aggregate per table for moments; exact quartiles by histogram
refinement (:mod:`tabsense.operators.quantiles`); text statistics by
``groupBy(column, value)`` over a stacked projection (map-side combine,
so hot values are cheap) and per-column top-k.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.numeric import col
from tabsense.functions.schema import numeric_cols, text_cols, without_nan
from tabsense.operators.quantiles import column_ranges, exact_quantiles, quartile_fences
from tabsense.session import materialize


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group by ``order`` (ties broken by the
    order columns).  ``row_number() <= k`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so at most k rows per group and
    partition move, and a group with a huge number of rows is cut down
    where it lies instead of being gathered into one task."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def _one_row_per_column(agg: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row wide aggregate (``{metric}{i}`` columns) into one row
    per input column, lazily."""
    items = [F.struct(F.lit(c).alias("column"),
                      *[F.col(f"{m}{i}").cast(t).alias(m) for m, t in fields.items()])
             for i, c in enumerate(cols)]
    return agg.select(F.inline(F.array(*items)))


def moments(df: DataFrame, cols: list[str]) -> tuple[dict, dict]:
    """Ranges and all moments that the two tables below need, from one scan for both."""
    def extra(i, c):
        x = col(c).cast("double")
        return [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.var_pop(x).alias(f"vpop{i}"),
                F.skewness(x).alias(f"g1_{i}"), F.kurtosis(x).alias(f"g2_{i}")]
    return column_ranges(df, cols, extra, extra_fields=17)


def describe_numeric(df: DataFrame, cols: list[str] | None = None, quartiles: dict | None = None,
                     found: tuple[dict, dict] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25 %, 50 %, 75 %, max per numeric column.
    Moments, counts and ranges come from one scan; the quartiles from the
    refinement passes (or the caller, who may need them elsewhere, too;
    ``found``: from :func:`moments`)."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    schema = ("column string, count long, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
    def extra(i, c):
        x = col(c).cast("double")
        return [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}")]
    ranges, r = found or column_ranges(df, cols, extra, extra_fields=5)
    qs = quartiles or exact_quantiles(df, cols, [0.25, 0.5, 0.75], ranges)
    rows = [(c, ranges[c][0], r[f"mean{i}"], r[f"std{i}"], ranges[c][1], *qs[c], ranges[c][2])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, schema)


def describe_advanced(df: DataFrame, cols: list[str] | None = None, quartiles: dict | None = None,
                      found: tuple[dict, dict] | None = None) -> DataFrame:
    """median, variance, std, coefficient of variation, skew, kurtosis.

    The scan computes plain moments only (Spark's central-moment
    aggregates); the bias corrections of pandas are applied to the one
    aggregated row.  Wrapping many aggregates in conditional expressions
    makes the generated code too large for whole-stage codegen."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    def extra(i, c):
        x = col(c).cast("double")
        return [F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"vpop{i}"),
                F.skewness(x).alias(f"g1_{i}"), F.kurtosis(x).alias(f"g2_{i}")]
    ranges, r = found or column_ranges(df, cols, extra, extra_fields=14)
    medians = {c: v[1:2] for c, v in quartiles.items()} if quartiles else exact_quantiles(df, cols, [0.5], ranges)
    rows = []
    for i, c in enumerate(cols):
        n = ranges[c][0] or 0
        mean, vpop = r[f"mean{i}"], r[f"vpop{i}"]
        var = vpop * n / (n - 1) if vpop is not None and n > 1 else None
        std = math.sqrt(var) if var is not None else None
        pstd = math.sqrt(vpop) if vpop is not None else None
        r[f"variance{i}"] = var
        cv = std / mean if std is not None and mean not in (None, 0.0) else None
        skew = kurt = None
        if n >= 3:
            skew = 0.0 if pstd == 0 else _finite(r[f"g1_{i}"], lambda g: g * math.sqrt(n * (n - 1)) / (n - 2))
        if n >= 4:
            kurt = 0.0 if pstd == 0 else _finite(
                r[f"g2_{i}"], lambda g: (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))
        rows.append((c, medians[c][0], r[f"variance{i}"], std, cv, skew, kurt))
    return df.sparkSession.createDataFrame(
        rows, "column string, median double, variance double, std double, cv double, skew double, kurtosis double")


def _finite(v, f):
    return None if v is None or math.isnan(v) else f(v)


def outlier_counts(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5,
                   quartiles: dict | None = None) -> DataFrame:
    """Rows outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] per numeric column, and
    whether any column has one."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    fences = quartile_fences(df, cols, whisker, quartiles=quartiles)
    aggs = []
    for i, c in enumerate(cols):
        _, _, _, lo, hi = fences[c]
        x = col(c).cast("double")
        flag = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
        aggs += [F.count_if(flag).alias(f"outliers{i}"), F.lit(lo).cast("double").alias(f"lower{i}"),
                 F.lit(hi).cast("double").alias(f"upper{i}")]
    per_col = _one_row_per_column(df.agg(*aggs), cols, {"outliers": "long", "lower": "double", "upper": "double"})
    # one row per column: a window over the whole (tiny) table is fine here
    return per_col.withColumn("has_outliers", F.max(F.col("outliers") > 0).over(Window.partitionBy()))


def _stack_text(df: DataFrame, cols: list[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.explode(F.array(*items)).alias("s")).select("s.column", "s.value")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): how often every non-null value occurs in each column."""
    return _stack_text(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def text_uniques(df: DataFrame, cols: list[str] | None = None, k: int = 20, counted: DataFrame | None = None) -> DataFrame:
    """Number of distinct non-null values and the first ``k`` in sorted order
    (joined by ", ").  The distinct set is one shuffle; the k smallest per
    column come from a per-column top-k (see :func:`top_k_per_group`)."""
    cols = cols if cols is not None else text_cols(df)
    distinct = counted if counted is not None else value_counts(df, cols)
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    firsts = top_k_per_group(distinct, "column", [F.col("value")], k).select("column", "value")
    listed = firsts.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("first_values"))
    return counts.join(listed, "column")


def text_describe(df: DataFrame, cols: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """pandas ``describe()`` of text columns: count, unique, top, freq.
    Ties for ``top`` go to the smallest value."""
    cols = cols if cols is not None else text_cols(df)
    freq = counted if counted is not None else value_counts(df, cols)
    per = freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("m"))
    return per.select("column", F.col("count").cast("long"), F.col("unique").cast("long"),
                      F.col("m.v").alias("top"), (-F.col("m.neg")).cast("long").alias("freq"))


def _words(c):
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != F.lit(""))


def avg_word_count(df: DataFrame, cols: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Mean number of whitespace-separated words over non-null values; with ``counted`` (from :func:`value_counts`) every
    distinct value is split once."""
    cols = cols if cols is not None else text_cols(df)
    if counted is not None:
        sized = counted.select("column", "n", (F.size(_words(F.col("value"))) * F.col("n")).alias("words"))
        agg = sized.agg(*[F.try_divide(F.sum(F.when(F.col("column") == c, F.col("words"))), F.sum(F.when(F.col("column") == c, F.col("n"))))
                          .alias(f"avg_words{i}") for i, c in enumerate(cols)])
        return _one_row_per_column(agg, cols, {"avg_words": "double"})
    agg = df.agg(*[F.avg(F.size(_words(col(c)))).alias(f"avg_words{i}") for i, c in enumerate(cols)])
    return _one_row_per_column(agg, cols, {"avg_words": "double"})


def word_frequency(df: DataFrame, cols: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Lower-cased words per text column with their frequency; with ``k`` only
    the ``k`` most frequent of each column (ties by word).  Words are counted with map-side combine; every text is split
    whole."""
    cols = cols if cols is not None else text_cols(df)
    words = _stack_text(df, cols).select("column", F.explode(_words(F.lower(F.col("value")))).alias("word"))
    counts = words.groupBy("column", "word").agg(F.count(F.lit(1)).alias("frequency"))
    return counts if k is None else top_k_per_group(counts, "column", [F.desc("frequency"), F.col("word")], k)


def text_length_distribution(df: DataFrame, cols: list[str] | None = None, bins: int = 30) -> DataFrame:
    """Histogram of text lengths (characters) per text column, ``bins`` equal bins."""
    from tabsense.operators.plotdata import histogram
    cols = cols if cols is not None else text_cols(df)
    lengths = df.select(*[F.length(col(c)).cast("long").alias(c) for c in cols])
    return histogram(lengths, cols, bins)


def pca_scaled(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PCA of the standardised numeric columns (rows with a null dropped):
    component, eigenvalue, explained %, cumulative %."""
    from tabsense.operators.decomposition import pca_table
    cols = cols if cols is not None else numeric_cols(df)
    return pca_table(df.na.drop(subset=cols), cols, standardize=True)


def profile_all(df: DataFrame) -> DataFrame:
    """Every statistic above as one tidy table (section, column, metric,
    value, text): numbers in ``value`` (double), words in ``text``.  What several
    of them need is found once: moments, quartiles, the counts of text values."""
    from tabsense.operators.profile import categories_of, null_profile
    cats = categories_of(df)
    num, txt = cats["numeric"], cats["text"]
    parts = []

    def tidy(section: str, frame: DataFrame, metrics: list[str]) -> DataFrame:
        types = dict(frame.dtypes)
        items = [F.struct(F.lit(m).alias("metric"),
                          (F.lit(None).cast("double") if types[m] == "string" else F.col(m).cast("double")).alias("value"),
                          (F.col(m) if types[m] == "string" else F.lit(None).cast("string")).alias("text"))
                 for m in metrics]
        return frame.select(F.lit(section).alias("section"), "column", F.inline(F.array(*items)))

    if num:
        found = moments(df, num)
        quartiles = exact_quantiles(df, num, [0.25, 0.5, 0.75], found[0])
        parts.append(tidy("describe", describe_numeric(df, num, quartiles, found),
                          ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
        parts.append(tidy("advanced", describe_advanced(df, num, quartiles, found),
                          ["median", "variance", "std", "cv", "skew", "kurtosis"]))
        parts.append(tidy("outliers", outlier_counts(df, num, quartiles=quartiles), ["outliers"]))
    if txt:
        counted = materialize(value_counts(df, txt), "values")
        parts.append(tidy("text_uniques", text_uniques(df, txt, counted=counted), ["n_unique", "first_values"]))
        parts.append(tidy("text_describe", text_describe(df, txt, counted), ["count", "unique", "top", "freq"]))
        parts.append(tidy("text_words", avg_word_count(df, txt, counted), ["avg_words"]))
    parts.append(tidy("missing", null_profile(df), ["null_count"]))
    return reduce(DataFrame.unionByName, parts)
