"""Feature preparation: ML type detection, date parts, label codes,
standardisation, PCA table, target correlation and helpers.

Encoder state is kept as DataFrames (``label_map(column, class, idx)``,
``scaler(column, mean, scale)``) so it can be stored as tables and joined
back, never held per row on the driver.  Label codes are dense ranks of the
distinct values from the distributed row index (range partitioning, no
single-task window); the map is broadcast only below a checked size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.dates import DATE_SHARE_FOR_FEATURES, parse_any, parse_with
from tabsense.functions.numeric import col
from tabsense.functions.schema import ROW_ID, data_fields, is_numeric, is_temporal, numeric_cols, without_nan
from tabsense.operators.decomposition import pca_table
from tabsense.operators.quantiles import FIELD_BUDGET
from tabsense.operators.rows import with_row_index

# Fixed values of the reference's type heuristic.
CLASS_MAX_DISTINCT = 15      # numeric target with < 15 distinct values ...
CLASS_MAX_RATIO = 0.1        # ... and distinct / n < 0.1 is a classification target
DATE_PART_SUFFIXES = ("_year1", "_month1", "_day1")


def detect_ml_type(df: DataFrame, target: str | None) -> str:
    """classification / regression / clustering for a target column."""
    if not target or target not in df.columns:
        return "clustering"
    r = df.agg(F.count(col(target)).alias("n"), F.count_distinct(col(target)).alias("k")).first()
    n, k = r["n"], r["k"]
    if n == 0:
        return "clustering"
    dt = df.schema[target].dataType
    if isinstance(dt, (T.StringType, T.BooleanType)) or k == 2:
        return "classification"
    if is_numeric(dt):
        return "classification" if (k < CLASS_MAX_DISTINCT and k / n < CLASS_MAX_RATIO) else "regression"
    return "classification"


def ml_type_table(df: DataFrame, targets: list[str | None]) -> DataFrame:
    rows = [(t, detect_ml_type(df, t)) for t in targets]
    return df.sparkSession.createDataFrame(rows, "target string, ml_type string")


def date_features(df: DataFrame, share: float = DATE_SHARE_FOR_FEATURES, drop_original: bool = False,
                  parse_int_yyyymmdd: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Date columns (native, text with >= ``share`` parsable rows, or
    integer yyyymmdd) become timestamps and gain ``_year1``, ``_month1``,
    ``_day1``.  One aggregate decides every candidate column."""
    fields = [f for f in data_fields(df) if f.name not in exclude]
    cand = {}
    for f in fields:
        if is_temporal(f.dataType):
            cand[f.name] = col(f.name).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.StringType):
            cand[f.name] = parse_any(col(f.name)).cast("timestamp_ntz")
        elif parse_int_yyyymmdd and isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            cand[f.name] = parse_with(col(f.name).cast("string"), "yyyyMMdd").cast("timestamp_ntz")
    if not cand:
        return df
    r = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(e).alias(f"p{i}") for i, e in enumerate(cand.values())]).first()
    out = df
    for i, (c, e) in enumerate(cand.items()):
        native = is_temporal(df.schema[c].dataType)
        if not native and (r["__n"] == 0 or r[f"p{i}"] < share * r["__n"]):
            continue
        out = out.withColumn(c, e).withColumns({
            f"{c}_year1": F.year(col(c)).cast("long"),
            f"{c}_month1": F.month(col(c)).cast("long"),
            f"{c}_day1": F.dayofmonth(col(c)).cast("long")})
        if drop_original:
            out = out.drop(c)
    return out


def label_map(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, class, idx): classes sorted by code point, nulls as the
    class ``'None'``; idx is the dense rank within the column."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, class string, idx long")
    items = [F.struct(F.lit(c).alias("column"), F.coalesce(col(c).cast("string"), F.lit("None")).alias("class"))
             for c in cols]
    distinct = df.select(F.explode(F.array(*items)).alias("s")).select("s.column", "s.class").distinct()
    ranked = with_row_index(distinct, ["column", "class"], name="__g")
    first = ranked.groupBy("column").agg(F.min("__g").alias("__f"))
    return ranked.join(F.broadcast(first), "column").select(
        "column", "class", (F.col("__g") - F.col("__f")).alias("idx"))


def apply_label_map(df: DataFrame, mapping: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each text column by its code: a join per column, without a
    hint (AQE broadcasts a map whose measured bytes are few)."""
    out = df
    for c in cols:
        m = mapping.where(F.col("column") == c).select(F.col("class").alias("__cls"), F.col("idx").alias("__idx"))
        key = F.coalesce(col(c).cast("string"), F.lit("None"))
        out = (out.join(m, key == F.col("__cls"), "left")
               .withColumn(c, F.col("__idx")).drop("__cls", "__idx"))
    return out.select(*df.columns)


def label_encode(df: DataFrame, cols: list[str] | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    cols = cols if cols is not None else [f.name for f in data_fields(df)
                                          if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name != target]
    mapping = label_map(df, cols)
    return apply_label_map(df, mapping, cols), mapping


def scaler_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, scale) with population std; a constant column has
    scale 1 (scikit-learn's rule); NaN is missing."""
    df = without_nan(df, cols)
    parts = []
    for at in range(0, len(cols), FIELD_BUDGET // 4):  # wider aggregates lose code generation
        some = cols[at:at + FIELD_BUDGET // 4]
        agg = df.agg(*[e for i, c in enumerate(some) for e in (
            F.avg(col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(col(c).cast("double")).alias(f"s{i}"))])
        items = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"),
                          F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"))
                 for i, c in enumerate(some)]
        parts.append(agg.select(F.inline(F.array(*items))))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "column string, mean double, scale double")


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    rows = scaler.collect()   # one row per column
    return without_nan(df, [r["column"] for r in rows]).withColumns({r["column"]: (col(r["column"]).cast("double") - F.lit(r["mean"])) / F.lit(r["scale"])
                           for r in rows if r["mean"] is not None})


def standardize(df: DataFrame, cols: list[str] | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(x - mean) / population std for numeric columns except the target;
    nulls pass through."""
    cols = cols if cols is not None else [c for c in numeric_cols(df) if c != target]
    sc = scaler_table(df, cols)
    return apply_scaler(df, sc), sc


def transform_dataset(df: DataFrame, target: str | None = None, clean: bool = True,
                      bucket_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cleaning -> date parts -> label codes -> standardisation.
    Returns (transformed, label_map, scaler)."""
    from tabsense.operators.cleaning import preprocess_full
    cur = df
    if clean:
        kw = {"bucket_rows": bucket_rows} if bucket_rows else {}
        cur = preprocess_full(df, **kw)[0]
    cur = date_features(cur, exclude=(target,) if target else ())
    # label codes are not scaled afterwards: only columns numeric before encoding
    numeric_before = [c for c in numeric_cols(cur) if c != target]
    cur, mapping = label_encode(cur, target=target)
    cur, sc = standardize(cur, numeric_before)
    return cur, mapping, sc


def pca_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PCA table of the numeric columns with nulls set to 0, unscaled."""
    cols = cols if cols is not None else numeric_cols(df)
    return pca_table(df.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]),
                     cols, standardize=False)


def target_correlation(df: DataFrame, target: str | None = None) -> DataFrame:
    """Correlation matrix of numeric columns after encoding a text target
    temporarily; columns that are all zero are left out."""
    from tabsense.operators.plotdata import correlation_matrix
    cur = df
    if target and isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        cur, _ = label_encode(df, [target])
    cols = numeric_cols(cur)
    r = cur.agg(*[F.bool_and(F.coalesce(col(c) == 0, F.lit(False))).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    keep = [c for i, c in enumerate(cols) if not r[f"z{i}"]]
    return correlation_matrix(cur, keep)


def transformation_report(df: DataFrame, target: str | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """What happened to each column of a transformed dataset.  Label-encoded
    columns hold numbers afterwards; they are told by ``mapping`` (the label
    map of :func:`label_encode`)."""
    encoded = {r["column"] for r in mapping.select("column").distinct().collect()} if mapping is not None else set()
    rows = []
    for f in data_fields(df):
        if f.name == target:
            what = "target (not transformed)"
        elif f.name in encoded or isinstance(f.dataType, T.StringType):
            what = "label encoding"
        elif is_numeric(f.dataType):
            what = "standardisation"
        elif is_temporal(f.dataType):
            what = ", ".join(f"{f.name}{s}" for s in DATE_PART_SUFFIXES)
        else:
            what = "none"
        rows.append((f.name, what))
    return df.sparkSession.createDataFrame(rows, "column string, transformation string")


def date_feature_profile(df: DataFrame) -> DataFrame:
    """nulls, min, max, mean of every date-part column."""
    cols = [c for c in df.columns if c.endswith(DATE_PART_SUFFIXES)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, nulls long, min double, max double, mean double")
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count_if(col(c).isNull()).alias(f"n{i}"), F.min(col(c)).cast("double").alias(f"lo{i}"),
        F.max(col(c)).cast("double").alias(f"hi{i}"), F.avg(col(c)).alias(f"m{i}"))])
    return agg.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"lo{i}").alias("min"),
        F.col(f"hi{i}").alias("max"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(cols)])))


def split_features_target(df: DataFrame, target: str | None) -> tuple[list[str], DataFrame]:
    """Feature names (numeric, not the target) and the projection
    ``row_id, features..., target``."""
    feats = [c for c in numeric_cols(df) if c != target]
    keep = ([ROW_ID] if ROW_ID in df.columns else []) + feats + ([target] if target else [])
    return feats, df.select(*[col(c) for c in keep])


def candidate_values(df: DataFrame, cols: list[str] | None = None, k: int = 50) -> DataFrame:
    """Up to ``k`` distinct non-null values per column in order of first
    appearance: (column, value, first_row_id).  One distinct aggregate
    (map-side combine) and a top-k per column."""
    cols = cols if cols is not None else [f.name for f in data_fields(df)]
    items = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols]
    firsts = (df.select(ROW_ID, F.explode(F.array(*items)).alias("s"))
              .where(F.col("s.value").isNotNull())
              .groupBy("s.column", "s.value").agg(F.min(ROW_ID).alias("first_row_id")))
    from tabsense.operators.stats import top_k_per_group
    return top_k_per_group(firsts, "column", [F.col("first_row_id")], k)
