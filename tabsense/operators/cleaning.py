"""Cleaning: column drops, duplicate removal, missing values, outliers.

Duplicates: ``groupBy(all columns)`` with map-side combine (nulls group
together, a hot row is combined before the shuffle) and null-safe joins
back to the rows.  Missing values: one aggregate gives every null rate;
fills are literal ``coalesce`` projections; interpolation and forward fill
use the two-level scan of :mod:`tabsense.operators.rows`.  Outliers: exact
quartile fences, then one projection or filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.numeric import col
from tabsense.session import materialize
from tabsense.functions.schema import ROW_ID, data_fields, is_numeric, is_temporal, numeric_cols, without_nan
from tabsense.operators.profile import _null_safe_join, row_counts
from tabsense.operators.quantiles import column_modes, quartile_fences
from tabsense.operators.rows import DEFAULT_BUCKET_ROWS, scan_last, scan_neighbors, with_row_index

# Fixed values of the reference's cleaning policy.
DROP_COLUMN_SHARE = 0.6      # keep a column with at least 60 % non-null values
INTERPOLATE_BELOW = 0.1      # numeric: < 10 % missing -> linear interpolation
MEAN_BELOW = 0.4             # numeric: < 40 % missing -> mean, else delete rows
TEXT_MODE_BELOW = 0.5        # text: < 50 % missing -> mode, else delete rows
UNKNOWN_TEXT = "Inconnu"     # text fill when a column has no mode
OUTLIER_SHARE = 0.1          # <= 10 % outlier rows -> delete them, else winsorise


def _keys(df: DataFrame) -> list[str]:
    return [f.name for f in data_fields(df)]


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remove the chosen columns; unknown names are ignored; at least one
    data column must stay."""
    drop = [c for c in cols if c in df.columns and c != ROW_ID]
    if len(_keys(df)) - len(drop) < 1:
        raise ValueError("at least one column must remain")
    return df.drop(*drop)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first (lowest row_id) of every group of equal rows."""
    keys = _keys(df)
    return df.groupBy(*[col(k) for k in keys]).agg(F.min(ROW_ID).alias(ROW_ID)).select(ROW_ID, *keys)


def _with_first(df: DataFrame) -> DataFrame:
    keys = _keys(df)
    firsts = row_counts(df).select(*keys, "__first", "__count")
    return _null_safe_join(df, firsts, keys)


def deleted_duplicates(df: DataFrame) -> DataFrame:
    """Rows removed by :func:`drop_duplicates` (with their row_id)."""
    return _with_first(df).where(F.col(ROW_ID) != F.col("__first")).drop("__first", "__count")


def unique_deleted(df: DataFrame) -> DataFrame:
    """First deleted row of every distinct duplicated row."""
    keys = _keys(df)
    return (deleted_duplicates(df).groupBy(*[col(k) for k in keys]).agg(F.min(ROW_ID).alias(ROW_ID))
            .select(ROW_ID, *keys))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """One row per member of a duplicated group: the kept row_id of its
    group, its own row_id and whether it is the kept one.  (A tidy form of
    the reference's kept/removed lists, so no group is ever gathered into
    one row.)"""
    keys = _keys(df)
    w = _with_first(df).where(F.col("__count") > 1)
    return w.select(F.col("__first").alias("kept_row_id"), ROW_ID, (F.col(ROW_ID) == F.col("__first")).alias("is_kept"),
                    *keys, F.col("__count").alias("group_size"))


def drop_sparse_columns(df: DataFrame, share: float = DROP_COLUMN_SHARE) -> DataFrame:
    """Keep columns with at least ``share`` of non-null values."""
    keys = _keys(df)
    r = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col(k)).alias(f"c{i}") for i, k in enumerate(keys)]).first()
    keep = [k for i, k in enumerate(keys) if r[f"c{i}"] >= share * r["__n"]]
    return df.select(*([ROW_ID] if ROW_ID in df.columns else []), *[col(k) for k in keep])


def fill_positional(df: DataFrame, interpolate: list[str], forward: list[str] = (), bucket_rows: int = DEFAULT_BUCKET_ROWS,
                    dense_positions: bool = False) -> DataFrame:
    """Linear interpolation and forward fill by position, all columns in one
    pass.  Interpolation goes forward only: leading nulls stay, trailing
    nulls take the last value.  Positions are row_ids; with
    ``dense_positions`` (rows were deleted before) they are re-numbered
    0..n-1 first, once, as pandas interpolates on the current positions."""
    if not interpolate and not forward:
        return df
    base = df
    if dense_positions:
        # row_id is unique: no tie-break columns in the sort
        base = (with_row_index(df, [ROW_ID], name="__pos", tie_break=False)
                .withColumnRenamed(ROW_ID, "__rid").withColumnRenamed("__pos", ROW_ID))
    p = F.col(ROW_ID).cast("double")
    values = {}
    for i, c in enumerate(interpolate):
        x = col(c).cast("double")
        values[f"__i{i}"] = F.when(x.isNotNull(), F.struct(p.alias("p"), x.alias("v")))
    out = scan_neighbors(base, values, bucket_rows) if values else base
    if forward:
        out = scan_neighbors(out, {f"__f{i}": col(c) for i, c in enumerate(forward)}, bucket_rows, following=False)
    exprs = {}
    for i, c in enumerate(interpolate):
        x, before, after = col(c).cast("double"), F.col(f"__i{i}__prev"), F.col(f"__i{i}__next")
        slope = (after.v - before.v) / (after.p - before.p)
        exprs[c] = F.when(x.isNotNull(), x).when(before.isNull(), F.lit(None)) \
            .when(after.isNull(), before.v).otherwise(slope * (p - before.p) + before.v)
    exprs |= {c: F.col(f"__f{i}__prev") for i, c in enumerate(forward)}
    out = out.withColumns(exprs)
    if dense_positions:
        out = out.drop(ROW_ID).withColumnRenamed("__rid", ROW_ID)
    return out.select(*[col(c) for c in df.columns])


def fill_interpolate(df: DataFrame, c: str, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                     dense_positions: bool = False) -> DataFrame:
    """:func:`fill_positional` for one interpolated column."""
    return fill_positional(df, [c], [], bucket_rows, dense_positions)


def fill_mean(df: DataFrame, c: str) -> DataFrame:
    """Missing values (null and NaN) become the mean of the others."""
    df = without_nan(df, [c])
    mean = df.agg(F.avg(col(c))).first()[0]
    return fill_value(df, c, mean)


def fill_value(df: DataFrame, c: str, value) -> DataFrame:
    dt = df.schema[c].dataType
    target = T.DoubleType() if is_numeric(dt) and value is not None and isinstance(value, float) else dt
    return df.withColumn(c, F.coalesce(col(c).cast(target), F.lit(value).cast(target)))


def drop_null_rows(df: DataFrame, c: str) -> DataFrame:
    return without_nan(df, [c]).where(col(c).isNotNull())


def fill_mode(df: DataFrame, c: str, unknown: str | None = UNKNOWN_TEXT) -> DataFrame:
    """Most frequent value (smallest on ties); ``unknown`` for text columns
    without any value."""
    df = without_nan(df, [c])
    mode = column_modes(df, [c])[c]
    if mode is None:
        if isinstance(df.schema[c].dataType, T.StringType) and unknown is not None:
            return fill_value(df, c, unknown)
        return df
    return fill_value(df, c, mode)


def fill_forward(df: DataFrame, c: str, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Forward fill by position (previous non-null value)."""
    return scan_last(df, col(c), "__ff", bucket_rows).withColumn(c, F.col("__ff")).drop("__ff").select(*df.columns)


def clean_missing(df: DataFrame, share: float = DROP_COLUMN_SHARE, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """The reference's per-column missing-value policy, in column order.

    Ratios use the original row count; null counts, means and modes are
    taken on the rows left at that column's turn.  Fills never change the
    row set, so one aggregate (null counts + means) and one mode job serve
    every column up to the next row deletion ("stage"), and one positional
    pass fills all its interpolated columns; after a deletion the rest is
    re-aggregated on the rows left.  The plan grows with the number of
    columns, not with its power.  NaN is missing, that is null.
    """
    df = without_nan(df)
    keys = _keys(df)
    r0 = df.agg(F.count(F.lit(1)).alias("__n"), F.min(ROW_ID).alias("__lo"), F.max(ROW_ID).alias("__hi"),
                *[F.count(col(k)).alias(f"c{i}") for i, k in enumerate(keys)]).first()
    n_rows = r0["__n"]
    keep = [k for i, k in enumerate(keys) if r0[f"c{i}"] >= share * n_rows]
    cur = df.select(*([ROW_ID] if ROW_ID in df.columns else []), *[col(k) for k in keep])
    # positions are the current row order: row_ids with gaps are renumbered
    deleted = bool(n_rows) and (r0["__hi"] - r0["__lo"] + 1 != n_rows)
    i = 0
    while i < len(keep):
        rest = keep[i:]
        types = {c: cur.schema[c].dataType for c in rest}
        r = cur.agg(*[F.count_if(col(c).isNull()).alias(f"n{j}") for j, c in enumerate(rest)],
                    *[F.avg(col(c)).alias(f"m{j}") for j, c in enumerate(rest) if is_numeric(types[c])]).first()
        interpolate, by_mode, values, stop = [], [], {}, None
        for j, c in enumerate(rest):
            ratio = r[f"n{j}"] / n_rows if n_rows else 0.0
            i += 1
            if ratio == 0:
                continue
            dt = types[c]
            if is_numeric(dt) and ratio < INTERPOLATE_BELOW:
                interpolate.append(c)
            elif is_numeric(dt) and ratio < MEAN_BELOW:
                values[c] = r[f"m{j}"]
            elif is_temporal(dt) or not is_numeric(dt) and ratio < TEXT_MODE_BELOW:
                by_mode.append(c)
            else:
                stop = c
                break
        modes = column_modes(cur, by_mode) if by_mode else {}
        forward = [c for c in by_mode if modes[c] is None and is_temporal(types[c])]
        values |= {c: UNKNOWN_TEXT if modes[c] is None else modes[c] for c in by_mode if c not in forward}
        cur = fill_positional(cur, interpolate, forward, bucket_rows, dense_positions=deleted)
        for c, v in values.items():
            cur = fill_value(cur, c, v)
        if stop:
            cur = drop_null_rows(cur, stop)
            deleted = True
            if i < len(keep):
                # the next stage scans its input several times: cut the plan here
                cur = materialize(cur)
    return cur


def cleaning_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before/after, removed columns, and columns whose
    nulls (NaN is one) were all filled."""
    before, after = without_nan(before), without_nan(after)
    kb, ka = _keys(before), _keys(after)
    removed = [c for c in kb if c not in ka]
    nb = before.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"x{i}") for i, c in enumerate(kb)])
    na = after.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"x{i}") for i, c in enumerate(ka)])
    rb, ra = nb.first(), na.first()
    filled = [c for i, c in enumerate(ka) if c in kb and rb[f"x{kb.index(c)}"] > 0 and ra[f"x{i}"] == 0]
    return before.sparkSession.createDataFrame(
        [(rb["n"], ra["n"], len(kb), len(ka), ", ".join(removed), ", ".join(filled))],
        "rows_before long, rows_after long, columns_before long, columns_after long, "
        "removed_columns string, filled_columns string")


def _outlier_flag(df: DataFrame, fences: dict) -> F.Column:
    conds = []
    for c, (_q1, _q2, _q3, lo, hi) in fences.items():
        if lo is None:
            continue
        x = col(c).cast("double")
        conds.append(F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False)))
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def outlier_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows outside the 1.5 IQR fence in any numeric column.  NaN is missing,
    that is null, in this and the following operators: never an outlier."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    return df.where(_outlier_flag(df, quartile_fences(df, cols)))


def remove_outlier_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    return df.where(~_outlier_flag(df, quartile_fences(df, cols)))


def winsorize(df: DataFrame, cols: list[str] | None = None, fences: dict | None = None) -> DataFrame:
    """Clip every numeric column to its fence (``fences`` when they are known
    already); nulls stay null."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    fences = fences or quartile_fences(df, cols)
    exprs = {}
    for c in cols:
        _q1, _q2, _q3, lo, hi = fences[c]
        if lo is None:
            continue
        x = col(c)
        exprs[c] = (F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi))
                    .otherwise(x.cast("double")))
    return df.withColumns(exprs) if exprs else df


def treat_outliers(df: DataFrame, share: float = OUTLIER_SHARE,
                   cols: list[str] | None = None) -> tuple[DataFrame, str]:
    """Delete outlier rows when they are at most ``share`` of all rows,
    else winsorise.  Returns the frame and the method used."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    fences = quartile_fences(df, cols)
    flag = _outlier_flag(df, fences)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("k")).first()
    ratio = r["k"] / r["n"] if r["n"] else 0.0
    if ratio > share:
        return winsorize(df, cols, fences), "Winsorisation"
    return df.where(~flag), "Suppression"


def preprocess_full(df: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> tuple[DataFrame, str]:
    """Duplicates -> missing values -> outliers."""
    dedup = materialize(drop_duplicates(df))
    # the fences take several scans: they read the cleaned rows, not their plan
    cleaned = materialize(clean_missing(dedup, bucket_rows=bucket_rows))
    return treat_outliers(cleaned)
