"""Dataset information: shape, types, column roles, nulls, duplicates.

All per-column numbers come from one aggregate over the table, turned into
one row per column with ``inline`` (lazy, never collected).  Duplicate
detection groups on all data columns with map-side combine; consecutive
runs compare each row with its predecessor by ``lag`` inside fixed-size
row_id buckets (plus a one-row-per-bucket carry) and a two-level scan, so no
window ever spans the table and a value repeated in a third of all rows is
spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.dates import DATE_SHARE_FOR_CATEGORY, parse_any
from tabsense.functions.numeric import col
from tabsense.functions.schema import (ROW_ID, data_fields, is_numeric, is_temporal, storage_type, without_nan)
from tabsense.operators.rows import DEFAULT_BUCKET_ROWS, scan_last

#: Rows that a task of the duplicate summary sorts at most, nearly.
TASK_ROWS = 1_000_000


def shape(df: DataFrame) -> DataFrame:
    """rows, columns and the column names (row_id excluded)."""
    names = [f.name for f in data_fields(df)]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(names)).cast("long").alias("columns"),
        F.lit(", ".join(names)).alias("column_names"))


def dtypes(df: DataFrame) -> DataFrame:
    """(ordinal, column, dtype, storage_type) from the schema."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), storage_type(f.dataType))
            for i, f in enumerate(data_fields(df))]
    return spark.createDataFrame(rows, "ordinal long, column string, dtype string, storage_type string")


def column_categories(df: DataFrame, share: float = DATE_SHARE_FOR_CATEGORY) -> DataFrame:
    """numeric by type, date by type or when >= ``share`` of *all* rows
    parse as a date, boolean on its own, else text.  One aggregate for the
    parse rates of every text column."""
    fields = data_fields(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.count(parse_any(col(f.name))).alias(f"p{i}"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"p{i}"))
    rate = df.agg(*aggs)
    items = []
    for i, f in enumerate(fields):
        if is_numeric(f.dataType):
            cat = F.lit("numeric")
        elif is_temporal(f.dataType):
            cat = F.lit("date")
        elif isinstance(f.dataType, T.BooleanType):
            cat = F.lit("boolean")
        else:
            cat = F.when((F.col("__n") > 0) & (F.col(f"p{i}") >= F.lit(share) * F.col("__n")),
                         F.lit("date")).otherwise(F.lit("text"))
        items.append(F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(f.name).alias("column"),
                              cat.alias("category")))
    return rate.select(F.inline(F.array(*items)))


def categories_of(df: DataFrame) -> dict[str, list[str]]:
    """Column roles as lists (bounded: one entry per column)."""
    out: dict[str, list[str]] = {"numeric": [], "date": [], "text": [], "boolean": []}
    for r in column_categories(df).orderBy("ordinal").collect():
        out[r["category"]].append(r["column"])
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: null count (NaN is missing, too) and percentage of all rows (2 dp)."""
    df = without_nan(df)
    fields = data_fields(df)
    counts = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.count_if(col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    items = [F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(f.name).alias("column"),
                      F.col(f"n{i}").alias("null_count"))
             for i, f in enumerate(fields)]
    return counts.select("__n", F.inline(F.array(*items))).select(
        "ordinal", "column", "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("__n")), 2).alias("null_pct"))


def null_summary(df: DataFrame) -> DataFrame:
    """Number of columns with and without nulls."""
    return null_profile(df).agg(
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        F.count_if(F.col("null_count") == 0).alias("columns_without_nulls"))


def head_tail(df: DataFrame, n: int = 5) -> DataFrame:
    """First and last ``n`` rows by position (two top-k, not a sort)."""
    head = df.orderBy(F.col(ROW_ID)).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.col(ROW_ID).desc()).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def preview(df: DataFrame, n: int = 3000) -> DataFrame:
    """First ``n`` rows by position (the 3000-row table of the reference)."""
    return df.orderBy(F.col(ROW_ID)).limit(n)


def preview_json(df: DataFrame, n: int = 3000) -> DataFrame:
    """One row: the table's rows and columns, and its first ``n`` rows by position as a JSON array of records (nulls
    included)."""
    names = [f.name for f in data_fields(df)]
    first = preview(df, n).select(ROW_ID, F.to_json(F.struct(*[col(c) for c in names]), {"ignoreNullFields": "false"}).alias("j"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(ROW_ID, "j"))), lambda x: x["j"])  # n rows at most
    body = first.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("first_rows"))
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("__one", F.lit(1)).join(body.withColumn("__one", F.lit(1)), "__one").select(
        "n_rows", F.lit(len(names)).cast("long").alias("n_columns"), "first_rows")


def _keys(df: DataFrame) -> list[str]:
    return [f.name for f in data_fields(df)]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[col(k).alias("__r_" + k) for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col("`__r_" + k + "`")) for k in keys])
    out = left.join(r, cond, how)
    return out.drop(*["__r_" + k for k in keys]) if how not in ("left_anti", "left_semi") else out


def row_counts(df: DataFrame) -> DataFrame:
    """Occurrences of every distinct row (nulls equal), with the first row_id."""
    keys = _keys(df)
    return df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__count"), F.min(ROW_ID).alias("__first"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once (pandas ``duplicated(keep=False)``)."""
    keys = _keys(df)
    dup = row_counts(df).where(F.col("__count") > 1).select(*keys, "__count")
    return _null_safe_join(df, dup, keys).drop("__count")


def _runs(df: DataFrame, bucket_rows: int) -> DataFrame:
    """Label every row with the row_id of its run start; a row continues a
    run when it equals the previous row in every column (a null never does).

    The previous row comes from ``lag`` inside fixed-size row_id buckets; the
    first row of a bucket takes the last row of the previous non-empty bucket
    from a carry table (one row per bucket).  No self-join of the data, and
    gaps in row_id (deleted rows) are skipped like pandas positions."""
    keys = _keys(df)
    row = F.struct(*[col(k).alias(k) for k in keys])
    base = df.withColumn("__b", F.floor(F.col(ROW_ID) / F.lit(bucket_rows)).cast("long"))
    last_rows = base.groupBy("__b").agg(F.max_by(row, F.col(ROW_ID)).alias("__lr"))
    carry = last_rows.select("__b", F.lag("__lr").over(Window.orderBy("__b")).alias("__cp"))
    w = Window.partitionBy("__b").orderBy(ROW_ID)
    x = base.withColumn("__p", F.lag(row).over(w)).join(carry, "__b", "left")
    prev = F.coalesce(F.col("__p"), F.col("__cp"))
    same = reduce(lambda a, b: a & b, [F.coalesce(col(k) == prev[k], F.lit(False)) for k in keys])
    flagged = x.withColumn("__same", same).drop("__p", "__cp", "__b")
    start = F.when(~F.col("__same"), F.col(ROW_ID))
    return scan_last(flagged, start, "__run", bucket_rows)


def duplicate_runs(df: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                   labelled: DataFrame | None = None) -> DataFrame:
    """Consecutive equal rows: first row of each run + ``count_in_group``."""
    keys = _keys(df)
    labelled = labelled if labelled is not None else _runs(df, bucket_rows)
    sizes = labelled.groupBy("__run").agg(F.count(F.lit(1)).alias("count_in_group")) \
        .where(F.col("count_in_group") > 1)
    first = labelled.where(F.col(ROW_ID) == F.col("__run"))
    return first.join(sizes, "__run").select(ROW_ID, *keys, F.col("count_in_group").cast("long"))


def duplicate_scattered(df: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                        labelled: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Duplicated rows that are not part of a consecutive run, one per
    distinct row (first occurrence), with the true total count."""
    keys = _keys(df)
    labelled = labelled if labelled is not None else _runs(df, bucket_rows)
    sizes = labelled.groupBy("__run").agg(F.count(F.lit(1)).alias("__size"))
    in_run = labelled.join(sizes.where(F.col("__size") > 1), "__run", "left_semi").select(ROW_ID)
    counts = counts if counts is not None else row_counts(df)
    dup_keys = counts.where(F.col("__count") > 1).select(*keys, "__count")
    dups = _null_safe_join(df, dup_keys, keys).drop("__count").join(in_run, ROW_ID, "left_anti")
    firsts = dups.groupBy(*[col(k) for k in keys]).agg(F.min(ROW_ID).alias(ROW_ID))
    totals = counts.select(*keys, F.col("__count").alias("count_duplicates"))
    return _null_safe_join(firsts, totals, keys).select(ROW_ID, *keys, "count_duplicates")


def _beside(df: DataFrame, bucket_rows: int) -> DataFrame:
    """``__same``: whether a row continues the run of the row before it, ``__next``: whether the row after continues its
    own.  One window over buckets of row_id, dealt to so many tasks that each holds at most ``TASK_ROWS`` rows, and the
    rows at both ends of every bucket as carry table."""
    keys = _keys(df)
    row = F.struct(*[col(k).alias(k) for k in keys])
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    base = df.withColumn("__b", F.floor(F.col(ROW_ID) / F.lit(bucket_rows)).cast("long"))
    ends = base.groupBy("__b").agg(F.max_by(row, F.col(ROW_ID)).alias("__last"), F.min_by(row, F.col(ROW_ID)).alias("__first"))
    order = Window.orderBy("__b")
    carry = ends.select("__b", F.lag("__last").over(order).alias("__before"), F.lead("__first").over(order).alias("__after"))
    w = Window.partitionBy("__b").orderBy(ROW_ID)
    x = (base.repartition(tasks, "__b").withColumn("__p", F.lag(row).over(w)).withColumn("__f", F.lead(row).over(w)).join(carry, "__b", "left"))

    def equal(other: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(col(k) == other[k], F.lit(False)) for k in keys])

    return x.select(*[col(k) for k in keys], equal(F.coalesce("__p", "__before")).alias("__same"), equal(F.coalesce("__f", "__after")).alias("__next"))


def duplicate_summary(df: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Run groups, rows inside runs, scattered distinct rows (with an
    occurrence outside any run), all duplicated rows: whether the neighbours of
    every row equal it gives all four numbers, without a group a run."""
    keys = [col(k) for k in _keys(df)]
    same, following = F.col("__same"), F.col("__next")
    rows = _beside(df, bucket_rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__total"), F.count_if(~same & following).alias("__runs"),
        F.count_if(same | following).alias("__in"), F.count_if(~same & ~following).alias("__alone"))
    return rows.agg(F.coalesce(F.sum("__runs"), F.lit(0)).cast("long").alias("run_groups"),
                    F.coalesce(F.sum("__in"), F.lit(0)).cast("long").alias("rows_in_runs"),
                    F.count_if((F.col("__total") > 1) & (F.col("__alone") > 0)).alias("scattered_rows"),
                    F.coalesce(F.sum(F.when(F.col("__total") > 1, F.col("__total"))), F.lit(0)).cast("long").alias("duplicated_rows"))
