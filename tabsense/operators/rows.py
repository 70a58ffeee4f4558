"""Positional semantics without a global window.

The reference relies on an implicit positional index (pandas).  Here the
position is an explicit ``row_id`` column created once by
:func:`with_row_index` and kept through every operator.  Order-dependent
operators (forward fill, interpolation, consecutive runs) use a two-level
scan: windows inside fixed-size ``row_id`` buckets plus a small per-bucket
carry table.  Buckets hold ``bucket_rows`` consecutive ids, so the work is
spread evenly whatever the data values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.schema import ROW_ID, q
from tabsense.session import checkpoint_dir, materialize

DEFAULT_BUCKET_ROWS = 1 << 20


def with_row_index(df: DataFrame, order_cols: list[str], num_partitions: int | None = None,
                   name: str = ROW_ID, tie_break: bool = True) -> DataFrame:
    """Add a dense 0-based ``row_id`` following ``order_cols``.  With
    ``tie_break`` the remaining (orderable) columns break ties, so the
    numbering is deterministic whenever rows are distinct.

    Range-partition + local sort, then a per-partition offset from a table
    with one row per partition (broadcast).  Equivalent to
    ``row_number() OVER (ORDER BY order_cols) - 1`` without pulling every
    row through a single task.

    The range bounds come from sampling and are not guaranteed to repeat
    when the plan is evaluated again, so the range-partitioned data is
    written once as Parquet under ``spark.checkpoint.dir`` (shared storage):
    the partition sizes and the rows are then read from the same files,
    and a lost executor cannot renumber rows.  The index is meant to be
    made once when a dataset is imported and kept from then on.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = []
    if tie_break:
        from pyspark.sql import types as T
        extra = [f.name for f in df.schema.fields if f.name not in order_cols
                 and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    keys = [F.col(q(c)) for c in list(order_cols) + extra]
    ordered = materialize(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        # monotonically_increasing_id = (partition << 33) + position
        .withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "rowindex")
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    out = (ordered.join(F.broadcast(offsets), "__pid")
           .withColumn(name, (F.col("__off") + F.col("__local")).cast("long"))
           .drop("__pid", "__local", "__off"))
    return out.select(name, *[c for c in out.columns if c != name])


def _bucket(bucket_rows: int) -> Column:
    return F.floor(F.col(ROW_ID) / F.lit(bucket_rows)).cast("long")


def scan_last(df: DataFrame, value: Column, out: str, bucket_rows: int = DEFAULT_BUCKET_ROWS,
              forward: bool = True) -> DataFrame:
    """For each row, the last non-null ``value`` at a row_id <= own
    (``forward``) or the first non-null at a row_id >= own (backward).

    Level 1: window inside each bucket.  Level 2: a carry table with one
    row per bucket (last/first non-null of the bucket) scanned over
    buckets; it has ``rows / bucket_rows`` rows and is joined back (AQE
    broadcasts it when its measured size allows).  ``value`` may be a
    struct to carry several fields.
    """
    b = "__bucket"
    v = "__scan_v"
    base = df.withColumn(b, _bucket(bucket_rows)).withColumn(v, value)
    if forward:
        w = Window.partitionBy(b).orderBy(ROW_ID).rowsBetween(Window.unboundedPreceding, 0)
        inner = F.last(v, ignorenulls=True).over(w)
        edge = F.max_by(v, F.when(F.col(v).isNotNull(), F.col(ROW_ID)))
        wc = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        carry_expr = F.last("__edge", ignorenulls=True).over(wc)
    else:
        # "first non-null at or after" == "last non-null at or before" in
        # descending order; frames that start at the current row and end at
        # the partition end are recomputed per row in Spark (quadratic)
        w = Window.partitionBy(b).orderBy(F.col(ROW_ID).desc()).rowsBetween(Window.unboundedPreceding, 0)
        inner = F.last(v, ignorenulls=True).over(w)
        edge = F.min_by(v, F.when(F.col(v).isNotNull(), F.col(ROW_ID)))
        wc = Window.orderBy(F.col(b).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry_expr = F.last("__edge", ignorenulls=True).over(wc)
    carry = (base.groupBy(b).agg(edge.alias("__edge"))
             .select(b, carry_expr.alias("__carry")))
    # the carry table has rows / bucket_rows rows; AQE broadcasts it when its
    # runtime size is under the broadcast threshold, else it is a shuffle join
    res = (base.withColumn("__inner", inner)
           .join(carry, b, "left")
           .withColumn(out, F.coalesce(F.col("__inner"), F.col("__carry")))
           .drop(b, v, "__inner", "__carry"))
    return res


def scan_neighbors(df: DataFrame, values: dict[str, Column], bucket_rows: int = DEFAULT_BUCKET_ROWS,
                   following: bool = True) -> DataFrame:
    """For every entry ``name: value`` the previous (row_id <= own) non-null
    value as ``name__prev`` and, with ``following``, the next (row_id >= own)
    as ``name__next``.

    One pass for all entries: every window shares the bucket partitioning,
    and one carry table (a struct per bucket and entry) is joined once, so
    the plan holds the input twice whatever the number of entries."""
    b, names = "__bucket", list(values)
    base = df.withColumn(b, _bucket(bucket_rows)).withColumns({f"__v{i}": values[n] for i, n in enumerate(names)})
    up, down = Window.partitionBy(b).orderBy(ROW_ID), Window.partitionBy(b).orderBy(F.col(ROW_ID).desc())
    sides = [("prev", up, F.max_by, Window.orderBy(b))]
    if following:
        # descending order keeps the frame running (O(n)); see scan_last
        sides.append(("next", down, F.min_by, Window.orderBy(F.col(b).desc())))
    ids = range(len(names))
    inner = {f"__{side}{i}": F.last(f"__v{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
             for side, w, _, _ in sides for i in ids}
    edges = [by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col(ROW_ID))).alias(f"__edge_{side}{i}")
             for side, _, by, _ in sides for i in ids]
    carried = [F.last(f"__edge_{side}{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__carry_{side}{i}")
               for side, _, _, w in sides for i in ids]
    carry = base.groupBy(b).agg(*edges).select(b, *carried)
    found = [F.coalesce(f"__{side}{i}", f"__carry_{side}{i}").alias(f"{names[i]}__{side}") for side, *_ in sides for i in ids]
    return (base.withColumns(inner).join(carry, b, "left")
            .select(*[F.col(q(c)) for c in df.columns], *found))
