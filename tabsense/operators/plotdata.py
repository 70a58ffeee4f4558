"""The numbers behind each chart (histogram, box, scatter, line, violin,
pair plots, heatmap, bar plot).  Drawing is left to the caller.

Point clouds are never collected.  ``scatter`` and ``line_series`` give every
point; ``scatter_grid`` and ``line_envelope`` give bounded pictures of any
number of points.  Which one is the caller's choice, not the row count's.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.numeric import col, pair_corr
from tabsense.functions.schema import ROW_ID, numeric_cols, without_nan
from tabsense.operators.quantiles import column_modes, column_ranges, exact_quantiles

# Fixed value of the reference's histograms.
HIST_BINS = 30


def numeric_columns(df: DataFrame) -> DataFrame:
    """Projection on the numeric columns shared by all plots (row_id kept)."""
    keep = ([ROW_ID] if ROW_ID in df.columns else []) + numeric_cols(df)
    return df.select(*[col(c) for c in keep])


def _edges(mn: float, mx: float) -> tuple[float, float]:
    # numpy: an empty range is widened by 0.5 on each side
    return (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)


def _bin_expr(x, lo: float, hi: float, bins: int):
    return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = HIST_BINS,
              ranges: dict | None = None) -> DataFrame:
    """``bins`` equal-width bins from min to max (the max falls in the last
    bin); count and density = count / (n * width) per bin."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    ranges = ranges or column_ranges(df, cols)
    items, meta = [], []
    for c in cols:
        n, mn, mx = ranges[c]
        if not n:
            continue
        lo, hi = _edges(mn, mx)
        x = col(c).cast("double")
        items.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column"),
                                                    _bin_expr(x, lo, hi, bins).alias("bin"))))
        meta.append((c, lo, hi, n))
    spark = df.sparkSession
    schema = "column string, bin long, bin_lo double, bin_hi double, count long, density double"
    if not items:
        return spark.createDataFrame([], schema)
    counts = (df.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
              .groupBy("s.column", "s.bin").agg(F.count(F.lit(1)).alias("count")))
    # the full grid of bins first: an empty bin counts 0
    info = spark.createDataFrame(meta, "column string, lo double, hi double, n long")
    grid = info.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    w = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return (grid.join(counts, ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
            .select("column", "bin",
                    (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
            "count", (F.col("count") / (F.col("n") * w)).alias("density")))


def histogram_markers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """mean, median, std, Q1, Q3 and mode per column, rounded to 2 dp."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    modes = column_modes(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        q1, q2, q3 = qs[c]
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}")]
        for name, v in (("median", q2), ("q1", q1), ("q3", q3),
                        ("mode", float(modes[c]) if modes[c] is not None else None)):
            aggs.append(F.lit(v).cast("double").alias(f"{name}{i}"))
    agg = df.agg(*aggs)
    metrics = ["mean", "median", "std", "q1", "q3", "mode"]
    items = [F.struct(F.lit(c).alias("column"), *[F.round(F.col(f"{m}{i}"), 2).alias(m) for m in metrics])
             for i, c in enumerate(cols)]
    return agg.select(F.inline(F.array(*items)))


def box_stats(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Q1, median, Q3, IQR and whiskers clipped to the data range."""
    cols = cols if cols is not None else numeric_cols(df)
    ranges = column_ranges(df, cols)
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], ranges)
    rows = []
    for c in cols:
        n, mn, mx = ranges[c]
        q1, q2, q3 = qs[c]
        if not n:
            rows.append((c, None, None, None, None, None, None))
            continue
        iqr = q3 - q1
        rows.append((c, q1, q2, q3, iqr, max(mn, q1 - whisker * iqr), min(mx, q3 + whisker * iqr)))
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, iqr double, lower double, upper double")


def box_outliers(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Values outside the whiskers, as (row_id, column, value)."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    fences = {r["column"]: (r["lower"], r["upper"]) for r in box_stats(df, cols, whisker).collect()}
    items = []
    for c in cols:
        lo, hi = fences[c]
        if lo is None:
            continue
        x = col(c).cast("double")
        items.append(F.when((x < F.lit(lo)) | (x > F.lit(hi)),
                            F.struct(F.lit(c).alias("column"), x.alias("value"))))
    if not items:
        return df.sparkSession.createDataFrame([], "row_id long, column string, value double")
    return (df.select(ROW_ID, F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
            .select(ROW_ID, "s.column", "s.value"))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair (pairwise complete, null where a side
    is constant), from one scan whatever the number of columns."""
    from tabsense.operators.decomposition import correlations
    cols = cols if cols is not None else numeric_cols(df)
    r = correlations(df, cols)
    rows = [(a, b, None if math.isnan(r[i, j]) else 1.0 if i == j else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, corr double")


def high_correlations(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.6) -> DataFrame:
    """Distinct pairs with |r| >= threshold, r rounded to 2 dp."""
    cm = correlation_matrix(df, cols)
    order = {c: i for i, c in enumerate(cols if cols is not None else numeric_cols(df))}
    rank = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return (cm.where((rank[F.col("column_a")] < rank[F.col("column_b")]) & (F.abs("corr") >= threshold))
            .select("column_a", "column_b", F.round("corr", 2).alias("corr")))


def bar_means(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Column means, largest first (rank 1 = largest, ties by name; columns
    without values last)."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    agg = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    means = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"))
                                          for i, c in enumerate(cols)])))
    order = [F.desc_nulls_last("mean"), F.col("column")]
    # one row a column
    return means.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("rank")


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept and Pearson r on complete pairs."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    xx, yy = col(x).cast("double"), col(y).cast("double")
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.try_divide(F.covar_pop(xx, yy), F.var_pop(xx)).alias("slope"),
                    pair_corr(x, y).alias("r"),
                    F.avg(xx).alias("__mx"), F.avg(yy).alias("__my")) \
        .select("n", "slope", (F.col("__my") - F.col("slope") * F.col("__mx")).alias("intercept"), "r")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete (x, y) points."""
    return df.where(col(x).isNotNull() & col(y).isNotNull()).select(
        col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def scatter_grid(df: DataFrame, x: str, y: str, grid: int = 200) -> DataFrame:
    """Complete points counted in a ``grid`` x ``grid`` raster (cell centres and
    counts): a bounded picture of any number of points."""
    ranges = column_ranges(scatter(df, x, y), ["x", "y"])
    if not ranges["x"][0]:
        return df.sparkSession.createDataFrame([], "x double, y double, count long")
    return grid_counts(df, x, y, _edges(*ranges["x"][1:]), _edges(*ranges["y"][1:]), grid).select(
        F.col("cx").alias("x"), F.col("cy").alias("y"), "count")


def grid_counts(df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float],
                grid: int) -> DataFrame:
    bx = _bin_expr(col(x).cast("double"), xr[0], xr[1], grid)
    by = _bin_expr(col(y).cast("double"), yr[0], yr[1], grid)
    wx, wy = (xr[1] - xr[0]) / grid, (yr[1] - yr[0]) / grid
    return (df.where(col(x).isNotNull() & col(y).isNotNull())
            .groupBy(bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("count"))
            .select("bx", "by", (F.lit(xr[0]) + (F.col("bx") + 0.5) * wx).alias("cx"),
                    (F.lit(yr[0]) + (F.col("by") + 0.5) * wy).alias("cy"), "count"))


def line_series(df: DataFrame, c: str) -> DataFrame:
    """Value by position, every row."""
    return df.select(ROW_ID, col(c).cast("double").alias("value"))


def line_envelope(df: DataFrame, c: str, width: int) -> DataFrame:
    """Min, max and mean per ``width`` positions: the envelope of a line of any
    length."""
    b = F.floor(F.col(ROW_ID) / width).cast("long")
    return (df.groupBy(b.alias("bucket"))
            .agg(F.min(ROW_ID).alias(ROW_ID), F.min(col(c)).cast("double").alias("min"),
                 F.max(col(c)).cast("double").alias("max"), F.avg(col(c)).alias("value")))


def line_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """mean, median and std shown beside each line plot."""
    cols = cols if cols is not None else numeric_cols(df)
    qs = exact_quantiles(df, cols, [0.5])
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(col(c)).alias(f"mean{i}"), F.lit(qs[c][0]).cast("double").alias(f"median{i}"),
        F.stddev_samp(col(c)).alias(f"std{i}"))])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"mean{i}").alias("mean"),
                                                   F.col(f"median{i}").alias("median"),
                                                   F.col(f"std{i}").alias("std"))
                                         for i, c in enumerate(cols)])))


# Our own parameters: cells the values are binned to before the kernel sum,
# and grid points of the density curve.
KDE_CELLS = 2048
KDE_POINTS = 200


def kde(df: DataFrame, cols: list[str] | None = None, cells: int = KDE_CELLS,
        points: int = KDE_POINTS) -> DataFrame:
    """Gaussian density curve (Scott bandwidth ``n^(-1/5) * std``) on
    ``points`` grid points from min - 3h to max + 3h.  Values are first
    binned to ``cells`` cells (weight = count at the cell centre) in one
    scan for all columns, so the kernel sum costs cells x points per column
    whatever the row count."""
    cols = cols if cols is not None else numeric_cols(df)
    df = without_nan(df, cols)
    spark = df.sparkSession
    ranges = column_ranges(df, cols)
    stds = df.agg(*[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    params, items = [], []
    for i, c in enumerate(cols):
        n, mn, mx = ranges[c]
        sd = stds[f"s{i}"]
        if not n or n < 2 or not sd:
            continue
        h = sd * n ** (-0.2)
        lo, hi = _edges(mn, mx)
        g0, g1 = mn - 3 * h, mx + 3 * h
        params.append((c, float(n), h, lo, (hi - lo) / cells, g0, (g1 - g0) / (points - 1)))
        x = col(c).cast("double")
        items.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column"), _bin_expr(x, lo, hi, cells).alias("cell"))))
    if not items:
        return spark.createDataFrame([], "column string, point long, x double, density double")
    info = spark.createDataFrame(params, "column string, n double, h double, lo double, w double, g0 double, step double")
    binned = (df.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
              .groupBy("s.column", "s.cell").agg(F.count(F.lit(1)).alias("cnt"))
              .join(F.broadcast(info), "column"))
    # every cell (at most ``cells`` per column) contributes to each grid point
    return (binned.select("column", "cnt", "n", "h", "g0", "step",
                          (F.col("lo") + (F.col("cell") + 0.5) * F.col("w")).alias("center"),
                          F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
            .withColumn("x", F.col("g0") + F.col("point").cast("double") * F.col("step"))
            .groupBy("column", "point", "x").agg(
                (F.sum(F.col("cnt") * F.exp(-0.5 * F.pow((F.col("x") - F.col("center")) / F.col("h"), 2)))
                 / (F.first("n") * F.first("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
            .select("column", F.col("point").cast("long").alias("point"), "x", "density"))


def violin(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """KDE curve + mean, median, std, Q1, Q3 per column (tidy: one row per
    grid point with the summary repeated)."""
    cols = cols if cols is not None else numeric_cols(df)
    curve = kde(df, cols)
    marks = histogram_markers(df, cols).select("column", "mean", "median", "std", "q1", "q3")
    return curve.join(F.broadcast(marks), "column")


def pair_two(df: DataFrame, x: str, y: str) -> DataFrame:
    """Scatter of two chosen columns with the KDE of each on the diagonal."""
    pts = scatter(df, x, y).select(F.lit("scatter").alias("kind"), F.lit(None).cast("string").alias("column"),
                                   "x", "y", F.lit(1.0).alias("value"))
    dens = kde(df, [x, y]).select(F.lit("kde").alias("kind"), "column", "x", F.lit(None).cast("double").alias("y"),
                                  F.col("density").alias("value"))
    return pts.unionByName(dens)


def pair_all(df: DataFrame, cols: list[str] | None = None, grid: int = 20) -> DataFrame:
    """Lower triangle of all numeric pairs as grid counts: one scan emits a
    (pair, bx, by) cell per row and pair; output is bounded by pairs x grid^2."""
    cols = cols if cols is not None else numeric_cols(df)
    ranges = column_ranges(df, cols)
    items = []
    for i, a in enumerate(cols):
        for b in cols[:i]:
            if not ranges[a][0] or not ranges[b][0]:
                continue
            xa, xb = col(a).cast("double"), col(b).cast("double")
            items.append(F.when(xa.isNotNull() & xb.isNotNull(), F.struct(
                F.lit(b).alias("x_column"), F.lit(a).alias("y_column"),
                _bin_expr(xb, *_edges(*ranges[b][1:]), grid).alias("bx"),
                _bin_expr(xa, *_edges(*ranges[a][1:]), grid).alias("by"))))
    if not items:
        return df.sparkSession.createDataFrame([], "x_column string, y_column string, bx long, by long, count long")
    return (df.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
            .groupBy("s.x_column", "s.y_column", "s.bx", "s.by").agg(F.count(F.lit(1)).alias("count")))
