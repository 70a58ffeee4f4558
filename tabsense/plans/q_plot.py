"""Registered queries: plot data."""

from __future__ import annotations

from tabsense.operators import plotdata
from tabsense.plans.fixtures import duck_fixture, fixture
from tabsense.plans.registry import query
from tabsense.plans.sqlgen import corr_sql, qi, union_all
from tabsense.sources.tables import read_table

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
_ML = duck_fixture("fx_ml")
_FEW = duck_fixture("fx_outliers_few")
_M = duck_fixture("fx_missing")


def _mode(src: str, c: str) -> str:
    return f"(SELECT arg_min(v, (-n, v)) FROM (SELECT {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}))"


def _markers_sql(src: str, cols: list[str]) -> str:
    return union_all([
        f"SELECT '{c}' AS \"column\", round(avg({qi(c)}), 2) AS mean, round(quantile_cont({qi(c)}, 0.5), 2) AS median, "
        f"round(stddev_samp({qi(c)}), 2) AS std, round(quantile_cont({qi(c)}, 0.25), 2) AS q1, "
        f"round(quantile_cont({qi(c)}, 0.75), 2) AS q3, round(CAST({_mode(src, qi(c))} AS DOUBLE), 2) AS mode FROM {src}"
        for c in cols])


@query("histogram_markers", oracle=_markers_sql("lineitem", LI_NUM),
       floats=("mean", "median", "std", "q1", "q3", "mode"))
def q_histogram_markers(spark, d):
    return plotdata.histogram_markers(read_table(spark, d, "lineitem"))


def _kde_sql(src: str, c: str, cells: int = 2048, points: int = 200) -> str:
    return f"""(WITH r AS (SELECT count({c}) AS n, min({c}) AS mn, max({c}) AS mx, stddev_samp({c}) AS sd FROM {src}),
p AS (SELECT n, mn, mx, sd * pow(n, -0.2) AS h, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
      CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r),
cells AS (SELECT CAST(least(floor((CAST({c} AS DOUBLE) - p.lo) / (p.hi - p.lo) * {cells}), {cells - 1}) AS BIGINT) AS cell,
          count(*) AS w FROM {src}, p WHERE {c} IS NOT NULL GROUP BY ALL),
grid AS (SELECT range AS point, (p.mn - 3 * p.h) + CAST(range AS DOUBLE) * (((p.mx + 3 * p.h) - (p.mn - 3 * p.h)) / {points - 1}) AS x
         FROM range({points}), p)
SELECT '{c}' AS "column", CAST(grid.point AS BIGINT) AS point, grid.x,
  sum(cells.w * exp(-0.5 * pow((grid.x - (p.lo + (cells.cell + 0.5) * ((p.hi - p.lo) / {cells}))) / p.h, 2)))
  / (max(p.n) * max(p.h) * sqrt(2 * pi())) AS density
FROM grid, cells, p GROUP BY grid.point, grid.x)"""


@query("kde", oracle=union_all([f"SELECT * FROM {_kde_sql(_ML, c)}" for c in ["price", "bal"]]),
       floats=("x", "density"))
def q_kde(spark, d):
    return plotdata.kde(fixture(spark, d, "fx_ml"), ["price", "bal"])


_Q = "quantile_cont({c}, {p})"


def _box_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        q1, q2, q3 = (_Q.format(c=c, p=p) for p in (0.25, 0.5, 0.75))
        parts.append(f"SELECT '{c}' AS \"column\", {q1} AS q1, {q2} AS median, {q3} AS q3, {q3} - {q1} AS iqr, "
                     f"greatest(min({c}), {q1} - 1.5 * ({q3} - {q1})) AS lower, "
                     f"least(max({c}), {q3} + 1.5 * ({q3} - {q1})) AS upper FROM {src}")
    return union_all(parts)


@query("box_stats", oracle=_box_sql(_FEW, ["x", "y"]), floats=("q1", "median", "q3", "iqr", "lower", "upper"))
def q_box_stats(spark, d):
    return plotdata.box_stats(fixture(spark, d, "fx_outliers_few"))


@query("box_outliers", oracle=union_all([
    f"SELECT t.row_id, '{c}' AS \"column\", CAST(t.{c} AS DOUBLE) AS value FROM {_FEW} t, ({_box_sql(_FEW, [c])}) b "
    f"WHERE t.{c} < b.lower OR t.{c} > b.upper" for c in ["x", "y"]]), floats=("value",))
def q_box_outliers(spark, d):
    return plotdata.box_outliers(fixture(spark, d, "fx_outliers_few"))


_SCATTER = f"SELECT price AS x, bal AS y FROM {_ML} WHERE price IS NOT NULL AND bal IS NOT NULL"


@query("scatter", oracle=_SCATTER, floats=("x", "y"))
def q_scatter(spark, d):
    return plotdata.scatter(fixture(spark, d, "fx_ml"), "price", "bal")


@query("regression_line", oracle=f"""
SELECT CAST(count(*) AS BIGINT) AS n, regr_slope(y_reg, price) AS slope, regr_intercept(y_reg, price) AS intercept,
  {corr_sql('price', 'y_reg')} AS r FROM {_ML} WHERE price IS NOT NULL AND y_reg IS NOT NULL""",
       floats=("slope", "intercept", "r"))
def q_regression_line(spark, d):
    return plotdata.regression_line(fixture(spark, d, "fx_ml"), "price", "y_reg")


@query("scatter_grid", oracle=f"""
WITH r AS (SELECT min(price) AS x0, max(price) AS x1, min(bal) AS y0, max(bal) AS y1 FROM {_ML} WHERE price IS NOT NULL AND bal IS NOT NULL),
c AS (SELECT CAST(least(floor((price - x0) / (x1 - x0) * 200), 199) AS BIGINT) AS i,
  CAST(least(floor((bal - y0) / (y1 - y0) * 200), 199) AS BIGINT) AS j, CAST(count(*) AS BIGINT) AS count
  FROM {_ML}, r WHERE price IS NOT NULL AND bal IS NOT NULL GROUP BY ALL)
SELECT x0 + (i + 0.5) * ((x1 - x0) / 200) AS x, y0 + (j + 0.5) * ((y1 - y0) / 200) AS y, count FROM c, r""", floats=("x", "y"))
def q_scatter_grid(spark, d):
    return plotdata.scatter_grid(fixture(spark, d, "fx_ml"), "price", "bal")


@query("line_series", oracle=f"SELECT row_id, CAST(q_interp AS DOUBLE) AS value FROM {_M}", floats=("value",))
def q_line_series(spark, d):
    return plotdata.line_series(fixture(spark, d, "fx_missing"), "q_interp")


@query("line_envelope", oracle=f"""
SELECT CAST(floor(row_id / 6) AS BIGINT) AS bucket, min(row_id) AS row_id, CAST(min(q_interp) AS DOUBLE) AS min,
  CAST(max(q_interp) AS DOUBLE) AS max, avg(q_interp) AS value FROM {_M} GROUP BY ALL""", floats=("min", "max", "value"))
def q_line_envelope(spark, d):
    return plotdata.line_envelope(fixture(spark, d, "fx_missing"), "q_interp", 6)


@query("line_summary", oracle=union_all([
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std FROM {_M}"
    for c in ["q_interp", "p_mean", "t_drop_rows", "d_drop_col"]]), floats=("mean", "median", "std"))
def q_line_summary(spark, d):
    return plotdata.line_summary(fixture(spark, d, "fx_missing"))


@query("violin", oracle=f"""
SELECT k.*, m.mean, m.median, m.std, m.q1, m.q3 FROM ({union_all([f"SELECT * FROM {_kde_sql(_ML, c)}" for c in ["price", "bal"]])}) k
JOIN ({_markers_sql(_ML, ["price", "bal"])}) m ON m."column" = k."column" """,
       floats=("x", "density", "mean", "median", "std", "q1", "q3"))
def q_violin(spark, d):
    return plotdata.violin(fixture(spark, d, "fx_ml"), ["price", "bal"])


@query("pair_two", oracle=f"""
SELECT 'scatter' AS kind, CAST(NULL AS VARCHAR) AS "column", x, y, 1.0 AS value FROM ({_SCATTER})
UNION ALL SELECT 'kde', "column", x, NULL, density FROM ({union_all([f"SELECT * FROM {_kde_sql(_ML, c)}" for c in ["price", "bal"]])})""",
       floats=("x", "y", "value"))
def q_pair_two(spark, d):
    return plotdata.pair_two(fixture(spark, d, "fx_ml"), "price", "bal")


def _grid_sql(src: str, x: str, y: str, grid: int = 20) -> str:
    def rng(c):
        return (f"(SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo, "
                f"CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM {src})")
    b = "CAST(least(floor((CAST({c} AS DOUBLE) - {r}.lo) / ({r}.hi - {r}.lo) * {g}), {g1}) AS BIGINT)"
    return (f"SELECT '{x}' AS x_column, '{y}' AS y_column, {b.format(c=x, r='rx', g=grid, g1=grid - 1)} AS bx, "
            f"{b.format(c=y, r='ry', g=grid, g1=grid - 1)} AS by, CAST(count(*) AS BIGINT) AS count "
            f"FROM {src}, {rng(x)} rx, {rng(y)} ry WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL")


_PAIR_COLS = ["price", "cust_mod", "bal"]


@query("pair_all", oracle=union_all([_grid_sql(_ML, b, a) for i, a in enumerate(_PAIR_COLS) for b in _PAIR_COLS[:i]]))
def q_pair_all(spark, d):
    return plotdata.pair_all(fixture(spark, d, "fx_ml"), _PAIR_COLS)
