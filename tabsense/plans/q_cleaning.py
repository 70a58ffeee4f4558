"""Registered queries: cleaning."""

from __future__ import annotations

from tabsense.operators import cleaning
from tabsense.plans.fixtures import duck_fixture, fixture
from tabsense.plans.registry import query

_M = duck_fixture("fx_missing")
_D = duck_fixture("fx_dups")
_FEW = duck_fixture("fx_outliers_few")
_MANY = duck_fixture("fx_outliers_many")
_DK = "a, b, c, d"
_DJ = " AND ".join(f"r.{c} IS NOT DISTINCT FROM g.{c}" for c in ["a", "b", "c", "d"])
_FIRSTS = f"(SELECT {_DK}, min(row_id) AS first_id, count(*) AS cnt FROM {_D} GROUP BY ALL)"
_MF = ("q_interp", "p_mean", "t_drop_rows", "d_drop_col")


@query("drop_columns", oracle=f"SELECT row_id, q_interp, p_mean, t_drop_rows, f_mode, s_mode, full_col FROM {_M}",
       floats=("q_interp", "p_mean", "t_drop_rows"))
def q_drop_columns(spark, d):
    return cleaning.drop_columns(fixture(spark, d, "fx_missing"), ["d_drop_col", "not_a_column"])


@query("drop_duplicates", floats=("d",), oracle=f"SELECT min(row_id) AS row_id, {_DK} FROM {_D} GROUP BY ALL")
def q_drop_duplicates(spark, d):
    return cleaning.drop_duplicates(fixture(spark, d, "fx_dups"))


_DELETED = f"SELECT r.row_id, r.a, r.b, r.c, r.d FROM {_D} r JOIN {_FIRSTS} g ON {_DJ} WHERE r.row_id <> g.first_id"


@query("deleted_duplicates", floats=("d",), oracle=_DELETED)
def q_deleted_duplicates(spark, d):
    return cleaning.deleted_duplicates(fixture(spark, d, "fx_dups"))


@query("unique_deleted", floats=("d",), oracle=f"SELECT min(row_id) AS row_id, {_DK} FROM ({_DELETED}) GROUP BY ALL")
def q_unique_deleted(spark, d):
    return cleaning.unique_deleted(fixture(spark, d, "fx_dups"))


@query("duplicate_groups", floats=("d",), oracle=f"""
SELECT g.first_id AS kept_row_id, r.row_id, r.row_id = g.first_id AS is_kept, r.a, r.b, r.c, r.d,
  CAST(g.cnt AS BIGINT) AS group_size
FROM {_D} r JOIN {_FIRSTS} g ON {_DJ} WHERE g.cnt > 1""")
def q_duplicate_groups(spark, d):
    return cleaning.duplicate_groups(fixture(spark, d, "fx_dups"))


@query("drop_sparse_columns", oracle=f"SELECT row_id, q_interp, p_mean, t_drop_rows, f_mode, s_mode, full_col FROM {_M}",
       floats=("q_interp", "p_mean", "t_drop_rows"))
def q_drop_sparse_columns(spark, d):
    return cleaning.drop_sparse_columns(fixture(spark, d, "fx_missing"))


def _interp_sql(src: str, c: str, pos: str = "row_id") -> str:
    prev = (f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'p': CAST({pos} AS DOUBLE), 'v': {c}}} END IGNORE NULLS) "
            f"OVER (ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    nxt = (f"first_value(CASE WHEN {c} IS NOT NULL THEN {{'p': CAST({pos} AS DOUBLE), 'v': {c}}} END IGNORE NULLS) "
           f"OVER (ORDER BY {pos} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    return f"""(SELECT * EXCLUDE (pr, nx) REPLACE (CASE WHEN {c} IS NOT NULL THEN {c} WHEN pr IS NULL THEN NULL
  WHEN nx IS NULL THEN pr.v ELSE (nx.v - pr.v) / (nx.p - pr.p) * (CAST({pos} AS DOUBLE) - pr.p) + pr.v END AS {c})
  FROM (SELECT *, {prev} AS pr, {nxt} AS nx FROM {src}))"""


@query("fill_interpolate", oracle=f"SELECT * FROM {_interp_sql(_M, 'q_interp')}", floats=_MF)
def q_fill_interpolate(spark, d):
    return cleaning.fill_interpolate(fixture(spark, d, "fx_missing"), "q_interp", bucket_rows=4096)


@query("fill_mean", oracle=f"SELECT * REPLACE (coalesce(p_mean, (SELECT avg(p_mean) FROM {_M})) AS p_mean) FROM {_M}",
       floats=_MF)
def q_fill_mean(spark, d):
    return cleaning.fill_mean(fixture(spark, d, "fx_missing"), "p_mean")


@query("drop_null_rows", oracle=f"SELECT * FROM {_M} WHERE t_drop_rows IS NOT NULL", floats=_MF)
def q_drop_null_rows(spark, d):
    return cleaning.drop_null_rows(fixture(spark, d, "fx_missing"), "t_drop_rows")


def _mode_sql(src: str, c: str) -> str:
    return (f"(SELECT arg_min(v, (-n, v)) FROM (SELECT {c} AS v, count(*) AS n FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY {c}))")


@query("fill_mode", oracle=f"SELECT * REPLACE (coalesce(f_mode, {_mode_sql(_M, 'f_mode')}, 'Inconnu') AS f_mode) FROM {_M}",
       floats=_MF)
def q_fill_mode(spark, d):
    return cleaning.fill_mode(fixture(spark, d, "fx_missing"), "f_mode")


@query("fill_forward", oracle=f"""SELECT * REPLACE (last_value(s_mode IGNORE NULLS) OVER (ORDER BY row_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_mode) FROM {_M}""", floats=_MF)
def q_fill_forward(spark, d):
    return cleaning.fill_forward(fixture(spark, d, "fx_missing"), "s_mode", bucket_rows=4096)


# clean_missing on fx_missing: d_drop_col is dropped (50 % null), q_interp
# interpolated (5 %), p_mean mean-filled (20 %), rows with a null t_drop_rows
# deleted (40 %), then f_mode (text) and s_mode (date) mode-filled on the rows left.
_CM1 = f"(SELECT * EXCLUDE (d_drop_col) FROM {_M})"
_CM2 = _interp_sql(_CM1, "q_interp")
_CM3 = f"(SELECT * REPLACE (coalesce(p_mean, (SELECT avg(p_mean) FROM {_CM2})) AS p_mean) FROM {_CM2})"
_CM4 = f"(SELECT * FROM {_CM3} WHERE t_drop_rows IS NOT NULL)"
_CM5 = f"(SELECT * REPLACE (coalesce(f_mode, {_mode_sql(_CM4, 'f_mode')}, 'Inconnu') AS f_mode) FROM {_CM4})"
_CM6 = f"(SELECT * REPLACE (coalesce(s_mode, {_mode_sql(_CM5, 's_mode')}) AS s_mode) FROM {_CM5})"


@query("clean_missing", oracle=f"SELECT * FROM {_CM6}", floats=("q_interp", "p_mean", "t_drop_rows"))
def q_clean_missing(spark, d):
    return cleaning.clean_missing(fixture(spark, d, "fx_missing"), bucket_rows=4096)


@query("cleaning_diff", oracle=f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM {_M}) AS rows_before, (SELECT CAST(count(*) AS BIGINT) FROM {_CM6}) AS rows_after,
  CAST(7 AS BIGINT) AS columns_before, CAST(6 AS BIGINT) AS columns_after, 'd_drop_col' AS removed_columns,
  'q_interp, p_mean, t_drop_rows, f_mode, s_mode' AS filled_columns""")
def q_cleaning_diff(spark, d):
    before = fixture(spark, d, "fx_missing")
    return cleaning.cleaning_diff(before, cleaning.clean_missing(before, bucket_rows=4096))


def _fence_pred(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        q1 = f"(SELECT quantile_cont({c}, 0.25) FROM {src})"
        q3 = f"(SELECT quantile_cont({c}, 0.75) FROM {src})"
        parts.append(f"coalesce({c} < {q1} - 1.5 * ({q3} - {q1}) OR {c} > {q3} + 1.5 * ({q3} - {q1}), false)")
    return " OR ".join(parts)


@query("outlier_rows", oracle=f"SELECT * FROM {_FEW} WHERE {_fence_pred(_FEW, ['x', 'y'])}", floats=("x", "y"))
def q_outlier_rows(spark, d):
    return cleaning.outlier_rows(fixture(spark, d, "fx_outliers_few"))


@query("remove_outlier_rows", oracle=f"SELECT * FROM {_FEW} WHERE NOT ({_fence_pred(_FEW, ['x', 'y'])})",
       floats=("x", "y"))
def q_remove_outlier_rows(spark, d):
    return cleaning.remove_outlier_rows(fixture(spark, d, "fx_outliers_few"))


def _clip_sql(src: str, c: str) -> str:
    q1 = f"(SELECT quantile_cont({c}, 0.25) FROM {src})"
    q3 = f"(SELECT quantile_cont({c}, 0.75) FROM {src})"
    lo, hi = f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE CAST({c} AS DOUBLE) END AS {c}"


_WINS = f"SELECT row_id, {_clip_sql(_MANY, 'x')}, {_clip_sql(_MANY, 'y')} FROM {_MANY}"


@query("winsorize", oracle=_WINS, floats=("x", "y"))
def q_winsorize(spark, d):
    return cleaning.winsorize(fixture(spark, d, "fx_outliers_many"))


@query("treat_outliers", oracle=_WINS, floats=("x", "y"))
def q_treat_outliers(spark, d):
    return cleaning.treat_outliers(fixture(spark, d, "fx_outliers_many"))[0]


@query("treat_outliers_delete", oracle=f"SELECT * FROM {_FEW} WHERE NOT ({_fence_pred(_FEW, ['x', 'y'])})",
       floats=("x", "y"))
def q_treat_outliers_delete(spark, d):
    return cleaning.treat_outliers(fixture(spark, d, "fx_outliers_few"))[0]


# preprocess_full on fx_dups: keep-first dedup, then d (13 % null after
# dedup -> mean), then the outlier fences.
_P1 = f"(SELECT min(row_id) AS row_id, {_DK} FROM {_D} GROUP BY ALL)"
_P1R = f"(SELECT *, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS pos FROM {_P1})"
_P2 = f"(SELECT * REPLACE (coalesce(d, (SELECT avg(d) FROM {_P1})) AS d) FROM {_P1})"


@query("fill_interpolate_dense", oracle=f"SELECT * EXCLUDE (pos) FROM {_interp_sql(_P1R, 'd', 'pos')}", floats=("d",))
def q_fill_interpolate_dense(spark, d):
    """Interpolation after a row deletion: positions are the rows left."""
    from tabsense.operators.cleaning import drop_duplicates, fill_interpolate
    dedup = drop_duplicates(fixture(spark, d, "fx_dups"))
    return fill_interpolate(dedup, "d", bucket_rows=64, dense_positions=True)


@query("preprocess_full", oracle=f"SELECT * FROM {_P2} WHERE NOT ({_fence_pred(_P2, ['c', 'd'])})", floats=("d",))
def q_preprocess_full(spark, d):
    return cleaning.preprocess_full(fixture(spark, d, "fx_dups"), bucket_rows=4096)[0]
