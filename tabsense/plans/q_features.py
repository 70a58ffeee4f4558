"""Registered queries: feature preparation."""

from __future__ import annotations

from tabsense.functions.dates import duck_parse_any
from tabsense.operators import features
from tabsense.plans.fixtures import duck_fixture, fixture
from tabsense.plans.registry import query
from tabsense.plans.sqlgen import corr_sql, qi, union_all

_ML = duck_fixture("fx_ml")
_DATES = duck_fixture("fx_dates")
_TARGETS = [None, "y_class", "y_reg", "cust_mod", "segment", "no_such_column"]


def _ml_type_sql(t: str | None) -> str:
    if t is None or t == "no_such_column":
        return f"SELECT {'NULL' if t is None else repr(t)} AS target, 'clustering' AS ml_type"
    if t in ("y_class", "segment"):
        return f"SELECT '{t}' AS target, CASE WHEN count({t}) = 0 THEN 'clustering' ELSE 'classification' END AS ml_type FROM {_ML}"
    return (f"SELECT '{t}' AS target, CASE WHEN count({t}) = 0 THEN 'clustering' WHEN count(DISTINCT {t}) = 2 THEN "
            f"'classification' WHEN count(DISTINCT {t}) < 15 AND count(DISTINCT {t}) / count({t}) < 0.1 THEN "
            f"'classification' ELSE 'regression' END AS ml_type FROM {_ML}")


@query("detect_ml_type", oracle=union_all([_ml_type_sql(t) for t in _TARGETS]))
def q_detect_ml_type(spark, d):
    return features.ml_type_table(fixture(spark, d, "fx_ml"), _TARGETS)


def _parts(c: str, e: str) -> str:
    return (f"{e} AS {c}, CAST(year({e}) AS BIGINT) AS {c}_year1, CAST(month({e}) AS BIGINT) AS {c}_month1, "
            f"CAST(day({e}) AS BIGINT) AS {c}_day1")


_PART_COLS = [f"{b}{s}" for b in ["date_fr", "maybe_day", "ymd_int", "native_ts"] for s in ["_year1", "_month1", "_day1"]]


_DF = f"""(SELECT row_id, {_parts('date_fr', duck_parse_any('date_fr'))}, {_parts('maybe_day', duck_parse_any('maybe_day'))},
  {_parts('ymd_int', "try_strptime(CAST(ymd_int AS VARCHAR), '%Y%m%d')")}, update_count, {_parts('native_ts', 'native_ts')}
  FROM {_DATES})"""


@query("date_features", oracle=f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _PART_COLS)}) FROM {_DF}",
       floats=tuple(_PART_COLS))
def q_date_features(spark, d):
    """Date parts are reported as DOUBLE here (they hold nulls) so that both
    engines return the same value type."""
    from pyspark.sql import functions as F
    out = features.date_features(fixture(spark, d, "fx_dates"))
    return out.withColumns({c: F.col(c).cast("double") for c in _PART_COLS})


@query("date_feature_profile", oracle=union_all([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean FROM {_DF}"
    for base in ["date_fr", "maybe_day", "ymd_int", "native_ts"] for c in
    [f"{base}_year1", f"{base}_month1", f"{base}_day1"]]), floats=("min", "max", "mean"))
def q_date_feature_profile(spark, d):
    return features.date_feature_profile(features.date_features(fixture(spark, d, "fx_dates")))


_CODES = {c: f"(SELECT {c} AS cls, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT "
             f"coalesce(CAST({c} AS VARCHAR), 'None') AS {c} FROM {_ML}))" for c in ["segment", "priority", "y_class"]}


@query("label_encode", oracle=f"""
SELECT m.row_id, m.price, m.cust_mod, m.bal, s.idx AS segment, p.idx AS priority, m.odate, y.idx AS y_class, m.y_reg
FROM {_ML} m JOIN {_CODES['segment']} s ON s.cls = m.segment JOIN {_CODES['priority']} p ON p.cls = m.priority
JOIN {_CODES['y_class']} y ON y.cls = m.y_class""", floats=("price", "cust_mod", "bal", "y_reg"))
def q_label_encode(spark, d):
    return features.label_encode(fixture(spark, d, "fx_ml"))[0]


@query("label_map", oracle=union_all([f"SELECT '{c}' AS \"column\", cls AS class, idx FROM {_CODES[c]}"
                                      for c in ["segment", "priority", "y_class"]]))
def q_label_map(spark, d):
    return features.label_encode(fixture(spark, d, "fx_ml"))[1]


def _z(c: str) -> str:
    return (f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM {_ML})) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
            f"ELSE stddev_pop({c}) END FROM {_ML}) AS {c}")


@query("standardize", oracle=f"SELECT row_id, {_z('price')}, {_z('cust_mod')}, {_z('bal')}, segment, priority, odate, "
                             f"y_class, y_reg FROM {_ML}", floats=("price", "cust_mod", "bal", "y_reg"))
def q_standardize(spark, d):
    return features.standardize(fixture(spark, d, "fx_ml"), target="y_reg")[0]


@query("scaler", oracle=union_all([
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS scale "
    f"FROM {_ML}" for c in ["price", "cust_mod", "bal"]]), floats=("mean", "scale"))
def q_scaler(spark, d):
    return features.standardize(fixture(spark, d, "fx_ml"), target="y_reg")[1]


_TD_NUM = ["price", "cust_mod", "bal", "y_reg"]
_TD_SCALED = ["price", "cust_mod", "bal", "y_reg", "odate_year1", "odate_month1", "odate_day1"]


def _lo(c: str) -> str:
    return f"(f.{c}_q1 - 1.5 * (f.{c}_q3 - f.{c}_q1))"


def _hi(c: str) -> str:
    return f"(f.{c}_q3 + 1.5 * (f.{c}_q3 - f.{c}_q1))"


def _codes_of(c: str) -> str:
    return (f"(SELECT {c} AS cls, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS idx FROM "
            f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'None') AS {c} FROM d))")


# transform_dataset on fx_ml (target y_class): keep-first dedup, no nulls,
# outlier fences on the four numeric columns (delete at <= 10 %, else clip),
# date parts of odate, label codes of segment/priority, then the columns that
# were numeric before encoding are standardised.
_TD_SQL = f"""
WITH m AS {_ML},
dd AS (SELECT min(row_id) AS row_id, price, cust_mod, bal, segment, priority, odate, y_class, y_reg FROM m GROUP BY ALL),
f AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in _TD_NUM)} FROM dd),
fl AS (SELECT dd.*, {" OR ".join(f"coalesce({c} < {_lo(c)} OR {c} > {_hi(c)}, false)" for c in _TD_NUM)} AS is_out FROM dd, f),
r AS (SELECT avg(CASE WHEN is_out THEN 1.0 ELSE 0.0 END) AS ratio FROM fl),
o AS (SELECT row_id, price, cust_mod, bal, segment, priority, odate, y_class, y_reg FROM fl, r WHERE ratio <= 0.1 AND NOT is_out
      UNION ALL
      SELECT row_id, {", ".join(f"CASE WHEN {c} < {_lo(c)} THEN {_lo(c)} WHEN {c} > {_hi(c)} THEN {_hi(c)} ELSE CAST({c} AS DOUBLE) END AS {c}" for c in ["price", "cust_mod", "bal"])},
        segment, priority, odate, y_class,
        CASE WHEN y_reg < {_lo('y_reg')} THEN {_lo('y_reg')} WHEN y_reg > {_hi('y_reg')} THEN {_hi('y_reg')} ELSE y_reg END AS y_reg
      FROM fl, f, r WHERE ratio > 0.1),
d AS (SELECT *, CAST(year(odate) AS BIGINT) AS odate_year1, CAST(month(odate) AS BIGINT) AS odate_month1,
        CAST(day(odate) AS BIGINT) AS odate_day1 FROM o),
st AS (SELECT {", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s" for c in _TD_SCALED)} FROM d)
SELECT d.row_id, {", ".join(f"(CAST(d.{c} AS DOUBLE) - st.{c}_m) / st.{c}_s AS {c}" for c in _TD_SCALED)},
  cs.idx AS segment, cp.idx AS priority, d.odate, d.y_class
FROM d JOIN {_codes_of('segment')} cs ON cs.cls = d.segment JOIN {_codes_of('priority')} cp ON cp.cls = d.priority, st"""


@query("transform_dataset", oracle=_TD_SQL, floats=tuple(_TD_SCALED))
def q_transform_dataset(spark, d):
    return features.transform_dataset(fixture(spark, d, "fx_ml"), target="y_class", bucket_rows=4096)[0]


@query("pca_features_2d", oracle=f"""
WITH c AS (SELECT var_samp(coalesce(price, 0)) AS a, var_samp(coalesce(bal, 0)) AS d,
                  covar_samp(coalesce(price, 0), coalesce(bal, 0)) AS b FROM {_ML}),
e AS (SELECT (a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b) AS l2,
             a + d AS t FROM c)
SELECT 'PC1' AS component, l1 AS eigenvalue, l1 / t * 100 AS explained_pct, l1 / t * 100 AS cumulative_pct FROM e
UNION ALL SELECT 'PC2', greatest(l2, 0), greatest(l2, 0) / t * 100, (l1 + greatest(l2, 0)) / t * 100 FROM e""",
       floats=("eigenvalue", "explained_pct", "cumulative_pct"))
def q_pca_features_2d(spark, d):
    """Unscaled PCA of two columns (closed-form 2 x 2 eigenvalues in SQL)."""
    return features.pca_features(fixture(spark, d, "fx_ml"), ["price", "bal"])


@query("pca_features")
def q_pca_features(spark, d):
    return features.pca_features(fixture(spark, d, "fx_ml").drop("row_id"))


_TC_COLS = ["price", "cust_mod", "bal", "y_class", "y_reg"]
_TC = (f"(SELECT m.price, m.cust_mod, m.bal, y.idx AS y_class, m.y_reg FROM {_ML} m "
       f"JOIN {_CODES['y_class']} y ON y.cls = m.y_class)")


@query("target_correlation", oracle=union_all([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    + (f"CASE WHEN ({corr_sql(qi(a), qi(b))}) IS NOT NULL THEN 1.0 END" if a == b else corr_sql(qi(a), qi(b)))
    + f" AS corr FROM {_TC}" for a in _TC_COLS for b in _TC_COLS]), floats=("corr",))
def q_target_correlation(spark, d):
    return features.target_correlation(fixture(spark, d, "fx_ml").drop("row_id"), "y_class")


_TR_COLS = ["price", "cust_mod", "bal", "segment", "priority", "odate", "y_class", "y_reg",
            "odate_year1", "odate_month1", "odate_day1"]


def _transformation_sql() -> str:
    src = (f"(SELECT *, year(odate) AS odate_year1, month(odate) AS odate_month1, day(odate) AS odate_day1 FROM {_ML})")
    parts = []
    for c in _TR_COLS:
        if c == "y_class":
            what = "'target (not transformed)'"
        else:
            what = (f"CASE WHEN any_value(typeof({c})) IN ('DOUBLE', 'BIGINT', 'INTEGER') THEN 'standardisation' "
                    f"WHEN any_value(typeof({c})) LIKE 'TIMESTAMP%' THEN '{c}_year1, {c}_month1, {c}_day1' "
                    f"WHEN any_value(typeof({c})) = 'VARCHAR' THEN 'label encoding' ELSE 'none' END")
        parts.append(f"SELECT '{c}' AS \"column\", {what} AS transformation FROM {src}" if c != "y_class"
                     else f"SELECT '{c}' AS \"column\", {what} AS transformation")
    return union_all(parts)


@query("transformation_report", oracle=_transformation_sql())
def q_transformation_report(spark, d):
    df = features.date_features(fixture(spark, d, "fx_ml"), exclude=("y_class",))
    return features.transformation_report(df, "y_class")


@query("split_features_target", oracle=f"SELECT row_id, price, cust_mod, bal, y_reg FROM {_ML}",
       floats=("price", "cust_mod", "bal", "y_reg"))
def q_split_features_target(spark, d):
    return features.split_features_target(fixture(spark, d, "fx_ml"), "y_reg")[1]


@query("candidate_values", oracle=union_all([
    f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, min(row_id) AS first_row_id FROM {_ML} "
    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY first_row_id LIMIT 50)" for c in ["segment", "priority", "y_class"]]))
def q_candidate_values(spark, d):
    return features.candidate_values(fixture(spark, d, "fx_ml"), ["segment", "priority", "y_class"])
