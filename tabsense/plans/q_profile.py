"""Registered queries: dataset information and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import plotdata, profile, stats
from tabsense.plans.fixtures import duck_fixture, duck_table_rows, fixture, table_rows
from tabsense.plans.registry import query
from tabsense.plans.sqlgen import corr_sql, kurt_sql, per_column, qi, skew_sql, union_all, words_sql
from tabsense.sources.tables import read_table

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_ALL = LI_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]
MISSING_COLS = ["q_interp", "p_mean", "t_drop_rows", "d_drop_col", "f_mode", "s_mode", "full_col"]
DUPS_COLS = ["a", "b", "c", "d"]
DOC_TEXT = ["text", "lang", "source"]


@query("shape", oracle=f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST({len(LI_ALL)} AS BIGINT) AS columns, "
                      f"'{', '.join(LI_ALL)}' AS column_names FROM lineitem")
def q_shape(spark, d):
    return profile.shape(read_table(spark, d, "lineitem"))


@query("dtypes", oracle="""
SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS ordinal, column_name AS "column",
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS dtype,
  CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'BIGINT' WHEN column_type = 'DOUBLE' THEN 'DOUBLE PRECISION'
    WHEN column_type = 'TIMESTAMP' THEN 'TIMESTAMP' ELSE 'TEXT' END AS storage_type FROM (DESCRIBE lineitem)""")
def q_dtypes(spark, d):
    return profile.dtypes(read_table(spark, d, "lineitem"))


_HT = duck_fixture("fx_missing")
@query("head_tail", oracle=f"""
SELECT *, 'head' AS part FROM (SELECT * FROM {_HT} ORDER BY row_id LIMIT 5)
UNION ALL SELECT *, 'tail' AS part FROM (SELECT * FROM {_HT} ORDER BY row_id DESC LIMIT 5)""",
       floats=("q_interp", "p_mean", "t_drop_rows", "d_drop_col"))
def q_head_tail(spark, d):
    return profile.head_tail(fixture(spark, d, "fx_missing"))


@query("preview", oracle=f"SELECT * FROM {duck_table_rows('lineitem')} ORDER BY row_id LIMIT 3000",
       floats=("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def q_preview(spark, d):
    return profile.preview(table_rows(spark, d, "lineitem"), 3000)


def _dates_categories_sql() -> str:
    from tabsense.functions.dates import duck_parse_any
    src = duck_fixture("fx_dates")
    cats = [("row_id", "'numeric'"), ("date_fr", None), ("maybe_day", None), ("ymd_int", "'numeric'"),
            ("update_count", "'numeric'"), ("native_ts", "'date'")]
    parts = []
    for i, (c, fixed) in enumerate(cats):
        if c == "row_id":
            continue
        cat = fixed or (f"CASE WHEN count(*) > 0 AND count({duck_parse_any(qi(c))}) >= 0.8 * count(*) "
                        f"THEN 'date' ELSE 'text' END")
        frm = src if fixed is None else f"(SELECT count(*) FROM {src})"
        parts.append(f"SELECT CAST({i - 1} AS BIGINT) AS ordinal, '{c}' AS \"column\", {cat} AS category FROM {frm}")
    return union_all(parts)


@query("preview_json", oracle="SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, CAST(least(count(*), 3000) AS BIGINT) AS preview_rows FROM customer")
def q_preview_json(spark, d):
    """Row and column counts of customer, and the number of records in the JSON of its first rows."""
    from tabsense.operators.rows import with_row_index
    made = profile.preview_json(with_row_index(read_table(spark, d, "customer"), ["c_custkey"]))
    return made.select("n_rows", "n_columns", F.json_array_length("first_rows").cast("long").alias("preview_rows"))


@query("column_categories", oracle=_dates_categories_sql())
def q_column_categories(spark, d):
    return profile.column_categories(fixture(spark, d, "fx_dates"))


@query("null_profile", oracle=union_all([
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", CAST(count(*) - count({qi(c)}) AS BIGINT) AS null_count, "
    f"round((count(*) - count({qi(c)})) * 100.0 / count(*), 2) AS null_pct FROM {duck_fixture('fx_missing')}"
    for i, c in enumerate(MISSING_COLS)]), floats=("null_pct",))
def q_null_profile(spark, d):
    return profile.null_profile(fixture(spark, d, "fx_missing"))


@query("null_summary", oracle=f"""
SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS columns_with_nulls,
       CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS columns_without_nulls
FROM ({union_all([f"SELECT count(*) - count({qi(c)}) AS n FROM {duck_fixture('fx_missing')}" for c in MISSING_COLS])})""")
def q_null_summary(spark, d):
    return profile.null_summary(fixture(spark, d, "fx_missing"))


_DUPS = duck_fixture("fx_dups")
_DUP_KEYS = ", ".join(DUPS_COLS)
_DUP_JOIN = " AND ".join(f"r.{c} IS NOT DISTINCT FROM g.{c}" for c in DUPS_COLS)
_DUP_COUNTS = f"(SELECT {_DUP_KEYS}, count(*) AS cnt FROM {_DUPS} GROUP BY ALL)"


@query("duplicate_rows", floats=("d",), oracle=f"""
SELECT r.row_id, r.a, r.b, r.c, r.d FROM {_DUPS} r JOIN {_DUP_COUNTS} g ON {_DUP_JOIN} WHERE g.cnt > 1""")
def q_duplicate_rows(spark, d):
    return profile.duplicate_rows(fixture(spark, d, "fx_dups"))


_RUNS = f"""(SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (ORDER BY row_id) AS grp FROM (
  SELECT *, coalesce(a = lag(a) OVER w AND b = lag(b) OVER w AND c = lag(c) OVER w AND d = lag(d) OVER w, false) AS same
  FROM {_DUPS} WINDOW w AS (ORDER BY row_id)))"""
_RUN_GROUPS = f"(SELECT grp, min(row_id) AS start, count(*) AS n FROM {_RUNS} GROUP BY grp HAVING count(*) > 1)"


@query("duplicate_runs", floats=("d",), oracle=f"""
SELECT r.row_id, r.a, r.b, r.c, r.d, CAST(g.n AS BIGINT) AS count_in_group
FROM {_DUPS} r JOIN {_RUN_GROUPS} g ON r.row_id = g.start""")
def q_duplicate_runs(spark, d):
    return profile.duplicate_runs(fixture(spark, d, "fx_dups"), bucket_rows=4096)


_IN_RUNS = f"(SELECT r.row_id FROM {_RUNS} r JOIN {_RUN_GROUPS} g ON r.grp = g.grp)"
_SCATTERED = f"""
SELECT min(r.row_id) AS row_id, r.a, r.b, r.c, r.d, CAST(max(g.cnt) AS BIGINT) AS count_duplicates
FROM {_DUPS} r JOIN {_DUP_COUNTS} g ON {_DUP_JOIN}
WHERE g.cnt > 1 AND r.row_id NOT IN (SELECT row_id FROM {_IN_RUNS})
GROUP BY r.a, r.b, r.c, r.d"""


@query("duplicate_scattered", floats=("d",), oracle=_SCATTERED)
def q_duplicate_scattered(spark, d):
    return profile.duplicate_scattered(fixture(spark, d, "fx_dups"), bucket_rows=4096)


@query("duplicate_summary", oracle=f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM {_RUN_GROUPS}) AS run_groups,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM {_RUN_GROUPS}) AS rows_in_runs,
       (SELECT CAST(count(*) AS BIGINT) FROM ({_SCATTERED})) AS scattered_rows,
       (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM {_DUP_COUNTS} WHERE cnt > 1) AS duplicated_rows""")
def q_duplicate_summary(spark, d):
    return profile.duplicate_summary(fixture(spark, d, "fx_dups"), bucket_rows=4096)


_DESCRIBE = ("'{name}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, avg(CAST({c} AS DOUBLE)) AS mean, "
             "stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min, "
             "quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, "
             "quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max")


@query("describe_numeric", oracle=per_column("lineitem", LI_NUM, _DESCRIBE),
       floats=("mean", "std", "min", "q25", "q50", "q75", "max"))
def q_describe_numeric(spark, d):
    return stats.describe_numeric(read_table(spark, d, "lineitem"))


@query("describe_advanced", oracle=union_all([
    f"SELECT '{c}' AS \"column\", quantile_cont(CAST({qi(c)} AS DOUBLE), 0.5) AS median, var_samp({qi(c)}) AS variance, "
    f"stddev_samp({qi(c)}) AS std, CASE WHEN avg({qi(c)}) <> 0 THEN stddev_samp({qi(c)}) / avg({qi(c)}) END AS cv, "
    f"{skew_sql(qi(c))} AS skew, {kurt_sql(qi(c))} AS kurtosis FROM lineitem" for c in LI_NUM]),
       floats=("median", "variance", "std", "cv", "skew", "kurtosis"))
def q_describe_advanced(spark, d):
    return stats.describe_advanced(read_table(spark, d, "lineitem"))


def _fences_sql(src: str, cols: list[str]) -> str:
    return union_all([
        f"SELECT '{c}' AS \"column\", quantile_cont({qi(c)}, 0.25) - 1.5 * (quantile_cont({qi(c)}, 0.75) - "
        f"quantile_cont({qi(c)}, 0.25)) AS lower, quantile_cont({qi(c)}, 0.75) + 1.5 * "
        f"(quantile_cont({qi(c)}, 0.75) - quantile_cont({qi(c)}, 0.25)) AS upper FROM {src}" for c in cols])


_OUT_SRC = duck_fixture("fx_outliers_many")
_OUT_COUNTS = union_all([
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE t.{qi(c)} < f.lower OR t.{qi(c)} > f.upper) AS BIGINT)"
    f" AS outliers, max(f.lower) AS lower, max(f.upper) AS upper FROM {_OUT_SRC} t, "
    f"({_fences_sql(_OUT_SRC, [c])}) f" for c in ["x", "y"]])


@query("outlier_counts", oracle=f"""
SELECT o.*, (SELECT max(outliers) > 0 FROM ({_OUT_COUNTS})) AS has_outliers FROM ({_OUT_COUNTS}) o""",
       floats=("lower", "upper"))
def q_outlier_counts(spark, d):
    return stats.outlier_counts(fixture(spark, d, "fx_outliers_many"))


@query("pca_scaled_2d", oracle="""
WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 'PC1' AS component, n / (n - 1) * (1 + abs(r)) AS eigenvalue, (1 + abs(r)) / 2 * 100 AS explained_pct,
  (1 + abs(r)) / 2 * 100 AS cumulative_pct FROM s
UNION ALL SELECT 'PC2', n / (n - 1) * (1 - abs(r)), (1 - abs(r)) / 2 * 100, 100.0 FROM s""",
       floats=("eigenvalue", "explained_pct", "cumulative_pct"))
def q_pca_scaled_2d(spark, d):
    """PCA of two standardised columns: the 2 x 2 case has a closed form
    (eigenvalues n/(n-1) (1 +- |r|)), which makes the PCA path SQL-checkable."""
    return stats.pca_scaled(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("pca_scaled")
def q_pca_scaled(spark, d):
    return stats.pca_scaled(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_DT = duck_fixture("fx_dirty_text")


@query("text_uniques", oracle=f"""
SELECT 'seg' AS "column", CAST(count(DISTINCT seg) AS BIGINT) AS n_unique,
  (SELECT string_agg(seg, ', ' ORDER BY seg) FROM (SELECT DISTINCT seg FROM {_DT} WHERE seg IS NOT NULL ORDER BY seg LIMIT 20))
  AS first_values FROM {_DT}""")
def q_text_uniques(spark, d):
    return stats.text_uniques(fixture(spark, d, "fx_dirty_text"))


_TD = "(SELECT '{name}' AS col, {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c})"


@query("text_describe", oracle=union_all([
    f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS \"unique\", "
    f"arg_min(v, (-n, v)) AS top, CAST(max(n) AS BIGINT) AS freq FROM {_TD.format(name=c, c=qi(c))}"
    for c in DOC_TEXT]))
def q_text_describe(spark, d):
    return stats.text_describe(read_table(spark, d, "documents"))


@query("avg_word_count", oracle=per_column("documents", DOC_TEXT,
                                           "'{name}' AS \"column\", avg(len(" + words_sql("{c}") + ")) AS avg_words"),
       floats=("avg_words",))
def q_avg_word_count(spark, d):
    return stats.avg_word_count(read_table(spark, d, "documents"))


@query("word_frequency", oracle=union_all([
    f"SELECT '{c}' AS \"column\", word, CAST(count(*) AS BIGINT) AS frequency FROM "
    f"(SELECT unnest({words_sql('lower(' + qi(c) + ')')}) AS word FROM documents) GROUP BY word" for c in DOC_TEXT]))
def q_word_frequency(spark, d):
    return stats.word_frequency(read_table(spark, d, "documents"))


def _hist_sql(src: str, cols: list[str], bins: int = 30, expr: str = "{c}") -> str:
    parts = []
    for c in cols:
        e = expr.format(c=qi(c))
        rng = (f"(SELECT CASE WHEN min({e}) = max({e}) THEN min({e}) - 0.5 ELSE min({e}) END AS lo, "
               f"CASE WHEN min({e}) = max({e}) THEN max({e}) + 0.5 ELSE max({e}) END AS hi, count({e}) AS n FROM {src})")
        b = f"CAST(least(floor((CAST({e} AS DOUBLE) - r.lo) / (r.hi - r.lo) * {bins}), {bins - 1}) AS BIGINT)"
        w = f"((r.hi - r.lo) / {bins})"
        parts.append(
            f"SELECT '{c}' AS \"column\", g.bin, r.lo + g.bin * {w} AS bin_lo, r.lo + (g.bin + 1) * {w} AS bin_hi, "
            f"CAST(coalesce(cnt, 0) AS BIGINT) AS count, coalesce(cnt, 0) / (r.n * {w}) AS density "
            f"FROM (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) g CROSS JOIN {rng} r LEFT JOIN "
            f"(SELECT {b} AS bin, count(*) AS cnt FROM {src}, {rng} r WHERE {e} IS NOT NULL GROUP BY ALL) k ON k.bin = g.bin")
    return union_all(parts)


@query("text_length_distribution", oracle=_hist_sql("documents", DOC_TEXT, 30, "length({c})"),
       floats=("bin_lo", "bin_hi", "density"))
def q_text_length_distribution(spark, d):
    return stats.text_length_distribution(read_table(spark, d, "documents"))


def _profile_all_sql() -> str:
    src = duck_fixture("fx_missing")
    num = ["q_interp", "p_mean", "t_drop_rows", "d_drop_col"]
    txt = ["f_mode", "full_col"]
    parts = []

    def add(section, c, metric, value=None, text=None, scalar=False):
        v = f"CAST({value} AS DOUBLE)" if value is not None else "CAST(NULL AS DOUBLE)"
        t = text if text is not None else "CAST(NULL AS VARCHAR)"
        frm = "(SELECT 1) AS one" if scalar else src
        parts.append(f"SELECT '{section}' AS section, '{c}' AS \"column\", '{metric}' AS metric, {v} AS value, {t} AS text FROM {frm}")

    for c in num:
        q = qi(c)
        for m, e in (("count", f"count({q})"), ("mean", f"avg({q})"), ("std", f"stddev_samp({q})"), ("min", f"min({q})"),
                     ("q25", f"quantile_cont({q}, 0.25)"), ("q50", f"quantile_cont({q}, 0.5)"),
                     ("q75", f"quantile_cont({q}, 0.75)"), ("max", f"max({q})")):
            add("describe", c, m, e)
        for m, e in (("median", f"quantile_cont({q}, 0.5)"), ("variance", f"var_samp({q})"), ("std", f"stddev_samp({q})"),
                     ("cv", f"CASE WHEN avg({q}) <> 0 THEN stddev_samp({q}) / avg({q}) END"),
                     ("skew", skew_sql(q)), ("kurtosis", kurt_sql(q))):
            add("advanced", c, m, e)
        q1, q3 = f"(SELECT quantile_cont({q}, 0.25) FROM {src})", f"(SELECT quantile_cont({q}, 0.75) FROM {src})"
        add("outliers", c, "outliers", f"count(*) FILTER (WHERE {q} < {q1} - 1.5 * ({q3} - {q1}) OR {q} > {q3} + 1.5 * ({q3} - {q1}))")
    for c in txt:
        q = qi(c)
        first = (f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {q} AS v FROM {src} WHERE {q} IS NOT NULL "
                 f"ORDER BY v LIMIT 20))")
        add("text_uniques", c, "n_unique", f"count(DISTINCT {q})")
        add("text_uniques", c, "first_values", text=first, scalar=True)
        freq = f"(SELECT {q} AS v, count(*) AS n FROM {src} WHERE {q} IS NOT NULL GROUP BY {q})"
        add("text_describe", c, "count", f"count({q})")
        add("text_describe", c, "unique", f"count(DISTINCT {q})")
        add("text_describe", c, "top", text=f"(SELECT arg_min(v, (-n, v)) FROM {freq})", scalar=True)
        add("text_describe", c, "freq", f"(SELECT max(n) FROM {freq})", scalar=True)
        add("text_words", c, "avg_words", f"avg(len({words_sql(q)}))")
    for c in MISSING_COLS:
        add("missing", c, "null_count", f"count(*) - count({qi(c)})")
    return union_all(parts)


@query("profile_all", oracle=_profile_all_sql(), floats=("value",))
def q_profile_all(spark, d):
    return stats.profile_all(fixture(spark, d, "fx_missing"))


@query("numeric_columns", oracle=f"SELECT row_id, q_interp, p_mean, t_drop_rows, d_drop_col FROM {duck_fixture('fx_missing')}",
       floats=("q_interp", "p_mean", "t_drop_rows", "d_drop_col"))
def q_numeric_columns(spark, d):
    return plotdata.numeric_columns(fixture(spark, d, "fx_missing"))


@query("histogram", oracle=_hist_sql("lineitem", LI_NUM), floats=("bin_lo", "bin_hi", "density"))
def q_histogram(spark, d):
    return plotdata.histogram(read_table(spark, d, "lineitem"))


_CORR = LI_NUM + ["const", "empty_col"]
_CORR_SRC = "(SELECT *, CAST(5 AS DOUBLE) AS const, CAST(NULL AS DOUBLE) AS empty_col FROM lineitem)"


@query("correlation_matrix", oracle=union_all([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    + (f"CASE WHEN ({corr_sql(qi(a), qi(b))}) IS NOT NULL THEN 1.0 END" if a == b else corr_sql(qi(a), qi(b)))
    + f" AS corr FROM {_CORR_SRC}" for a in _CORR for b in _CORR]), floats=("corr",))
def q_correlation_matrix(spark, d):
    df = read_table(spark, d, "lineitem").withColumns({"const": F.lit(5.0), "empty_col": F.lit(None).cast("double")})
    return plotdata.correlation_matrix(df, _CORR)


@query("high_correlations", oracle=union_all([
    f"SELECT * FROM (SELECT '{a}' AS column_a, '{b}' AS column_b, round({corr_sql(qi(a), qi(b))}, 2) AS corr "
    f"FROM {duck_fixture('fx_ml')}) WHERE abs(corr) >= 0.6"
    for i, a in enumerate(["price", "cust_mod", "bal", "y_reg"]) for b in ["price", "cust_mod", "bal", "y_reg"][i + 1:]]),
    floats=("corr",))
def q_high_correlations(spark, d):
    return plotdata.high_correlations(fixture(spark, d, "fx_ml"), ["price", "cust_mod", "bal", "y_reg"])


@query("bar_means", oracle="SELECT *, row_number() OVER (ORDER BY mean DESC NULLS LAST, \"column\") AS rank FROM ("
       + per_column("lineitem", LI_NUM, "'{name}' AS \"column\", avg({c}) AS mean") + ")", floats=("mean",))
def q_bar_means(spark, d):
    return plotdata.bar_means(read_table(spark, d, "lineitem"))
