"""Registered queries: report and transformed-dataset export."""

from __future__ import annotations

from tabsense.operators import features, report
from tabsense.plans.fixtures import duck_fixture, fixture
from tabsense.plans.registry import query
from tabsense.plans.sqlgen import qi, union_all
from tabsense.sources import files
from tabsense.sources.tables import read_table

_M = duck_fixture("fx_missing")
_MCOLS = ["q_interp", "p_mean", "t_drop_rows", "d_drop_col", "f_mode", "s_mode", "full_col"]
_NP = union_all([f"SELECT {i} AS ordinal, '{c}' AS c, count(*) - count({qi(c)}) AS n, "
                 f"round((count(*) - count({qi(c)})) * 100.0 / count(*), 2) AS pct FROM {_M}" for i, c in enumerate(_MCOLS)])


@query("report_null_summary", oracle=f"""
SELECT CAST(count(*) AS BIGINT) AS columns_with_nulls, string_agg(c || ' (' || CAST(pct AS VARCHAR) || '%)', ', ' ORDER BY ordinal) AS detail
FROM ({_NP}) WHERE n > 0""")
def q_report_null_summary(spark, d):
    return report.report_null_summary(fixture(spark, d, "fx_missing"))


def _examples(c: str) -> str:
    first = f"(SELECT DISTINCT {c} AS v FROM documents WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)"
    j = f"(SELECT string_agg(v, ', ' ORDER BY v) FROM {first})"
    return (f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, "
            f"CASE WHEN length({j}) > 120 THEN substr({j}, 1, 120) || '...' ELSE {j} END AS examples FROM documents")


@query("report_text_examples", oracle=union_all([_examples(c) for c in ["text", "lang", "source"]]))
def q_report_text_examples(spark, d):
    return report.report_text_examples(read_table(spark, d, "documents"))




_ML = duck_fixture("fx_ml")
_CODES = {c: f"(SELECT {c} AS cls, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT "
             f"coalesce(CAST({c} AS VARCHAR), 'None') AS {c} FROM {_ML}))" for c in ["segment", "priority", "y_class"]}


@query("export_transformed", oracle=f"""
SELECT m.row_id, m.price, m.cust_mod, m.bal, s.idx AS segment, p.idx AS priority, m.odate, y.idx AS y_class, m.y_reg
FROM {_ML} m JOIN {_CODES['segment']} s ON s.cls = m.segment JOIN {_CODES['priority']} p ON p.cls = m.priority
JOIN {_CODES['y_class']} y ON y.cls = m.y_class""", floats=("price", "cust_mod", "bal", "y_reg"))
def q_export_transformed(spark, d):
    encoded = features.label_encode(fixture(spark, d, "fx_ml"))[0]
    path = files.export_parquet(encoded, files.scratch_path(spark, "transformed"))
    return spark.read.parquet(path)


def _report_sections_sql() -> str:
    """report_sections on fx_missing, section by section."""
    from tabsense.functions.dates import duck_parse_any
    from tabsense.plans.sqlgen import kurt_sql, skew_sql
    src = _M
    num = ["q_interp", "p_mean", "t_drop_rows", "d_drop_col"]
    txt = ["f_mode", "full_col"]
    parts = []

    def add(section, item, metric, value=None, text=None, frm=None):
        v = f"CAST({value} AS DOUBLE)" if value is not None else "CAST(NULL AS DOUBLE)"
        t = text if text is not None else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{section}' AS section, '{item}' AS item, '{metric}' AS metric, {v} AS value, "
                     f"{t} AS text FROM {frm or src}")

    one = "(SELECT 1) AS one"
    add("1 general", "dataset", "rows", "count(*)")
    add("1 general", "dataset", "columns", str(len(_MCOLS)), frm=one)
    for c in _MCOLS:
        q = qi(c)
        add("2 column types", c, "dtype", text=f"CASE any_value(typeof({q})) WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' "
                                             f"THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN "
                                             f"'timestamp_ntz' END")
        if c in num:
            add("3 categories", c, "category", text="'numeric'", frm=one)
        elif c == "s_mode":
            add("3 categories", c, "category", text="'date'", frm=one)
        else:
            add("3 categories", c, "category",
                text=f"CASE WHEN count({duck_parse_any(q)}) >= 0.8 * count(*) THEN 'date' ELSE 'text' END")
        add("4 missing values", c, "null_count", f"count(*) - count({q})")
        add("4 missing values", c, "null_pct", f"round((count(*) - count({q})) * 100.0 / count(*), 2)")
    keys = ", ".join(_MCOLS)
    same = " AND ".join(f"{c} = lag({c}) OVER w" for c in _MCOLS)
    join = " AND ".join(f"r.{c} IS NOT DISTINCT FROM g.{c}" for c in _MCOLS)
    counts = f"(SELECT {keys}, count(*) AS cnt FROM {src} GROUP BY ALL)"
    runs = (f"(SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (ORDER BY row_id) AS grp FROM ("
            f"SELECT *, coalesce({same}, false) AS same FROM {src} WINDOW w AS (ORDER BY row_id)))")
    groups = f"(SELECT grp, count(*) AS n FROM {runs} GROUP BY grp HAVING count(*) > 1)"
    in_runs = f"(SELECT r.row_id FROM {runs} r JOIN {groups} g ON r.grp = g.grp)"
    scattered = (f"(SELECT DISTINCT {', '.join('r.' + c for c in _MCOLS)} FROM {src} r JOIN {counts} g ON {join} "
                 f"WHERE g.cnt > 1 AND r.row_id NOT IN (SELECT row_id FROM {in_runs}))")
    add("5 duplicates", "dataset", "scattered_rows", f"(SELECT count(*) FROM {scattered})", frm=one)
    add("5 duplicates", "dataset", "run_groups", f"(SELECT count(*) FROM {groups})", frm=one)
    add("5 duplicates", "dataset", "rows_in_runs", f"(SELECT coalesce(sum(n), 0) FROM {groups})", frm=one)
    add("5 duplicates", "dataset", "duplicated_rows", f"(SELECT coalesce(sum(cnt), 0) FROM {counts} WHERE cnt > 1)", frm=one)
    for c in num:
        q = qi(c)
        for m, e in (("count", f"count({q})"), ("mean", f"avg({q})"), ("std", f"stddev_samp({q})"), ("min", f"min({q})"),
                     ("q25", f"quantile_cont({q}, 0.25)"), ("q50", f"quantile_cont({q}, 0.5)"),
                     ("q75", f"quantile_cont({q}, 0.75)"), ("max", f"max({q})")):
            add("6 descriptive statistics", c, m, e)
        for m, e in (("median", f"quantile_cont({q}, 0.5)"), ("variance", f"var_samp({q})"), ("std", f"stddev_samp({q})"),
                     ("cv", f"CASE WHEN avg({q}) <> 0 THEN stddev_samp({q}) / avg({q}) END"),
                     ("skew", skew_sql(q)), ("kurtosis", kurt_sql(q))):
            add("7 advanced statistics", c, m, e)
    for c in txt:
        q = qi(c)
        first = (f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {q} AS v FROM {src} WHERE {q} IS NOT NULL "
                 f"ORDER BY v LIMIT 5))")
        add("8 text analysis", c, "n_unique", f"count(DISTINCT {q})")
        add("8 text analysis", c, "examples",
            text=f"CASE WHEN length({first}) > 120 THEN substr({first}, 1, 120) || '...' ELSE {first} END", frm=one)
    return union_all(parts)


@query("report_sections", oracle=_report_sections_sql(), floats=("value",))
def q_report_sections(spark, d):
    return report.report_sections(fixture(spark, d, "fx_missing"))
