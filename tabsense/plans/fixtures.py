"""Test inputs derived from the driver tables (which hold no nulls).

Nulls, duplicates, outliers, dirty text and dates are injected by arithmetic
on natural keys: deterministic, no random numbers, and every view covers its
whole source table.  Each view is one SQL body that runs unchanged in Spark
SQL and in DuckDB.  Nullable numeric columns are DOUBLE (``fx_dups.d``) so
that both engines hand back the same value type for a null-bearing column.  The only difference is the positional ``row_id`` of
``lineitem``: DuckDB numbers rows with a window, Spark with
:func:`with_row_index` (no single-partition window).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tabsense.operators.rows import with_row_index
from tabsense.sources.tables import NATURAL_KEYS, read_table

DUCK_LINEITEM_ROWS = (
    "(SELECT *, CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS BIGINT)"
    " AS row_id FROM lineitem)")

FIXTURES: dict[str, str] = {
    "fx_missing": """
SELECT row_id,
  CASE WHEN row_id % 20 = 0 THEN NULL ELSE l_quantity END AS q_interp,
  CASE WHEN row_id % 5 = 0 THEN NULL ELSE l_extendedprice END AS p_mean,
  CASE WHEN row_id % 5 IN (0, 1) THEN NULL ELSE l_tax END AS t_drop_rows,
  CASE WHEN row_id % 2 = 0 THEN NULL ELSE l_discount END AS d_drop_col,
  CASE WHEN row_id % 10 = 3 THEN NULL ELSE l_returnflag END AS f_mode,
  CASE WHEN row_id % 20 = 7 THEN NULL ELSE l_shipdate END AS s_mode,
  l_linestatus AS full_col
FROM {lineitem_rows}""",
    "fx_dups": """
SELECT row_id, l_returnflag AS a, l_linestatus AS b, CAST(floor(row_id / 3) % 40 AS BIGINT) AS c,
  CASE WHEN row_id % 50 = 0 THEN NULL ELSE CAST(l_linenumber % 2 AS DOUBLE) END AS d
FROM {lineitem_rows}""",
    "fx_outliers_few": """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS x,
  CAST(o_custkey AS DOUBLE) AS y FROM {orders}""",
    "fx_outliers_many": """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS x,
  CAST(o_custkey AS DOUBLE) AS y FROM {orders}""",
    "fx_dirty_text": """
SELECT c_custkey AS row_id,
  CASE c_custkey % 10 WHEN 0 THEN 'NA' WHEN 1 THEN ' ' WHEN 2 THEN 'null' WHEN 3 THEN 'None'
    WHEN 4 THEN concat('  ', c_mktsegment, ' ') WHEN 5 THEN lower(c_mktsegment) WHEN 6 THEN 'Éléphant Çà'
    WHEN 7 THEN 'elephant ca' WHEN 8 THEN '' ELSE c_mktsegment END AS seg,
  c_acctbal AS bal
FROM {customer}""",
    "fx_dates": """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/d' ELSE concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
    lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) END AS date_fr,
  CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE concat(CAST(year(o_orderdate) AS STRING), '-',
    lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) END AS maybe_day,
  CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS ymd_int,
  CAST(o_orderkey % 7 AS BIGINT) AS update_count,
  o_orderdate AS native_ts
FROM {orders}""",
    "fx_constant": """
SELECT c_custkey AS row_id, CAST(5 AS DOUBLE) AS const, CAST(0 AS DOUBLE) AS zero,
  CAST(NULL AS DOUBLE) AS empty_col, CAST(c_nationkey AS DOUBLE) AS v FROM {customer}""",
    "fx_ml": """
SELECT o_orderkey AS row_id, o_totalprice AS price, CAST(o_custkey % 100 AS DOUBLE) AS cust_mod, c_acctbal AS bal,
  c_mktsegment AS segment, o_orderpriority AS priority, o_orderdate AS odate, o_orderstatus AS y_class,
  o_totalprice * 0.5 + c_acctbal AS y_reg
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "fx_catalog_original": """
SELECT concat('dataset_', lower(replace(c_name, '#', '_'))) AS table_name, concat(c_name, '.csv') AS original_filename,
  'csv' AS file_type, 'utf-8' AS encoding, CAST(c_custkey AS BIGINT) AS uploaded_seq FROM {customer}""",
    # every other original has a cleaned version (both branches of the
    # latest-dataset lookup are exercised); all catalog rows are read
    "fx_catalog_cleaned": """
SELECT concat('dataset_', lower(replace(c_name, '#', '_')), '_nettoye') AS table_name_cleaned,
  concat('dataset_', lower(replace(c_name, '#', '_'))) AS original_table, CAST(c_custkey AS BIGINT) AS uploaded_seq
FROM {customer} WHERE c_custkey % 2 = 0""",
    "fx_catalog_transformed": """
SELECT concat('dataset_transforme_', lower(replace(c_name, '#', '_'))) AS table_name_transformed,
  concat('dataset_', lower(replace(c_name, '#', '_')), '_nettoye') AS cleaned_table,
  CASE WHEN c_custkey % 4 = 0 THEN 'y' ELSE NULL END AS target_column, CAST(c_custkey AS BIGINT) AS uploaded_seq
FROM {customer} WHERE c_custkey % 2 = 0""",
}


# Row-indexed tables are made once per session and data folder (the index
# is part of the dataset, like the reference's stored table), then reused.
_INDEXED: dict[tuple, DataFrame] = {}


def _indexed(spark: SparkSession, data_dir: str, table: str) -> DataFrame:
    key = (id(spark), spark.sparkContext.applicationId, data_dir, table)
    if key not in _INDEXED:
        _INDEXED[key] = with_row_index(read_table(spark, data_dir, table), NATURAL_KEYS[table])
    return _INDEXED[key]


def fixture(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The fixture view ``name`` as a Spark DataFrame over ``data_dir``.
    Tables are passed to ``spark.sql`` as DataFrame arguments, so no view of
    the caller's session is created or replaced."""
    body = FIXTURES[name]
    args = {}
    for t in re.findall(r"\{(\w+)\}", body):
        args[t] = _indexed(spark, data_dir, "lineitem") if t == "lineitem_rows" else read_table(spark, data_dir, t)
    return spark.sql(body, **args)


def duck_fixture(name: str) -> str:
    """The same fixture as a DuckDB sub-query over the registered tables."""
    body = FIXTURES[name].replace("{lineitem_rows}", DUCK_LINEITEM_ROWS)
    return "(" + re.sub(r"\{(\w+)\}", r"\1", body) + ")"


def table_rows(spark: SparkSession, data_dir: str, table: str) -> DataFrame:
    """A driver table with a positional ``row_id`` in natural-key order."""
    return _indexed(spark, data_dir, table)


def duck_table_rows(table: str) -> str:
    keys = ", ".join(NATURAL_KEYS[table])
    return f"(SELECT CAST(row_number() OVER (ORDER BY {keys}) - 1 AS BIGINT) AS row_id, * FROM {table})"
