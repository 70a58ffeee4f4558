"""Registered queries: scans, sinks, catalog and import cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.functions.dates import PY_DATE_FORMATS, duck_parse_any
from tabsense.functions.text import NULL_TOKENS
from tabsense.operators import importing
from tabsense.plans.fixtures import duck_fixture, fixture
from tabsense.plans.registry import query
from tabsense.plans.sqlgen import union_all
from tabsense.sources import catalog, files
from tabsense.sources.tables import read_table

_DT = duck_fixture("fx_dirty_text")
_DATES = duck_fixture("fx_dates")
_TOK = ", ".join("'" + t + "'" for t in NULL_TOKENS)
_CUSTOMER_TYPED = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
                   "FROM customer")


@query("snake_case_columns", oracle=f"SELECT row_id, seg AS segment_name, bal AS accountbalance_eur FROM {_DT}",
       floats=("accountbalance_eur",))
def q_snake_case_columns(spark, d):
    messy = fixture(spark, d, "fx_dirty_text").toDF("row_id", "  Segment Name ", "Account-Balance (EUR)")
    return importing.snake_case_columns(messy)


@query("null_tokens", oracle=f"SELECT row_id, CASE WHEN seg IN ({_TOK}) THEN NULL ELSE seg END AS seg, bal FROM {_DT}",
       floats=("bal",))
def q_null_tokens(spark, d):
    return importing.null_tokens(fixture(spark, d, "fx_dirty_text"))


@query("normalize_text", oracle=f"SELECT row_id, lower(trim(strip_accents(seg))) AS seg, bal FROM {_DT}",
       floats=("bal",))
def q_normalize_text(spark, d):
    from tabsense.functions.text import normalize_text
    df = fixture(spark, d, "fx_dirty_text")
    return df.withColumn("seg", normalize_text(F.col("seg")))


@query("uniformize_categories", oracle=f"""
SELECT c_custkey, lower(trim(strip_accents(c_name))) AS c_name, c_nationkey, c_acctbal,
  lower(trim(strip_accents(c_mktsegment))) AS c_mktsegment FROM customer""", floats=("c_acctbal",))
def q_uniformize_categories(spark, d):
    return importing.uniformize_categories(read_table(spark, d, "customer"))


def _format_vote_sql(c: str) -> str:
    first = f"(SELECT trim({c}) AS v FROM {_DATES} WHERE {c} IS NOT NULL)"
    counts = ", ".join(f"count(try_strptime(v, '{f}')) AS f{i}" for i, f in enumerate(PY_DATE_FORMATS))
    # the first format (list order) with the largest count above half wins
    picks = " ".join(
        f"WHEN f{i} > n / 2 AND " + " AND ".join([f"f{i} >= f{j}" for j in range(len(PY_DATE_FORMATS)) if j > i] +
                                                 [f"f{i} > f{j}" for j in range(i)] or ["TRUE"])
        + f" THEN '{f}'" for i, f in enumerate(PY_DATE_FORMATS))
    return f"SELECT '{c}' AS \"column\", CASE {picks} END AS format FROM (SELECT count(*) AS n, {counts} FROM {first})"


@query("detect_date_format", oracle=union_all([_format_vote_sql(c) for c in ["date_fr", "maybe_day"]]))
def q_detect_date_format(spark, d):
    return importing.date_format_table(fixture(spark, d, "fx_dates"))


@query("convert_date_columns", oracle=f"""
SELECT row_id, try_strptime(trim(date_fr), '%d/%m/%Y') AS date_fr, maybe_day, ymd_int, update_count, native_ts FROM {_DATES}""")
def q_convert_date_columns(spark, d):
    return importing.convert_date_columns(fixture(spark, d, "fx_dates"))


@query("normalize_dates", oracle=f"""
SELECT row_id, strftime({duck_parse_any('date_fr')}, '%Y-%m-%d') AS date_fr, maybe_day, ymd_int, update_count,
  strftime(native_ts, '%Y-%m-%d') AS native_ts FROM {_DATES}""")
def q_normalize_dates(spark, d):
    return importing.normalize_dates(fixture(spark, d, "fx_dates"))


@query("clean_import", oracle=f"""
SELECT row_id, CASE WHEN s IN ({_TOK}) THEN NULL ELSE s END AS segment, bal AS balance FROM (
  SELECT row_id, lower(trim(strip_accents(CASE WHEN seg IN ({_TOK}) THEN NULL ELSE seg END))) AS s, bal FROM {_DT})""",
       floats=("balance",))
def q_clean_import(spark, d):
    return importing.clean_import(fixture(spark, d, "fx_dirty_text").toDF("row_id", "Segment", "Balance"))


@query("scan_csv", oracle=f"SELECT row_id, CASE WHEN seg IN ({_TOK}) THEN NULL ELSE seg END AS seg, bal FROM {_DT}",
       floats=("bal",))
def q_scan_csv(spark, d):
    path = files.export_csv(fixture(spark, d, "fx_dirty_text").withColumnRenamed("row_id", "rid"),
                            files.scratch_path(spark, "csv"))
    return files.scan_csv(spark, path).withColumnRenamed("rid", "row_id")


@query("infer_types", oracle=_CUSTOMER_TYPED, floats=("c_acctbal",))
def q_infer_types(spark, d):
    cust = read_table(spark, d, "customer")
    as_text = cust.select(*[F.col(c).cast("string").alias(c) for c in cust.columns])
    return files.infer_types(as_text)


@query("scan_json", oracle=_CUSTOMER_TYPED, floats=("c_acctbal",))
def q_scan_json(spark, d):
    path = files.scratch_path(spark, "json")
    read_table(spark, d, "customer").write.json(path)
    return files.scan_json(spark, path)


def _upload(path: str, key: str):
    """The upload that a part file belongs to: (its kind, its key) from .../<kind>/<key>=<value>/part-..."""
    return (F.regexp_extract(path, rf"([^/]*)/{key}=[^/]*/[^/]*$", 1).alias("upload"),
            F.regexp_extract(path, rf"{key}=([^/]*)/[^/]*$", 1).alias(key))


@query("admit_inputs", oracle="""
SELECT upload, CAST(c_nationkey AS BIGINT) AS c_nationkey, upload <> 'parquet' AS accepted,
  CASE WHEN upload = 'parquet' THEN 'unsupported_format' END AS reason
FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest(['csv', 'json', 'parquet']) AS upload)""")
def q_admit_inputs(spark, d):
    """The customers of every nation as a CSV, a JSON and a Parquet upload, each of part files: the verdict on each upload
    (refused when a part is, for the first reason in the alphabet)."""
    root = files.scratch_path(spark, "uploads")
    cust = read_table(spark, d, "customer")
    # parts of at most 100,000 rows stay below the size limit whatever the table
    write = lambda: cust.write.partitionBy("c_nationkey").option("maxRecordsPerFile", 100_000)
    write().option("header", True).csv(f"{root}/csv")
    write().json(f"{root}/json")
    write().parquet(f"{root}/parquet")
    parts = files.admit_inputs(spark, f"{root}/*/*/part-*")
    verdicts = parts.select(*_upload("path", "c_nationkey"), "accepted", "reason").groupBy("upload", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    return verdicts.agg(F.bool_and("accepted").alias("accepted"), F.min("reason").alias("reason"))


@query("encoding_check", oracle=r"""
SELECT upload, lang, CASE WHEN upload = 'latin1' AND bool_or(regexp_matches(text, '[\x{80}-\x{FF}]')) THEN 'latin-1' ELSE 'utf-8' END AS encoding
FROM documents, (SELECT unnest(['utf8', 'latin1']) AS upload) WHERE lang IS NOT NULL GROUP BY upload, lang""")
def q_encoding_check(spark, d):
    """The texts of every language written as a UTF-8 and as a Latin-1 upload, each of part files: the encoding of each
    upload (Latin-1 when a part is)."""
    root = files.scratch_path(spark, "enc")
    texts = read_table(spark, d, "documents").where("lang IS NOT NULL").select("lang", "text")
    texts.write.partitionBy("lang").text(f"{root}/utf8")
    texts.write.partitionBy("lang").option("encoding", "ISO-8859-1").option("header", False).csv(f"{root}/latin1")
    parts = files.encoding_check(spark, f"{root}/*/*/part-*").select(*_upload("path", "lang"), "encoding")
    return parts.groupBy("upload", "lang").agg(F.min("encoding").alias("encoding"))


@query("map_types", oracle="""
SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'BIGINT'
  WHEN column_type IN ('DOUBLE', 'FLOAT') OR column_type LIKE 'DECIMAL%' THEN 'DOUBLE PRECISION'
  WHEN column_type = 'BOOLEAN' THEN 'BOOLEAN' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'TIMESTAMP'
  ELSE 'TEXT' END AS storage_type FROM (DESCRIBE lineitem)""")
def q_map_types(spark, d):
    return files.map_types(read_table(spark, d, "lineitem"))


@query("write_table", oracle="SELECT * FROM orders", floats=("o_totalprice",))
def q_write_table(spark, d):
    """Two versions of a table: the second replaces the first in one commit."""
    path = files.scratch_path(spark, "table")
    orders = read_table(spark, d, "orders")
    files.write_table(orders.where("o_orderkey < 0"), path)
    files.write_table(orders, path)
    return files.read_written(spark, path)


@query("export_csv", oracle=_CUSTOMER_TYPED, floats=("c_acctbal",))
def q_export_csv(spark, d):
    path = files.export_csv(read_table(spark, d, "customer"), files.scratch_path(spark, "export"))
    return files.scan_csv(spark, path)


_ORIG = duck_fixture("fx_catalog_original")
_CLEAN = duck_fixture("fx_catalog_cleaned")
_TRANS = duck_fixture("fx_catalog_transformed")


def _dsuffix(*parts: str) -> str:
    return "substr(sha256(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8)"


@query("register_dataset", oracle=f"""
SELECT concat('dataset_', regexp_replace(lower(regexp_extract(original_filename, '^(.*)\\.[^.]*$', 1)), '\\W+', '_', 'g'),
  '_', {_dsuffix('original_filename', 'uploaded_seq')}) AS table_name, original_filename,
  lower(regexp_extract(original_filename, '([^.]*)$', 1)) AS file_type, uploaded_seq FROM {_ORIG}""")
def q_register_dataset(spark, d):
    return catalog.register_dataset(fixture(spark, d, "fx_catalog_original"))


# re-registering every fourth cleaned table later: the newer row must win
# (the modulo chooses which catalog rows are updated; it is the test data
# model, not a size cap -- every catalog row is read)
_UPD = f"(SELECT table_name_cleaned, original_table, uploaded_seq + 100000 AS uploaded_seq FROM {_CLEAN} WHERE uploaded_seq % 4 = 0)"


@query("register_cleaned", oracle=f"""
SELECT table_name_cleaned, original_table, max(uploaded_seq) AS uploaded_seq FROM (
  SELECT * FROM {_CLEAN} UNION ALL SELECT * FROM {_UPD}) GROUP BY ALL""")
def q_register_cleaned(spark, d):
    cl = fixture(spark, d, "fx_catalog_cleaned")
    upd = cl.where(F.col("uploaded_seq") % 4 == 0).withColumn("uploaded_seq", F.col("uploaded_seq") + 100000)
    return catalog.register_cleaned(cl, upd)


@query("register_transformed", oracle=f"""
SELECT concat('dataset_transforme_', {_dsuffix('cleaned_table', 'uploaded_seq')},
  regexp_replace(regexp_replace(lower(cleaned_table), '^dataset', ''), '\\W+', '_', 'g')) AS table_name_transformed,
  cleaned_table, uploaded_seq FROM {_TRANS}""")
def q_register_transformed(spark, d):
    return catalog.register_transformed(fixture(spark, d, "fx_catalog_transformed"))


@query("latest_dataset", oracle=f"""
SELECT o.table_name, o.original_filename, coalesce(c.table_name_cleaned, o.table_name) AS read_table, o.uploaded_seq
FROM (SELECT * FROM {_ORIG} ORDER BY uploaded_seq DESC LIMIT 1) o LEFT JOIN {_CLEAN} c ON c.original_table = o.table_name""")
def q_latest_dataset(spark, d):
    return catalog.latest_dataset(fixture(spark, d, "fx_catalog_original"), fixture(spark, d, "fx_catalog_cleaned"))


@query("latest_dataset_opened", oracle="SELECT * FROM customer", floats=("c_acctbal",))
def q_latest_dataset_opened(spark, d):
    """The customer table registered, written under its catalog name and opened as the latest dataset."""
    root = files.scratch_path(spark, "datasets")
    original, cleaned = fixture(spark, d, "fx_catalog_original"), fixture(spark, d, "fx_catalog_cleaned")
    name = catalog.latest_dataset(original, cleaned).first()["read_table"]
    files.write_table(read_table(spark, d, "customer"), f"{root}/{name}")
    return catalog.open_latest_dataset(original, cleaned, root)


@query("latest_transformed", oracle=f"""
SELECT t.table_name_transformed, t.cleaned_table, c.original_table, t.target_column, t.uploaded_seq
FROM (SELECT * FROM {_TRANS} ORDER BY uploaded_seq DESC LIMIT 1) t JOIN {_CLEAN} c ON c.table_name_cleaned = t.cleaned_table""")
def q_latest_transformed(spark, d):
    return catalog.latest_transformed(fixture(spark, d, "fx_catalog_transformed"),
                                      fixture(spark, d, "fx_catalog_cleaned"))


@query("retention_candidates", oracle=f"""
SELECT 'original' AS family, table_name FROM (
  SELECT table_name, row_number() OVER (ORDER BY uploaded_seq DESC) AS rn FROM {_ORIG} WHERE table_name LIKE 'dataset\\_%' ESCAPE '\\')
  WHERE rn > 2
UNION ALL SELECT 'cleaned', table_name_cleaned FROM (
  SELECT c.table_name_cleaned, row_number() OVER (ORDER BY o.uploaded_seq DESC) AS rn
  FROM {_CLEAN} c JOIN {_ORIG} o ON o.table_name = c.original_table) WHERE rn > 2
UNION ALL SELECT 'transformed', table_name_transformed FROM (
  SELECT table_name_transformed, row_number() OVER (ORDER BY uploaded_seq DESC) AS rn FROM {_TRANS}) WHERE rn > 2""")
def q_retention_candidates(spark, d):
    return catalog.retention_candidates(fixture(spark, d, "fx_catalog_original"),
                                        fixture(spark, d, "fx_catalog_cleaned"),
                                        fixture(spark, d, "fx_catalog_transformed"))


@query("stream_import", oracle="SELECT c_custkey, lower(c_name) AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
                               "c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer", floats=("c_acctbal",))
def q_stream_import(spark, d):
    """Customer rows dropped as CSV into a landing folder, imported by the stream."""
    from tabsense.streaming.imports import read_imported, stream_import
    root = files.scratch_path(spark, "stream")
    read_table(spark, d, "customer").write.option("header", True).csv(f"{root}/landing")
    q = stream_import(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    out = read_imported(spark, f"{root}/out")
    return out.select("c_custkey", "c_name", F.col("c_nationkey").cast("long"), "c_acctbal", "c_mktsegment")
