import pandas as pd
from pyspark.sql import functions as F

from tabsense.operators import report
from tabsense.plans.fixtures import fixture
from tabsense.sources import files
from tabsense.sources.tables import read_table
from tabsense.streaming.imports import read_imported, stream_import

from tests.paths import SF


def test_stream_import_processes_every_file_once(spark):
    root = files.scratch_path(spark, "stream-test")
    cust = read_table(spark, SF, "customer")
    cust.repartition(3).write.option("header", True).csv(f"{root}/landing")
    stream_import(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt").awaitTermination()
    # a second run with the same checkpoint finds nothing new
    stream_import(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt").awaitTermination()
    out = read_imported(spark, f"{root}/out")
    assert out.count() == cust.count()
    assert out.where(F.col("c_mktsegment") != F.lower(F.col("c_mktsegment"))).count() == 0


def test_report_null_summary_and_examples(spark):
    df = fixture(spark, SF, "fx_missing")
    r = report.report_null_summary(df).first()
    pdf = df.toPandas()
    cols = [c for c in pdf.columns if c != "row_id" and pdf[c].isna().any()]
    assert r["columns_with_nulls"] == len(cols)
    assert r["detail"].split(", ")[0].startswith(cols[0] + " (")
    ex = {x["column"]: x for x in report.report_text_examples(read_table(spark, SF, "documents")).collect()}
    assert len(ex["text"]["examples"]) <= 123 and ex["text"]["examples"].endswith("...")
    langs = sorted(read_table(spark, SF, "documents").select("lang").distinct().toPandas()["lang"])
    assert ex["lang"]["examples"] == ", ".join(langs[:5])


def test_report_sections_cover_all_parts(spark):
    secs = {r["section"] for r in report.report_sections(fixture(spark, SF, "fx_missing")).select("section").distinct().collect()}
    assert {"1 general", "2 column types", "3 categories", "4 missing values", "5 duplicates",
            "6 descriptive statistics", "7 advanced statistics", "8 text analysis"} <= secs
