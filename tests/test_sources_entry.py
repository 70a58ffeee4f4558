import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import importing
from tabsense.sources import files
from tabsense.sources.tables import read_table

from tests.paths import SF


def test_csv_round_trip_and_types(spark):
    cust = read_table(spark, SF, "customer")
    path = files.export_csv(cust, files.scratch_path(spark, "t"))
    back = files.scan_csv(spark, path)
    assert dict(back.dtypes) == {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint",
                                 "c_acctbal": "double", "c_mktsegment": "string"}
    assert back.exceptAll(cust.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))).count() == 0


def test_infer_types_rules(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "a", None), ("2", None, "False", "b", None), (None, "3", "TRUE", "3", None)],
                               "i string, d string, b string, s string, e string")
    out = dict(files.infer_types(df).dtypes)
    assert out == {"i": "double", "d": "double", "b": "boolean", "s": "string", "e": "double"}


def test_json_array_and_nested(spark):
    folder = tempfile.mkdtemp(prefix="tabsense-test-", dir="/tmp")
    with open(os.path.join(folder, "a.json"), "w") as fh:
        json.dump([{"k": 1, "props": {"x": 2}}, {"k": 2, "props": {"x": 3}}], fh)
    df = files.scan_json(spark, folder)
    assert dict(df.dtypes) == {"k": "bigint", "props": "string"}
    assert sorted(r["props"] for r in df.collect()) == ['{"x":2}', '{"x":3}']


def test_encoding_and_admission(spark):
    folder = tempfile.mkdtemp(prefix="tabsense-test-", dir="/tmp")
    with open(os.path.join(folder, "u.csv"), "wb") as fh:
        fh.write("a,b\néte,1\n".encode("utf-8"))
    with open(os.path.join(folder, "l.CSV"), "wb") as fh:
        fh.write("a,b\nété,1\n".encode("latin-1"))
    with open(os.path.join(folder, "m.xlsm"), "wb") as fh:
        fh.write(b"x")
    with open(os.path.join(folder, "p.parquet"), "wb") as fh:
        fh.write(b"x")
    enc = {os.path.basename(r["path"]): r["encoding"] for r in files.encoding_check(spark, folder + "/*.*").collect()}
    assert enc["u.csv"] == "utf-8" and enc["l.CSV"] == "latin-1"
    for name, data in (("bom.csv", b"\xef\xbb\xbfa,b\n1,2\n"), ("bom_end.csv", b"\xef\xbb\xbfa,b\n1,2"), ("bom_bad.csv", b"\xef\xbb\xbfa\n\xe9\n"),
                       ("le.csv", "a,b\n1,é\n".encode("utf-16")), ("be.csv", b"\xfe\xff" + "a,b\n".encode("utf-16-be"))):
        with open(os.path.join(folder, name), "wb") as fh:
            fh.write(data)
    import gzip
    with gzip.open(os.path.join(folder, "z.csv.gz"), "wb") as fh:
        fh.write("a\né\n".encode() * 50)
    enc = {os.path.basename(r["path"]): r["encoding"] for r in files.encoding_check(spark, folder + "/*.*").collect()}
    assert {k: enc[k] for k in ("bom.csv", "bom_end.csv", "bom_bad.csv", "le.csv", "be.csv", "z.csv.gz")} == {
        "bom.csv": "utf-8-sig", "bom_end.csv": "utf-8-sig", "bom_bad.csv": "latin-1", "le.csv": "utf-16", "be.csv": "utf-16",
        "z.csv.gz": "utf-8"}
    adm = {os.path.basename(r["path"]): (r["accepted"], r["reason"]) for r in files.admit_inputs(spark, folder + "/*").collect()}
    assert adm["u.csv"] == (True, None) and adm["l.CSV"] == (True, None)
    assert adm["m.xlsm"] == (False, "macro_excel") and adm["p.parquet"] == (False, "unsupported_format")


def test_clean_import_text_rules(spark):
    df = spark.createDataFrame([(1, "  Éléphant ", "NA"), (2, "None", "x"), (3, " ", "ÇA")], "row_id long, `Nom Col!` string, b string")
    out = importing.clean_import(df).orderBy("row_id").toPandas()
    assert list(out.columns) == ["row_id", "nom_col", "b"]
    assert out["nom_col"].tolist()[0] == "elephant"
    assert pd.isna(out["nom_col"][1]) and pd.isna(out["nom_col"][2]) and pd.isna(out["b"][0])
    assert out["b"].tolist()[2] == "ca"


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_without_a_library_of_the_corpus_operators():
    import subprocess
    import sys
    code = ("import sys; sys.modules['zstandard'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 100 and not any(n.startswith('op') for n in q) and 'pipeline' not in q")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
