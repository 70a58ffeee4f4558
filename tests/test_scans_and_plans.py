import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import cleaning, importing, plotdata
from tabsense.sources import files


def _analysed_scans(df):
    return df._jdf.queryExecution().analyzed().toString().count("LogicalRDD") + \
        df._jdf.queryExecution().analyzed().toString().count("LocalRelation") + df._jdf.queryExecution().analyzed().toString().count("Relation [")


def test_clean_missing_plan_is_linear_in_columns(spark):
    n, p = 200, 40
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(n, p)), columns=[f"c{i}" for i in range(p)])
    for i in range(p):
        pdf.loc[i:i + 9, f"c{i}"] = np.nan
    pdf.insert(0, "row_id", range(n))
    df = spark.createDataFrame(pdf).select("row_id", *[F.nanvl(f"c{i}", F.lit(None).cast("double")).alias(f"c{i}") for i in range(p)])
    out = cleaning.clean_missing(df, bucket_rows=16)
    assert _analysed_scans(out) <= 4
    got = out.orderBy("row_id").toPandas()
    want = pdf.interpolate()
    assert np.allclose(got.fillna(-9).values, want.fillna(-9).values)


def _write(tmp_path, name, data, encoding="utf-8"):
    path = os.path.join(tmp_path, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(data)
    return path


def test_scan_csv_as_users_write_it(spark, tmp_path):
    pdf = pd.DataFrame({"name": ['he said "hi", ok', "two\nlines", "N/A", "é"], "code": ["1D", "2F", "7D", "8"], "x": ["1.5", "N/A", "", "2"]})
    path = _write(tmp_path, "a.csv", pdf.to_csv(index=False))
    got = files.scan_csv(spark, path, multi_line=True).toPandas()
    want = pd.read_csv(path)
    assert got["name"].tolist()[:2] == want["name"].tolist()[:2] and got["name"].isna().tolist() == want["name"].isna().tolist()
    assert got["code"].tolist() == ["1D", "2F", "7D", "8"]
    assert got["x"].tolist()[0] == 1.5 and got["x"].isna().tolist() == [False, True, True, False]


def test_scan_csv_encoding_fallback(spark, tmp_path):
    path = _write(tmp_path, "latin.csv", "a,b\né,1\nç,2\n", "latin-1")
    assert files.scan_csv(spark, path).toPandas()["a"].tolist() == ["é", "ç"]


def test_export_csv_reads_back(spark, tmp_path):
    rows = [('a "quoted" word', "x,y"), ("plain", "  spaced ")]
    out = files.export_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "out"))
    part = next(os.path.join(out, f) for f in os.listdir(out) if f.startswith("part-"))
    frames = [pd.read_csv(os.path.join(out, f)) for f in os.listdir(out) if f.startswith("part-")]
    assert part and sorted(map(tuple, pd.concat(frames).values.tolist())) == sorted(rows)


def test_file_order_and_the_whole_import(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    rows = [(i, f"{i % 28 + 1:02d}/03/2020" if i % 9 else "", "Été " if i % 2 else "NA", "" if i % 20 == 3 else str(i * 0.5)) for i in range(400)]
    for part in range(4):
        text = "id,Order Date,Seg,val\n" + "".join(f"{a},{b},{c},{d}\n" for a, b, c, d in rows[part * 100:(part + 1) * 100])
        _write(str(folder), f"p{part}.csv", text)
    scanned = files.scan_csv(spark, str(folder), row_ids=True)
    cleaned = cleaning.clean_missing(importing.clean_import(scanned))
    got = cleaned.orderBy("row_id").toPandas()
    assert got["id"].tolist() == got["row_id"].tolist() == list(range(400))
    assert str(cleaned.schema["order_date"].dataType) == "TimestampType()"
    assert np.allclose(got["val"], [i * 0.5 for i in range(400)])


def test_date_vote_uses_all_values(spark):
    values = ["05/06/2020"] * 60 + ["2020-06-25"] * 200
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, a_date string")
    assert importing.detect_date_format(df, "a_date") == "%Y-%m-%d"


def test_histogram_has_every_bin(spark):
    got = plotdata.histogram(spark.createDataFrame([(0.0,), (0.0,), (0.0,), (30.0,)], "x double")).orderBy("bin").toPandas()
    assert got["count"].tolist() == [3] + [0] * 28 + [1]


@pytest.mark.parametrize("n", [99_999, 100_001])
def test_plots_mean_the_same_at_every_size(spark, n):
    df = spark.range(n).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert plotdata.scatter(df, "x", "y").count() == n
    assert plotdata.line_series(df, "x").columns == ["row_id", "value"]


def test_bar_means_are_ranked(spark):
    df = spark.createDataFrame([(1.0, 5.0, 3.0, None)], "a double, b double, c double, d double")
    assert [(r["column"], r["rank"]) for r in plotdata.bar_means(df).collect()] == [("b", 1), ("c", 2), ("a", 3), ("d", 4)]


def test_statistics_take_nan_for_null(spark):
    from tabsense.operators import stats
    df = spark.createDataFrame([(float(i),) for i in range(5)] + [(float("nan"),)], "x double")
    row = stats.describe_numeric(df).first()
    assert (row["count"], row["mean"], row["max"], row["q50"]) == (5, 2.0, 4.0, 2.0)
    assert stats.describe_advanced(df).first()["variance"] == pytest.approx(2.5)


def test_stream_keeps_the_first_types(spark, tmp_path):
    from tabsense.streaming.imports import read_imported, stream_import
    landing, out, ckpt = (str(tmp_path / n) for n in ("landing", "out", "ckpt"))
    os.makedirs(landing)
    _write(landing, "a.csv", "k,a date,v\n1,01/02/2020,x\n2,13/02/2020,Y\n")
    stream_import(spark, landing, out, ckpt).awaitTermination()
    _write(landing, "b.csv", "k,a date,v\nseven,2020-05-06,z\n8,03/04/2020,w\n")
    stream_import(spark, landing, out, ckpt).awaitTermination()
    got = {r["v"]: r for r in read_imported(spark, out).collect()}
    assert [got[v]["k"] for v in "xyzw"] == [1, 2, None, 8]
    assert [got[v]["a_date"] and got[v]["a_date"].day for v in "xyzw"] == [1, 13, None, 3]


def test_scratch_scope_removes_its_files(spark):
    from tabsense.session import checkpoint_dir, materialize, scratch_scope
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tabsense-mat"
    kept = materialize(spark.range(3), "kept")
    with scratch_scope(spark):
        assert materialize(spark.range(5), "scoped").count() == 5
        assert any(n.startswith("scoped-") for n in os.listdir(folder))
    assert not any(n.startswith("scoped-") for n in os.listdir(folder)) and kept.count() == 3


def test_encoding_check_scans_lines(spark, tmp_path):
    texts = {"a": "é\r\nb\n".encode(), "b": b"\xef\xbb\xbfx\n", "c": b"\xef\xbb\xbfx\ny", "d": b"ok\n" * 9 + b"\xe9", "f": b"\n\n", "g": b"\xef\xbb\xbf"}
    for name, data in texts.items():
        (tmp_path / f"part {name}.txt").write_bytes(data)
    got = files.encoding_check(spark, f"{tmp_path}/part*")
    assert {r["path"][-5]: r["encoding"] for r in got.collect()} == {
        "a": "utf-8", "b": "utf-8-sig", "c": "utf-8-sig", "d": "latin-1", "f": "utf-8", "g": "utf-8-sig"}
    assert "content" not in got._jdf.queryExecution().sparkPlan().toString()  # no file is one row


def test_uploads_of_many_parts(spark, tmp_path, monkeypatch):
    from tabsense.plans import q_import
    for t in ("documents", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").repartition(4).write.parquet(f"{tmp_path}/{t}.parquet")
    written, scratch = [], files.scratch_path
    monkeypatch.setattr(files, "scratch_path", lambda *a: written.append(scratch(*a)) or written[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        got = [{tuple(r) for r in q(spark, str(tmp_path)).collect()} for q in (q_import.q_encoding_check, q_import.q_admit_inputs)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == {(kind, lang, code) for kind, code in (("utf8", "utf-8"), ("latin1", "latin-1")) for lang in ("de", "en", "es", "fr")}
    assert got[1] == {(kind, n, kind != "parquet", "unsupported_format" if kind == "parquet" else None) for kind in ("csv", "json", "parquet") for n in range(25)}
    for folder in (f"{written[0]}/utf8", f"{written[0]}/latin1", f"{written[1]}/csv", f"{written[1]}/json"):
        assert spark.read.format("binaryFile").load(f"{folder}/*/part-*").select("path").count() > 8
