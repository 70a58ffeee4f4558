import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsense.operators.rows import scan_last, scan_neighbors, with_row_index
from tabsense.sources.tables import NATURAL_KEYS, read_table

from tests.paths import SF


def test_row_index_matches_row_number(spark):
    li = read_table(spark, SF, "lineitem")
    keys = NATURAL_KEYS["lineitem"]
    full = keys + [c for c in li.columns if c not in keys]   # sf0.001 has one repeated natural key
    a = with_row_index(li, keys, num_partitions=5)
    b = li.withColumn("rn", F.row_number().over(Window.orderBy(*full)) - 1)
    j = a.join(b, full)
    assert j.count() == li.count()
    assert j.where("row_id != rn").count() == 0


def _frame(spark, values):
    pdf = pd.DataFrame({"row_id": np.arange(len(values), dtype="int64"), "v": values})
    return spark.createDataFrame(pdf.astype({"v": "float64"}))


def test_scan_last_independent_of_bucket_size(spark):
    vals = [None, None, 1.0, None, 3.0, None, None, None, 7.0, None]
    df = _frame(spark, vals)
    want = pd.Series(vals, dtype="float64").ffill().tolist()
    for b in (1, 2, 3, 4, 1 << 20):
        got = scan_last(df, F.col("v"), "f", b).orderBy("row_id").toPandas()["f"].tolist()
        assert [None if pd.isna(x) else x for x in got] == [None if pd.isna(x) else x for x in want]


def test_scan_neighbors_prev_and_next(spark):
    vals = [None, 2.0, None, None, 5.0, None]
    df = _frame(spark, vals)
    for b in (1, 2, 5, 100):
        out = scan_neighbors(df, {"x": F.col("v")}, b).orderBy("row_id").toPandas()
        assert [None if pd.isna(x) else x for x in out["x__prev"]] == [None, 2.0, 2.0, 2.0, 5.0, 5.0]
        assert [None if pd.isna(x) else x for x in out["x__next"]] == [2.0, 2.0, 5.0, 5.0, 5.0, None]
