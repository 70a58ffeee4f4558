"""A third of all rows share one value: results must stay exact and whole."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsense.operators import cleaning, profile, stats
from tabsense.operators.quantiles import column_modes
from tabsense.plans.fixtures import table_rows

from tests.paths import SF


def _hot(spark):
    li = table_rows(spark, SF, "lineitem")
    hot = F.col("row_id") % 3 == 0
    return li.select("row_id",
                     F.when(hot, F.lit("HOT")).otherwise(F.col("l_returnflag")).alias("flag"),
                     F.when(hot, F.lit(1.0)).otherwise(F.col("l_quantity")).alias("qty"))


def test_duplicates_with_a_hot_row(spark):
    df = _hot(spark)
    pdf = df.orderBy("row_id").toPandas()
    keys = ["flag", "qty"]
    assert profile.duplicate_rows(df).count() == int(pdf.duplicated(subset=keys, keep=False).sum())
    kept = cleaning.drop_duplicates(df).toPandas()
    want = pdf.drop_duplicates(subset=keys, keep="first")
    assert sorted(kept["row_id"]) == sorted(want["row_id"])
    groups = cleaning.duplicate_groups(df).where("flag = 'HOT' AND qty = 1.0")
    assert groups.count() == int(((pdf.flag == "HOT") & (pdf.qty == 1.0)).sum())
    assert groups.select(F.countDistinct("kept_row_id")).first()[0] == 1


def test_modes_and_text_stats_with_a_hot_value(spark):
    df = _hot(spark)
    pdf = df.toPandas()
    assert column_modes(df, ["flag"])["flag"] == "HOT"
    d = stats.text_describe(df, ["flag"]).first()
    assert d["top"] == "HOT" and d["freq"] == int((pdf.flag == "HOT").sum())
    assert d["unique"] == pdf.flag.nunique()


def test_quartiles_with_a_hot_value(spark):
    df = _hot(spark)
    pdf = df.toPandas()
    got = stats.describe_numeric(df, ["qty"]).first()
    q = pdf["qty"].quantile([0.25, 0.5, 0.75]).tolist()
    assert [got["q25"], got["q50"], got["q75"]] == q
