"""NaN is missing, as null is: every operator gives what it gives for a null there."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import cleaning, features, plotdata, profile


@pytest.fixture(scope="module")
def both(spark):
    """A table with NaN, and the same with nulls."""
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=200), rng.normal(size=200)
    x[5], x[17], x[40], z[3] = np.nan, np.nan, 50.0, np.nan
    pdf = pd.DataFrame({"row_id": range(200), "x": x, "z": z, "k": [f"k{i % 3}" for i in range(200)]})
    nan = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "row_id long, x double, z double, k string")
    assert nan.where(F.isnan("x")).count() == 2
    return nan, nan.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x", "z")}), pdf


def rows(df):
    return sorted(map(repr, (tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.collect())))


@pytest.mark.parametrize("name,run", [
    ("outlier_rows", cleaning.outlier_rows), ("remove_outlier_rows", cleaning.remove_outlier_rows), ("winsorize", cleaning.winsorize),
    ("treat_outliers", lambda d: cleaning.treat_outliers(d)[0]), ("fill_mean", lambda d: cleaning.fill_mean(d, "x")),
    ("fill_mode", lambda d: cleaning.fill_mode(d, "x")), ("drop_null_rows", lambda d: cleaning.drop_null_rows(d, "x")),
    ("clean_missing", cleaning.clean_missing), ("preprocess_full", lambda d: cleaning.preprocess_full(d)[0]),
    ("cleaning_diff", lambda d: cleaning.cleaning_diff(d, d.where("row_id > 40"))),
    ("box_outliers", plotdata.box_outliers), ("histogram_markers", plotdata.histogram_markers), ("bar_means", plotdata.bar_means),
    ("histogram", plotdata.histogram), ("box_stats", plotdata.box_stats), ("null_profile", profile.null_profile),
    ("standardize", lambda d: features.standardize(d)[0]), ("scaler_table", lambda d: features.scaler_table(d, ["x", "z"])),
    ("transform_dataset", lambda d: features.transform_dataset(d)[0])])
def test_nan_is_null(both, name, run):
    nan, null, _ = both
    got = rows(run(nan))
    assert got == rows(run(null)) and "nan" not in "".join(got)


def test_against_pandas(both):
    nan, _, pdf = both
    assert cleaning.fill_mean(nan, "x").where("row_id = 5").first()["x"] == pytest.approx(pdf["x"].mean())
    assert [r["row_id"] for r in cleaning.outlier_rows(nan, ["x"]).collect()].count(5) == 0
    assert cleaning.remove_outlier_rows(nan, ["x"]).where("row_id IN (5, 17)").count() == 2
    assert {r["column"]: r["null_count"] for r in profile.null_profile(nan).collect()} == {"x": 2, "z": 1, "k": 0}
