import numpy as np
import pandas as pd
import pytest

from tabsense.operators import cleaning
from tabsense.plans.fixtures import fixture

from tests.paths import SF


def _sorted(df):
    return df.orderBy("row_id").toPandas().reset_index(drop=True)


def test_interpolate_against_pandas(spark):
    vals = [None, None, 1.0, None, None, 4.0, None, 10.0, None, None]
    pdf = pd.DataFrame({"row_id": np.arange(len(vals), dtype="int64"), "v": pd.Series(vals, dtype="float64")})
    df = spark.createDataFrame(pdf)
    want = pdf["v"].interpolate(method="linear", limit_direction="forward")
    for b in (2, 3, 1 << 20):
        got = _sorted(cleaning.fill_interpolate(df, "v", bucket_rows=b))["v"]
        pd.testing.assert_series_equal(got, want, check_names=False)


def test_clean_missing_policy_against_pandas(spark):
    df = fixture(spark, SF, "fx_missing")
    pdf = _sorted(df)
    n = len(pdf)
    # the reference's policy, written out for this fixture
    exp = pdf.drop(columns=["d_drop_col"]).copy()
    exp["q_interp"] = exp["q_interp"].interpolate(method="linear", limit_direction="forward")
    exp["p_mean"] = exp["p_mean"].fillna(exp["p_mean"].mean())
    exp = exp.dropna(subset=["t_drop_rows"])
    vc = exp["f_mode"].value_counts()
    exp["f_mode"] = exp["f_mode"].fillna(sorted(vc[vc == vc.max()].index)[0])
    vc = exp["s_mode"].value_counts()
    exp["s_mode"] = exp["s_mode"].fillna(sorted(vc[vc == vc.max()].index)[0])
    got = _sorted(cleaning.clean_missing(df, bucket_rows=64))
    assert list(got.columns) == list(exp.columns)
    assert len(got) == len(exp) and len(exp) < n
    for c in exp.columns:
        if exp[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float), rtol=1e-12)
        else:
            assert got[c].astype(str).tolist() == exp[c].astype(str).tolist()


def test_dedup_properties(spark):
    df = fixture(spark, SF, "fx_dups")
    once = cleaning.drop_duplicates(df)
    twice = cleaning.drop_duplicates(once)
    assert once.count() == twice.count()
    assert once.count() + cleaning.deleted_duplicates(df).count() == df.count()


def test_outlier_branches(spark):
    few = fixture(spark, SF, "fx_outliers_few")
    out, method = cleaning.treat_outliers(few)
    assert method == "Suppression" and out.count() < few.count()
    many = fixture(spark, SF, "fx_outliers_many")
    out, method = cleaning.treat_outliers(many)
    assert method == "Winsorisation" and out.count() == many.count()
    pdf = many.toPandas()
    q1, q3 = pdf["x"].quantile(0.25), pdf["x"].quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    got = out.toPandas()["x"]
    assert got.min() >= lo - 1e-9 and got.max() <= hi + 1e-9
    want = pdf["x"].clip(lo, hi)
    np.testing.assert_allclose(np.sort(got.to_numpy()), np.sort(want.to_numpy()), rtol=1e-12)


def test_drop_columns_guard(spark):
    df = fixture(spark, SF, "fx_outliers_few")
    with pytest.raises(ValueError):
        cleaning.drop_columns(df, ["x", "y"])
    assert cleaning.drop_columns(df, ["x", "nope"]).columns == ["row_id", "y"]
