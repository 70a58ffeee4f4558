import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsense.operators.quantiles import column_modes, exact_quantiles


def _df(spark, cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30000)
    x[: 10000] = 3.25          # a third of the rows hold one value
    y = rng.exponential(size=30000) * 1e6
    df = _df(spark, {"x": x, "y": y})
    got = exact_quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.75, 1.0])
    for c, arr in (("x", x), ("y", y)):
        want = np.quantile(arr, [0.0, 0.25, 0.5, 0.75, 1.0])
        np.testing.assert_allclose(got[c], want, rtol=1e-12, atol=1e-12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": pd.Series(values, dtype="float64")}))
    got = exact_quantiles(df, ["v"], [0.1, 0.5, 0.9])["v"]
    clean = [v for v in values if v is not None]
    if not clean:
        assert got == [None, None, None]
    else:
        np.testing.assert_allclose(got, np.quantile(clean, [0.1, 0.5, 0.9]), rtol=1e-9, atol=1e-9)


def test_modes_smallest_on_ties(spark):
    df = _df(spark, {"a": ["b", "a", "b", "a", None, "c"], "n": [3.0, 1.0, 1.0, 3.0, 2.0, None]})
    m = column_modes(df, ["a", "n"])
    assert m["a"] == "a"
    assert m["n"] == 1.0


def test_brackets_match_numpy(spark, monkeypatch):
    """Rough sketches, many ranks, hot values: still exact."""
    from tabsense.operators import quantiles
    monkeypatch.setattr(quantiles, "EXACT_LIMIT", 16)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.lognormal(size=5000), np.full(2500, 7.5)])
    df = _df(spark, {"x": x, "y": np.round(x), "z": -x}).repartition(4)
    probs = [0.0, 0.01, 0.25, 0.26, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["x", "y", "z"], probs)
    for c, v in (("x", x), ("y", np.round(x)), ("z", -x)):
        np.testing.assert_allclose(got[c], np.quantile(v, probs), rtol=1e-12)


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    from tabsense.operators import quantiles
    monkeypatch.setattr(quantiles, "EXACT_LIMIT", 16)
    real, calls = quantiles._brackets, []

    def wrong(df, wanted, ranges, widen):
        calls.append(widen)
        return real(df, wanted, ranges, widen) if widen > 1 else {c: [(-5.0, -4.9)] for c in wanted}
    monkeypatch.setattr(quantiles, "_brackets", wrong)
    x = np.random.default_rng(3).normal(size=3000)
    np.testing.assert_allclose(exact_quantiles(_df(spark, {"x": x}), ["x"], [0.25, 0.5])["x"], np.quantile(x, [0.25, 0.5]), rtol=1e-12)
    assert calls == [1, 10]


def test_infinities_are_values_inside_brackets(spark):
    """A million rows with infinities: the exact scan keeps few values, not all."""
    from pyspark.sql import functions as F
    from tabsense.operators import quantiles
    n = 1_000_000
    v = F.when(F.col("id") % 10 == 0, F.lit(float("inf"))).when(F.col("id") % 10 == 1, F.lit(float("-inf"))).otherwise((F.col("id") * 7919 % n).cast("double"))
    df = spark.range(n).select(v.alias("x"))
    ids = np.arange(n)
    x = np.where(ids % 10 == 0, np.inf, np.where(ids % 10 == 1, -np.inf, (ids * 7919 % n).astype(float)))
    order = np.sort(x)
    got = exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    want = [order[0], *[order[int(np.floor((n - 1) * p))] + (order[int(np.ceil((n - 1) * p))] - order[int(np.floor((n - 1) * p))]) * ((n - 1) * p % 1) for p in (0.25, 0.5, 0.75)], order[-1]]
    np.testing.assert_allclose(got, want)
    ranges = quantiles.column_ranges(df, ["x"])
    (lo, hi), *_ = quantiles._brackets(df, {"x": [n // 2]}, ranges, 1)["x"]
    assert ((x >= lo) & (x <= hi)).sum() < 2000 and np.isinf(ranges["x"][1]) and np.isinf(ranges["x"][2])
