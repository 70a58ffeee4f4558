import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.functions import dates
from tabsense.operators import profile, quantiles, stats
from tabsense.plans.fixtures import fixture
from tabsense.sources.tables import read_table

from tests.paths import SF


def _pdf(df):
    return df.orderBy("row_id").toPandas()


def _pandas_runs(pdf, keys):
    """Consecutive equal rows (a null never continues a run)."""
    same = pd.Series(False, index=pdf.index)
    if len(pdf) > 1:
        eq = pd.Series(True, index=pdf.index[1:])
        for k in keys:
            cur, prev = pdf[k].iloc[1:].reset_index(drop=True), pdf[k].iloc[:-1].reset_index(drop=True)
            e = (cur == prev) & cur.notna() & prev.notna()
            eq &= e.values
        same.iloc[1:] = eq.values
    grp = (~same).cumsum()
    sizes = grp.map(grp.value_counts())
    return grp, sizes


def test_duplicates_against_pandas(spark):
    df = fixture(spark, SF, "fx_dups")
    pdf = _pdf(df)
    keys = ["a", "b", "c", "d"]
    dup_mask = pdf.duplicated(subset=keys, keep=False)
    got_rows = profile.duplicate_rows(df).count()
    assert got_rows == int(dup_mask.sum())
    grp, sizes = _pandas_runs(pdf, keys)
    runs = pdf[sizes > 1].groupby(grp[sizes > 1]).size()
    got_runs = profile.duplicate_runs(df, bucket_rows=97).toPandas()
    assert len(got_runs) == len(runs)
    assert sorted(got_runs["count_in_group"].tolist()) == sorted(runs.tolist())
    in_run = sizes > 1
    scattered = pdf[dup_mask & ~in_run].drop_duplicates(subset=keys)
    got_sc = profile.duplicate_scattered(df, bucket_rows=97).toPandas()
    assert sorted(got_sc["row_id"].tolist()) == sorted(scattered["row_id"].tolist())


def test_describe_and_moments_against_pandas(spark):
    li = read_table(spark, SF, "lineitem")
    pdf = li.toPandas()
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    d = stats.describe_numeric(li, cols).toPandas().set_index("column")
    want = pdf[cols].describe().T
    for c in cols:
        assert d.loc[c, "count"] == want.loc[c, "count"]
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert d.loc[c, ours] == pytest.approx(want.loc[c, theirs], rel=1e-9)
    a = stats.describe_advanced(li, cols).toPandas().set_index("column")
    for c in cols:
        assert a.loc[c, "skew"] == pytest.approx(pdf[c].skew(), rel=1e-7)
        assert a.loc[c, "kurtosis"] == pytest.approx(pdf[c].kurt(), rel=1e-7)
        assert a.loc[c, "variance"] == pytest.approx(pdf[c].var(), rel=1e-9)


def test_constant_column_is_safe(spark):
    df = fixture(spark, SF, "fx_constant")
    a = stats.describe_advanced(df, ["const", "zero", "empty_col", "v"]).toPandas().set_index("column")
    assert a.loc["const", "skew"] == 0.0 and a.loc["const", "kurtosis"] == 0.0
    assert pd.isna(a.loc["zero", "cv"])
    from tabsense.operators.plotdata import correlation_matrix
    cm = correlation_matrix(df, ["const", "v"]).toPandas()
    assert cm[(cm.column_a == "const") & (cm.column_b == "v")]["corr"].isna().all()


def test_pca_matches_numpy(spark):
    li = read_table(spark, SF, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = stats.pca_scaled(li, cols).toPandas()
    x = li.select(*cols).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    eig = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    np.testing.assert_allclose(got["eigenvalue"].to_numpy(), eig, rtol=1e-8)
    assert got["cumulative_pct"].iloc[-1] == pytest.approx(100.0)


def test_results_do_not_depend_on_partitioning(spark):
    df = fixture(spark, SF, "fx_dups")
    base = sorted(map(tuple, profile.duplicate_summary(df, bucket_rows=50).collect()))
    assert base == sorted(map(tuple, profile.duplicate_summary(df.repartition(3), bucket_rows=1 << 20).collect()))


def test_runs_follow_positions_across_gaps_and_buckets(spark):
    pdf = pd.DataFrame({"row_id": [0, 2, 5, 6, 9, 10, 11], "a": ["x", "y", "y", "z", "z", "z", None]})
    df = spark.createDataFrame(pdf)
    for b in (1, 2, 4, 1 << 20):
        runs = profile.duplicate_runs(df, bucket_rows=b).orderBy("row_id").toPandas()
        assert runs["row_id"].tolist() == [2, 6]
        assert runs["count_in_group"].tolist() == [2, 3]


def test_duplicate_summary_groups_no_runs(spark, monkeypatch):
    """F8: the neighbours of every row tell all numbers, so no task holds a group a run; also over bucket ends and nulls."""
    import random
    random.seed(3)
    values = [random.choice([(1, "x"), (1, "y"), (2, "x"), (None, "x")]) for _ in range(200)] + [(9, "z")]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "row_id long, a int, b string")
    monkeypatch.setattr(profile, "_runs", lambda *a: 1 / 0)
    runs = []
    for v in values:
        if runs and v == runs[-1][0] and v[0] is not None:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    total = {v: values.count(v) for v in set(values)}
    want = (sum(n > 1 for _, n in runs), sum(n for _, n in runs if n > 1),
            len({v for v, n in runs if n == 1 and total[v] > 1}), sum(n for n in total.values() if n > 1))
    for bucket in (1, 7, 1 << 20):
        assert tuple(profile.duplicate_summary(df, bucket).first()) == want


def test_profile_all_scans_once_for_what_tables_share(spark, monkeypatch):
    """Moments come from one scan for all tables that need them, text values from one count."""
    rows = [(i, None if i % 7 == 0 else float(i % 50), None if i % 5 == 0 else f"w{i % 3} {'x ' * (i % 4)}", None, "2020-01-0%d" % (1 + i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, t string, empty string, day string")
    want = {("describe", "a", "mean"): stats.describe_numeric(df).first()["mean"], ("advanced", "a", "skew"): stats.describe_advanced(df).first()["skew"]}
    for r in stats.text_describe(df, ["t", "empty"]).collect():
        want |= {("text_describe", r["column"], m): r[m] for m in ("count", "unique", "top", "freq")}
    want |= {("text_words", r["column"], "avg_words"): r["avg_words"] for r in stats.avg_word_count(df, ["t", "empty"]).collect()}
    want |= {("text_uniques", r["column"], "first_values"): r["first_values"] for r in stats.text_uniques(df, ["t", "empty"]).collect()}
    calls = []
    for name in ("column_ranges", "_stack_text"):
        monkeypatch.setattr(stats, name, lambda *a, _f=getattr(stats, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    monkeypatch.setattr(quantiles, "column_ranges", lambda *a, **k: pytest.fail("ranges are known"))
    got = {(r["section"], r["column"], r["metric"]): r["text"] if r["value"] is None else r["value"] for r in stats.profile_all(df).collect()}
    assert sorted(calls) == ["_stack_text", "column_ranges"]
    assert got["missing", "empty", "null_count"] == 400 and ("text_describe", "day", "count") not in got  # a date column
    for at, value in want.items():
        assert got[at] == (pytest.approx(value) if isinstance(value, float) else value)


def test_ranks_among_few_and_many_edges(spark, monkeypatch):
    values = [float("-inf"), -1.0, 0.0, 0.5, 1.0, 2.0, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    edges = [float("-inf"), 0.0, 0.0, 1.0, float("inf")]
    ask = lambda: [tuple(r) for r in df.select(quantiles._rank_in(edges, F.col("x"), False), quantiles._rank_in(edges, F.col("x"), True)).collect()][:-1]
    few = ask()
    assert few == [(sum(e <= v for e in edges), sum(e < v for e in edges)) for v in values[:-1]]
    monkeypatch.setattr(quantiles, "FEW_EDGES", 0)
    assert ask() == few


def test_texts_that_are_no_dates_meet_one_pattern(spark):
    texts = ["2020-1-1", "1/1/2020", "20200131", " 31.12.1999 ", "2020-01-02 03:04:05", "2020-01-02T3:4:5", "2020-13-45", "99999999", "1/1/20", "", "a", "2020-01-0x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    each = F.coalesce(*[dates.parse_with(F.trim("t"), f) for f in dates.SPARK_DATE_FORMATS + dates.SPARK_ISO_TIMES])
    rows = df.orderBy("i").select(dates.parse_any(F.col("t")).cast("string").alias("a"), each.cast("string").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and [r["a"] is not None for r in rows] == [True] * 6 + [False] * 7
