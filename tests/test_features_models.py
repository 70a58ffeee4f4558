import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import clusters, features, models
from tabsense.plans.fixtures import fixture
from tabsense.sources.tables import read_table

from tests.paths import SF, SF01


def test_label_codes_are_a_bijection(spark):
    df = fixture(spark, SF, "fx_ml")
    enc, mapping = features.label_encode(df, ["segment", "priority"])
    m = mapping.toPandas()
    for c in ("segment", "priority"):
        part = m[m.column == c].sort_values("class")
        assert part["idx"].tolist() == list(range(len(part)))
        assert sorted(df.select(c).distinct().toPandas()[c]) == part["class"].tolist()
    assert enc.where(F.col("segment").isNull()).count() == 0


def test_standardize_mean_zero_std_one(spark):
    df = fixture(spark, SF, "fx_ml")
    out, _ = features.standardize(df, ["price", "bal"])
    p = out.toPandas()
    for c in ("price", "bal"):
        assert p[c].mean() == pytest.approx(0.0, abs=1e-9)
        assert p[c].std(ddof=0) == pytest.approx(1.0, rel=1e-9)


def test_detect_ml_type(spark):
    df = fixture(spark, SF, "fx_ml")
    assert features.detect_ml_type(df, None) == "clustering"
    assert features.detect_ml_type(df, "nope") == "clustering"
    assert features.detect_ml_type(df, "y_class") == "classification"
    assert features.detect_ml_type(df, "y_reg") == "regression"
    two = df.withColumn("t", (F.col("row_id") % 2).cast("double"))
    assert features.detect_ml_type(two, "t") == "classification"


def test_split_is_deterministic_and_sized(spark):
    df = fixture(spark, SF01, "fx_ml")
    a = models.train_test_split(df).where("split = 'test'").select("row_id")
    b = models.train_test_split(df.repartition(7)).where("split = 'test'").select("row_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() / df.count() == pytest.approx(0.2, abs=0.02)


def test_linear_regression_recovers_exact_relation(spark):
    df = fixture(spark, SF01, "fx_ml")
    board = models.model_leaderboard(df, "y_reg", ["price", "bal"], "regression", ["LinearRegression"]).toPandas()
    r2 = board[board.metric == "r2"]["value"].iloc[0]
    assert r2 == pytest.approx(1.0, abs=1e-6)


def test_classifier_beats_majority_on_embeddings(spark):
    emb = read_table(spark, SF01, "embeddings")
    df = emb.select(F.col("vec_id").alias("row_id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
                    F.col("label"))
    feats = [f"e{i}" for i in range(64)]
    board = models.model_leaderboard(df, "label", feats, "classification", ["LogisticRegression"]).toPandas()
    acc = board[board.metric == "accuracy"]["value"].iloc[0]
    majority = df.groupBy("label").count().agg(F.max("count")).first()[0] / df.count()
    assert acc > majority


def test_metrics_against_manual(spark):
    pdf = pd.DataFrame({"y": [0, 0, 1, 1, 2, 2, 2], "p": [0, 1, 1, 1, 2, 0, 0]})
    m = models.classification_metrics(spark.createDataFrame(pdf), "y", "p").first()
    acc = (pdf.y == pdf.p).mean()
    prec, rec, f1, w = [], [], [], []
    for k in sorted(pdf.y.unique()):
        tp = ((pdf.y == k) & (pdf.p == k)).sum()
        pp = (pdf.p == k).sum()
        sup = (pdf.y == k).sum()
        pr = tp / pp if pp else 0.0
        rc = tp / sup if sup else 0.0
        prec.append(pr), rec.append(rc), f1.append(2 * pr * rc / (pr + rc) if pr + rc else 0.0), w.append(sup)
    w = np.array(w) / len(pdf)
    assert m["accuracy"] == pytest.approx(acc)
    assert m["precision"] == pytest.approx(float(np.dot(w, prec)))
    assert m["recall"] == pytest.approx(float(np.dot(w, rec)))
    assert m["f1"] == pytest.approx(float(np.dot(w, f1)))


def _brute_dbscan(x, eps, min_samples):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    lab = -np.ones(n, dtype=int)
    comp = {}
    for i in range(n):               # components of core points (smallest index as id)
        if core[i] and i not in comp:
            stack, comp[i] = [i], i
            while stack:
                j = stack.pop()
                for k in np.where(nb[j] & core)[0]:
                    if k not in comp:
                        comp[k] = i
                        stack.append(k)
    for i in range(n):
        if core[i]:
            lab[i] = comp[i]
        else:
            cs = [comp[k] for k in np.where(nb[i] & core)[0]]
            if cs:
                lab[i] = min(cs)
    ids = sorted({l for l in lab if l >= 0})
    return np.array([ids.index(l) if l >= 0 else -1 for l in lab])


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 0.2, (60, 2)), rng.uniform(-2, 5, (30, 2)),
                     np.repeat([[1.5, 1.5]], 20, axis=0)])
    pdf = pd.DataFrame({"row_id": np.arange(len(pts), dtype="int64"), "x": pts[:, 0], "y": pts[:, 1]})
    got = clusters.cluster_dbscan(spark.createDataFrame(pdf), ["x", "y"]).orderBy("row_id").toPandas()["cluster"]
    want = _brute_dbscan(pts, 0.5, 5)
    assert got.tolist() == want.tolist()


def _brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a, b in itertools.combinations(range(len(groups)), 2):
            ga, gb = x[groups[a]], x[groups[b]]
            d = len(ga) * len(gb) / (len(ga) + len(gb)) * ((ga.mean(0) - gb.mean(0)) ** 2).sum()
            if best is None or d < best[0]:
                best = (d, a, b)
        _, a, b = best
        groups[a] = groups[a] + groups[b]
        del groups[b]
    lab = np.empty(len(x), dtype=int)
    for i, g in enumerate(sorted(groups, key=min)):
        lab[g] = i
    return lab


def test_ward_exact_on_small_input(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 1, (15, 2)), rng.normal(6, 1, (15, 2)), rng.normal((0, 8), 1, (10, 2))])
    pdf = pd.DataFrame({"row_id": np.arange(len(pts), dtype="int64"), "x": pts[:, 0], "y": pts[:, 1]})
    got = clusters.ward_exact(spark.createDataFrame(pdf), ["x", "y"]).orderBy("row_id").toPandas()["cluster"]
    assert got.tolist() == _brute_ward(pts, 3).tolist()


def test_cluster_indices_against_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(5, 1, (40, 2))])
    lab = np.array([0] * 40 + [1] * 40)
    pdf = pd.DataFrame({"row_id": np.arange(80, dtype="int64"), "x": pts[:, 0], "y": pts[:, 1], "cluster": lab})
    df = spark.createDataFrame(pdf)
    cents = np.array([pts[lab == k].mean(0) for k in (0, 1)])
    s = [np.sqrt(((pts[lab == k] - cents[k]) ** 2).sum(1)).mean() for k in (0, 1)]
    dbi = (s[0] + s[1]) / np.sqrt(((cents[0] - cents[1]) ** 2).sum())
    assert clusters.davies_bouldin(df, ["x", "y"]) == pytest.approx(dbi)
    g = pts.mean(0)
    b = sum((lab == k).sum() * ((cents[k] - g) ** 2).sum() for k in (0, 1))
    w = sum(((pts[lab == k] - cents[k]) ** 2).sum() for k in (0, 1))
    assert clusters.calinski_harabasz(df, ["x", "y"]) == pytest.approx((b / 1) / (w / 78))
    # squared-Euclidean silhouette by brute force
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    sil = []
    for i in range(80):
        same = lab == lab[i]
        a = d2[i, same].sum() / (same.sum() - 1)
        bb = d2[i, ~same].mean()
        sil.append((bb - a) / max(a, bb))
    assert clusters.silhouette_squared(df, ["x", "y"]) == pytest.approx(np.mean(sil), rel=1e-6)


def test_encode_new_rows_errors(spark):
    df = fixture(spark, SF, "fx_ml")
    _, mapping = features.label_encode(df, ["segment"])
    _, sc = features.standardize(df, ["price"])
    raw = spark.createDataFrame([(1, "12,5", "BUILDING"), (2, "", "BUILDING"), (3, "7", "nope"), (4, "x", "BUILDING")],
                                "row_id long, price string, segment string")
    out = {r["row_id"]: r for r in models.encode_new_rows(raw, ["price", "segment"], mapping, sc).collect()}
    m, s = sc.first()["mean"], sc.first()["scale"]
    assert out[1]["error"] is None and out[1]["price"] == pytest.approx((12.5 - m) / s)
    assert "missing" in out[2]["error"]
    assert "unknown" in out[3]["error"]
    assert "number" in out[4]["error"]


@pytest.mark.parametrize("ml_type,target,floor", [("classification", "y", 0.85), ("regression", "t", 0.8)])
def test_every_model_learns(spark, ml_type, target, floor):
    from tabsense.operators.models import model_leaderboard
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    t = 3 * x[:, 0] - 2 * x[:, 1]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(row_id=range(600), t=t, y=np.where(t > 1, "high", np.where(t < -1, "low", "mid")))
    got = model_leaderboard(spark.createDataFrame(pdf), target, ["a", "b", "c"], ml_type).toPandas()
    assert got["model"].nunique() == 5 and not (got["metric"] == "error").any()
    score = got[got["metric"] == ("accuracy" if ml_type == "classification" else "r2")].set_index("model")["value"]
    assert (score > floor).all(), score
    assert set(got.loc[got["model"].isin(["SVC", "SVR"]), "trained_as"].str.contains("Nystroem")) == {True}


def test_three_class_probabilities_of_every_model_that_has_them(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    pdf = pd.DataFrame(x, columns=["x", "b"]).assign(row_id=range(300), y=np.where(x[:, 0] > 0.5, "p", np.where(x[:, 0] < -0.5, "q", "r")))
    train = spark.createDataFrame(pdf)
    for name in ("DecisionTreeClassifier", "RandomForestClassifier", "LGBMClassifier", "LogisticRegression"):
        got = models.predict(train, train, ["x", "b"], "y", "classification", name).toPandas()
        p = np.array(got["probability"].tolist())
        assert p.shape == (300, 3) and np.allclose(p.sum(axis=1), 1) and (got["predicted_class"] == got["y"]).mean() > 0.9
        assert got["x"].tolist() and set(got.columns) >= {"x", "b", "prediction"}
    svc = models.predict(train, train, ["x", "b"], "y", "classification", "SVC")
    assert "probability" not in svc.columns and svc.where("predicted_class = y").count() > 270


def test_leaderboard_reports_fit_errors_only(spark, monkeypatch):
    holes = spark.createDataFrame([(i, float(i) if i % 5 else float("nan"), float(i)) for i in range(200)], "row_id long, x double, t double")
    board = models.model_leaderboard(holes, "t", ["x"], "regression", ["SVR", "LGBMRegressor"]).toPandas().set_index("model")
    assert "missing values" in board.loc["SVR", "error"] and board.loc["LGBMRegressor", "error"].isna().all()

    def lost(*_):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(models, "fit", lost)
    with pytest.raises(RuntimeError):
        models.model_leaderboard(holes, "t", ["x"], "regression", ["SVR"])


def test_predict_passes_incomplete_rows_through(spark):
    from tabsense.operators.models import predict
    train = spark.createDataFrame([(i, float(i), "lo" if i < 20 else "hi") for i in range(40)], "row_id long, x double, y string")
    new = spark.createDataFrame([(1, 3.0), (2, None), (3, 35.0)], "row_id long, x double")
    for model in ("DecisionTreeClassifier", "LogisticRegression"):
        got = {r["row_id"]: r for r in predict(train, new, ["x"], "y", "classification", model).collect()}
        assert [got[i]["predicted_class"] for i in (1, 2, 3)] == ["lo", None, "hi"]
        assert got[2]["probability"] is None and abs(sum(got[1]["probability"]) - 1) < 1e-9


def test_davies_bouldin_with_equal_centroids(spark):
    pdf = pd.DataFrame({"x": [0.0, 2.0, 1.0, 1.0, 9.0, 11.0], "cluster": [0, 0, 1, 1, 2, 2]})
    got = clusters.davies_bouldin(spark.createDataFrame(pdf), ["x"])
    assert np.isfinite(got) and got == pytest.approx((2 / 9 + 1 / 9 + 2 / 9) / 3)


def test_dbscan_numbers_by_first_core_row(spark):
    # row 0 is a border point of the cluster whose core rows come later
    xs = [5.525] + [0.0, 0.01, 0.02, 0.03, 0.04] + [5.0, 5.01, 5.02, 5.03, 5.04]
    pdf = pd.DataFrame({"row_id": range(len(xs)), "x": xs})
    got = clusters.cluster_dbscan(spark.createDataFrame(pdf), ["x"]).orderBy("row_id").toPandas()["cluster"].tolist()
    assert got == [1] + [0] * 5 + [1] * 5


def test_gram_matrices_equal_numpy(spark):
    from tabsense.operators.decomposition import correlations, pca_table
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 1e4
    kept = x.copy()
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(40)])
    pdf["flat"] = 1e6
    df = spark.createDataFrame(pdf)
    got = correlations(df, list(pdf.columns))
    assert np.allclose(got[:40, :40], np.corrcoef(x.T), atol=1e-9) and np.isnan(got[40]).all()
    pdf.loc[::7, "c1"] = np.nan
    holes = correlations(spark.createDataFrame(pdf), ["c0", "c1"])
    assert holes[0, 1] == pytest.approx(pdf["c0"].corr(pdf["c1"]))
    z = (kept - kept.mean(0)) / kept.std(0)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    eig = pca_table(df, [f"c{i}" for i in range(40)], standardize=True).toPandas()["eigenvalue"]
    assert np.allclose(eig, want, atol=1e-8)


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_silhouette_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 7))
    k = np.append(rng.integers(0, 3, 149), 9)  # the last one alone in its cluster
    x[10:30] = x[10]
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(7)]).assign(row_id=range(150), cluster=k)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(150):
        own = (k == k[i]) & (np.arange(150) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, k == c].mean() for c in set(k) - {k[i]})
        want.append((b - a) / max(a, b))
    got = clusters.silhouette(spark.createDataFrame(pdf), [f"c{i}" for i in range(7)])
    assert got == pytest.approx(np.mean(want), rel=1e-6)
    assert clusters.silhouette(spark.createDataFrame(pdf).withColumn("cluster", F.lit(1)), ["c0"]) is None


@pytest.mark.parametrize("dims,block_rows", [(2, 4096), (5, 30)])
def test_dbscan_of_blobs_chains_and_copies(spark, monkeypatch, dims, block_rows):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(dims)
    chain = np.zeros((40, dims))
    chain[:, 0] = np.arange(40) * 0.2 + 5
    pts = np.vstack([rng.normal(0, 0.08, (150, dims)), rng.normal(0, 0.4, (120, dims)), chain, rng.uniform(-3, 3, (60, dims)), np.repeat([[2.5] * dims], 30, axis=0)])
    pdf = pd.DataFrame(pts, columns=[f"c{i}" for i in range(dims)]).assign(row_id=np.arange(len(pts)))
    got = clusters.cluster_dbscan(spark.createDataFrame(pdf).repartition(3), [f"c{i}" for i in range(dims)]).orderBy("row_id").toPandas()["cluster"]
    assert got.tolist() == _brute_dbscan(pts, 0.5, 5).tolist()


def test_dbscan_of_a_dense_blob(spark):
    """10,000 distinct points within eps of each other, and a second such blob that touches it: no row a pair."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(0, 0.3, 10_000), rng.uniform(0.79, 1.0, 2_000), rng.uniform(9, 9.2, 500)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, x double")
    got = clusters.cluster_dbscan(df, ["x"]).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 12_000, 1: 500}


def _ward_cost(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels))


def test_ward_over_features_is_exact_with_radius_0(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.7, (60, 3)) for c in (0, 2, 5)] + [np.repeat([[1.0, 1.0, 1.0]], 40, axis=0)])
    rng.shuffle(x)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(row_id=range(len(x)))
    for k in (2, 3, 7):
        got = clusters.cluster_agglomerative(spark.createDataFrame(pdf).repartition(5), list("abc"), k).orderBy("row_id").toPandas()["cluster"].to_numpy()
        want = clusters._ward(x, np.ones(len(x)), k)
        firsts = [int(np.flatnonzero(want == c)[0]) for c in sorted(set(want), key=lambda c: np.flatnonzero(want == c)[0])]
        assert got.tolist() == [firsts.index(int(np.flatnonzero(want == c)[0])) for c in want]


def test_ward_over_few_features_is_near_exact(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 1.0, (300, 4)) for c in (0, 4, 9)])
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(row_id=range(len(x)))
    got = clusters.cluster_agglomerative(spark.createDataFrame(pdf).repartition(4), list("abcd"), 3, cells=60).orderBy("row_id").toPandas()["cluster"].to_numpy()
    exact = clusters.ward_chain(x, np.ones(len(x)), 3)
    assert _ward_cost(x, got) <= 1.1 * _ward_cost(x, exact)
    held = clusters.Features(4, 0.0, 60)
    held.add(np.ones(900), x, np.zeros(900), np.arange(900))
    n, mean, square, first = held.rows()
    assert n.sum() == 900 and len(n) <= 60 and np.allclose((n[:, None] * mean).sum(0), x.sum(0)) and held.radius > 0
    assert np.allclose(square.sum() + (n[:, None] * mean ** 2).sum(), (x ** 2).sum())
