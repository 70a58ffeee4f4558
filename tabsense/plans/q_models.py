"""Registered queries: split, models, metrics, clustering, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import clusters, features, models
from tabsense.plans.fixtures import duck_fixture, fixture
from tabsense.plans.registry import query
from tabsense.sources.tables import read_table

_ML = duck_fixture("fx_ml")
_FEATS = ["price", "cust_mod", "bal"]
_E3 = ["e0", "e1", "e2"]
_E64 = [f"e{i}" for i in range(64)]
_H = "((row_id % 2147483648) * 2654435761 + 42) % 4294967296"
_EMB_Z = """(SELECT vec_id AS row_id, label,
  (e0 - avg(e0) OVER ()) / stddev_pop(e0) OVER () AS e0, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS e1,
  (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS e2
  FROM (SELECT vec_id, label, list_sum(CAST(embedding[1:21] AS DOUBLE[])) AS e0,
        list_sum(CAST(embedding[22:42] AS DOUBLE[])) AS e1,
        list_sum(CAST(embedding[43:64] AS DOUBLE[])) AS e2 FROM embeddings))"""
_Z64 = """(WITH u AS (SELECT vec_id AS row_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i)),
st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM u GROUP BY i)
SELECT row_id, any_value(label) AS label, list((x - m) / s ORDER BY u.i) AS z FROM u JOIN st ON st.i = u.i GROUP BY row_id)"""
_CENT64 = f"""(SELECT k, any_value(n) AS n, list(c ORDER BY i) AS c FROM (SELECT label AS k, i, count(*) AS n, avg(z[i]) AS c
  FROM {_Z64} AS zz, range(1, 65) AS t(i) GROUP BY label, i) GROUP BY k)"""
_CENT = f"(SELECT label AS k, count(*) AS n, avg(e0) AS c0, avg(e1) AS c1, avg(e2) AS c2 FROM {_EMB_Z} GROUP BY label)"


@query("train_test_split", oracle=f"SELECT *, CASE WHEN {_H} < {int(0.2 * 2**32)} THEN 'test' ELSE 'train' END AS split FROM {_ML}",
       floats=("price", "cust_mod", "bal", "y_reg"))
def q_train_test_split(spark, d):
    return models.train_test_split(fixture(spark, d, "fx_ml"))


@query("train_test_split_exact", oracle=f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {_H}, row_id) <=
  (SELECT ceil(0.2 * count(*)) FROM {_ML}) THEN 'test' ELSE 'train' END AS split FROM {_ML}""", floats=("price", "cust_mod", "bal", "y_reg"))
def q_train_test_split_exact(spark, d):
    return models.train_test_split_exact(fixture(spark, d, "fx_ml"))


@query("standardize_target", oracle=f"""SELECT * REPLACE ((y_reg - (SELECT avg(y_reg) FROM {_ML})) /
  (SELECT stddev_pop(y_reg) FROM {_ML}) AS y_reg) FROM {_ML}""", floats=("price", "cust_mod", "bal", "y_reg"))
def q_standardize_target(spark, d):
    return models.standardize_target(fixture(spark, d, "fx_ml"), "y_reg")


# metrics over (label, prediction) pairs taken from the labels table:
# label = quality, prediction = toxic
@query("classification_metrics", oracle="""
WITH conf AS (SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY ALL),
ys AS (SELECT y, sum(n) AS support FROM conf GROUP BY y),
ps AS (SELECT p AS y, sum(n) AS predicted FROM conf GROUP BY p),
tp AS (SELECT y, n AS tp FROM conf WHERE y = p),
per AS (SELECT coalesce(ys.support, 0) AS support, coalesce(tp.tp, 0) AS tp,
  CASE WHEN coalesce(ps.predicted, 0) > 0 THEN coalesce(tp.tp, 0) / ps.predicted ELSE 0 END AS prec,
  CASE WHEN coalesce(ys.support, 0) > 0 THEN coalesce(tp.tp, 0) / ys.support ELSE 0 END AS rec
  FROM ys FULL JOIN ps ON ys.y = ps.y LEFT JOIN tp ON tp.y = coalesce(ys.y, ps.y))
SELECT sum(tp) / sum(support) AS accuracy, sum(support * prec) / sum(support) AS precision,
  sum(support * rec) / sum(support) AS recall,
  sum(support * CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END) / sum(support) AS f1 FROM per""",
       floats=("accuracy", "precision", "recall", "f1"))
def q_classification_metrics(spark, d):
    return models.classification_metrics(read_table(spark, d, "labels"), "quality", "toxic")


# regression metrics of a fixed linear predictor of y_reg
@query("regression_metrics", oracle=f"""
SELECT avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (count(y) * var_pop(y)) AS r2
FROM (SELECT y_reg AS y, (price * 0.5 + cust_mod) - y_reg AS e FROM {_ML})""", floats=("mae", "mse", "rmse", "r2"))
def q_regression_metrics(spark, d):
    df = fixture(spark, d, "fx_ml").withColumn("p", F.col("price") * 0.5 + F.col("cust_mod"))
    return models.regression_metrics(df, "y_reg", "p")


@query("train_linear", oracle=f"""
SELECT 'price' AS term, regr_slope(y_reg, price) AS value FROM {_ML}
UNION ALL SELECT 'intercept', regr_intercept(y_reg, price) FROM {_ML}""", floats=("value",))
def q_train_linear(spark, d):
    return models.linear_coefficients(fixture(spark, d, "fx_ml"), ["price"], "y_reg")


def _leader(spark, d, target, ml_type, names):
    df = fixture(spark, d, "fx_ml")
    return models.model_leaderboard(df, target, _FEATS, ml_type, names)


_LIN = f"""WITH z AS (SELECT *, (y_reg - (SELECT avg(y_reg) FROM {_ML})) / (SELECT stddev_pop(y_reg) FROM {_ML}) AS y,
  CASE WHEN {_H} < {int(0.2 * 2**32)} THEN 'test' ELSE 'train' END AS split FROM {_ML}),
fit AS (SELECT regr_slope(y, price) AS b, regr_intercept(y, price) AS a FROM z WHERE split = 'train'),
e AS (SELECT y, (fit.a + fit.b * price) - y AS err FROM z, fit WHERE split = 'test')"""


@query("linear_leaderboard_1d", oracle=_LIN + """
SELECT 'LinearRegression' AS model, 'LinearRegression' AS trained_as, 'mae' AS metric, avg(abs(err)) AS value, CAST(NULL AS VARCHAR) AS error FROM e
UNION ALL SELECT 'LinearRegression', 'LinearRegression', 'mse', avg(err * err), NULL FROM e
UNION ALL SELECT 'LinearRegression', 'LinearRegression', 'rmse', sqrt(avg(err * err)), NULL FROM e
UNION ALL SELECT 'LinearRegression', 'LinearRegression', 'r2', 1 - sum(err * err) / (count(y) * var_pop(y)), NULL FROM e""", floats=("value",))
def q_linear_leaderboard_1d(spark, d):
    """The regression leaderboard path (scaled target, hash split, fit on
    train, metrics on test) with one feature, where OLS has a SQL form."""
    return models.model_leaderboard(fixture(spark, d, "fx_ml"), "y_reg", ["price"], "regression", ["LinearRegression"])


@query("train_logistic")
def q_train_logistic(spark, d):
    return _leader(spark, d, "y_class", "classification", ["LogisticRegression"])


@query("train_rf_classifier")
def q_train_rf_classifier(spark, d):
    return _leader(spark, d, "y_class", "classification", ["RandomForestClassifier"])


@query("train_dt_classifier")
def q_train_dt_classifier(spark, d):
    return _leader(spark, d, "y_class", "classification", ["DecisionTreeClassifier"])


@query("train_svc")
def q_train_svc(spark, d):
    return _leader(spark, d, "y_class", "classification", ["SVC"])


@query("train_gbt_classifier")
def q_train_gbt_classifier(spark, d):
    return _leader(spark, d, "y_class", "classification", ["LGBMClassifier"])


@query("train_rf_regressor")
def q_train_rf_regressor(spark, d):
    return _leader(spark, d, "y_reg", "regression", ["RandomForestRegressor"])


@query("train_dt_regressor")
def q_train_dt_regressor(spark, d):
    return _leader(spark, d, "y_reg", "regression", ["DecisionTreeRegressor"])


@query("train_svr")
def q_train_svr(spark, d):
    return _leader(spark, d, "y_reg", "regression", ["SVR"])


@query("train_gbt_regressor")
def q_train_gbt_regressor(spark, d):
    return _leader(spark, d, "y_reg", "regression", ["LGBMRegressor"])


@query("model_leaderboard")
def q_model_leaderboard(spark, d):
    """All models of both types: the number y_reg and the class y_class."""
    return _leader(spark, d, "y_reg", "regression", None).unionByName(_leader(spark, d, "y_class", "classification", None))


def _embedded(spark, d):
    """embeddings as three standardised features: sums over the dimensions 1-21, 22-42 and 43-64."""
    emb = read_table(spark, d, "embeddings")
    total = lambda first, n: F.aggregate(F.slice("embedding", first, n), F.lit(0.0), lambda s, x: s + x.cast("double"))
    df = emb.select(F.col("vec_id").alias("row_id"), total(1, 21).alias("e0"), total(22, 21).alias("e1"), total(43, 22).alias("e2"),
                    F.col("label"))
    return features.standardize(df, _E3)[0]


def _dimensions(spark, d):
    """embeddings with all 64 dimensions as standardised features."""
    emb = read_table(spark, d, "embeddings")
    df = emb.select(F.col("vec_id").alias("row_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_E64)], "label")
    return features.standardize(df, _E64)[0]


@query("cluster_kmeans")
def q_cluster_kmeans(spark, d):
    return clusters.cluster_kmeans(_dimensions(spark, d), _E64)


@query("cluster_agglomerative")
def q_cluster_agglomerative(spark, d):
    return clusters.cluster_agglomerative(_dimensions(spark, d), _E64)


_NEAR3 = "power(a.e0 - b.e0, 2) + power(a.e1 - b.e1, 2) + power(a.e2 - b.e2, 2) <= 0.25"
_NEAR64 = "list_distance(a.z, b.z) <= 0.5"


def _db_labels(points: str, near: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT * FROM {points}),
nb AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON {near}),
core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.a JOIN core c2 ON nb.b = c2.a),
reach(id, root) AS (SELECT a, a FROM core UNION SELECT ce.b, r.root FROM reach r JOIN ce ON ce.a = r.id),
comp AS (SELECT id, min(root) AS lab FROM reach GROUP BY id),
border AS (SELECT nb.a AS id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.id
           WHERE nb.a NOT IN (SELECT a FROM core) GROUP BY nb.a),
labels AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
ord AS (SELECT lab, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS INTEGER) AS cluster FROM labels GROUP BY lab)"""


@query("cluster_dbscan", oracle=_db_labels(_Z64, _NEAR64) + f"""
SELECT p.row_id, {", ".join(f"p.z[{i + 1}] AS {c}" for i, c in enumerate(_E64))}, coalesce(ord.cluster, -1) AS cluster
FROM p LEFT JOIN labels ON labels.id = p.row_id LEFT JOIN ord ON ord.lab = labels.lab""", floats=tuple(_E64))
def q_cluster_dbscan(spark, d):
    """DBSCAN (eps 0.5, 5 samples) on all 64 standardised dimensions."""
    return clusters.cluster_dbscan(_dimensions(spark, d), _E64)


@query("cluster_dbscan_3d", oracle=_db_labels(_EMB_Z, _NEAR3) + """
SELECT p.row_id, p.e0, p.e1, p.e2, coalesce(ord.cluster, -1) AS cluster
FROM p LEFT JOIN labels ON labels.id = p.row_id LEFT JOIN ord ON ord.lab = labels.lab""", floats=("e0", "e1", "e2"))
def q_cluster_dbscan_3d(spark, d):
    """DBSCAN on three sums of the dimensions, where points are close enough to make clusters."""
    return clusters.cluster_dbscan(_embedded(spark, d), _E3)


def _metric_row(spark, name, value):
    return spark.createDataFrame([(name, value)], "metric string, value double")




@query("davies_bouldin", oracle=f"""
WITH c AS (SELECT * FROM {_CENT64}), s AS (SELECT c.k, avg(list_distance(p.z, c.c)) AS s FROM {_Z64} p JOIN c ON p.label = c.k GROUP BY c.k),
r AS (SELECT a.k, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r
      FROM c a JOIN c b ON a.k <> b.k JOIN s sa ON sa.k = a.k JOIN s sb ON sb.k = b.k GROUP BY a.k)
SELECT 'davies_bouldin' AS metric, avg(r) AS value FROM r""", floats=("value",))
def q_davies_bouldin(spark, d):
    return _metric_row(spark, "davies_bouldin", clusters.davies_bouldin(_dimensions(spark, d), _E64, "label"))


@query("calinski_harabasz", oracle=f"""
WITH c AS (SELECT * FROM {_CENT64}), g AS (SELECT sum(n) AS n, count(*) AS k FROM c),
o AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(z[i]) AS m FROM {_Z64} AS zz, range(1, 65) AS t(i) GROUP BY i)),
b AS (SELECT sum(c.n * power(list_distance(c.c, o.m), 2)) AS b FROM c, o),
w AS (SELECT sum(power(list_distance(p.z, c.c), 2)) AS w FROM {_Z64} p JOIN c ON p.label = c.k)
SELECT 'calinski_harabasz' AS metric, (b.b / (g.k - 1)) / (w.w / (g.n - g.k)) AS value FROM b, w, g""", floats=("value",))
def q_calinski_harabasz(spark, d):
    return _metric_row(spark, "calinski_harabasz", clusters.calinski_harabasz(_dimensions(spark, d), _E64, "label"))


@query("dbscan_noise", oracle=f"""
WITH p AS (SELECT * FROM {_Z64}),
nb AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON {_NEAR64}),
core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 5),
reach AS (SELECT DISTINCT nb.a FROM nb JOIN core ON nb.b = core.a)
SELECT CAST(count(*) FILTER (WHERE reach.a IS NULL) AS BIGINT) AS noise_points,
       CAST(count(*) FILTER (WHERE reach.a IS NOT NULL) AS BIGINT) AS clustered_points
FROM p LEFT JOIN reach ON reach.a = p.row_id""")
def q_dbscan_noise(spark, d):
    """Noise / clustered point counts of DBSCAN (eps 0.5, 5 samples)."""
    lab = clusters.cluster_dbscan(_dimensions(spark, d), _E64)
    return lab.agg(F.count_if(F.col("cluster") == -1).alias("noise_points"),
                   F.count_if(F.col("cluster") != -1).alias("clustered_points"))


def _silhouette_sql(name: str, points: str, distance: str) -> str:
    return f"""
WITH p AS (SELECT * FROM {points}),
s AS (SELECT a.row_id AS i, a.label AS li, b.label AS lj, sum({distance}) AS d, count(*) AS n FROM p a JOIN p b ON true GROUP BY ALL),
ab AS (SELECT i, max(CASE WHEN li = lj AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN d / n END) AS b FROM s GROUP BY i)
SELECT '{name}' AS metric, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS value FROM ab"""


@query("silhouette", oracle=_silhouette_sql("silhouette", _Z64, "list_distance(a.z, b.z)"), floats=("value",))
def q_silhouette(spark, d):
    """The exact Euclidean silhouette on all 64 dimensions."""
    return _metric_row(spark, "silhouette", clusters.silhouette(_dimensions(spark, d), _E64, "label"))


@query("silhouette_squared", oracle=_silhouette_sql("silhouette_sq_euclidean", _EMB_Z,
       "power(a.e0 - b.e0, 2) + power(a.e1 - b.e1, 2) + power(a.e2 - b.e2, 2)"), floats=("value",))
def q_silhouette_squared(spark, d):
    """The linear form with squared distances, on three sums of the dimensions."""
    return _metric_row(spark, "silhouette_sq_euclidean", clusters.silhouette_squared(_embedded(spark, d), _E3, "label"))


@query("cluster_projection")
def q_cluster_projection(spark, d):
    return clusters.cluster_projection(_dimensions(spark, d), _E64, "label")


@query("cluster_report")
def q_cluster_report(spark, d):
    return clusters.cluster_report(_dimensions(spark, d), _E64)


_RAW = f"""(SELECT row_id,
  CASE WHEN row_id % 3 = 0 THEN replace(CAST(price AS VARCHAR), '.', ',') ELSE CAST(price AS VARCHAR) END AS price,
  CASE WHEN row_id % 13 = 0 THEN '' ELSE CAST(bal AS VARCHAR) END AS bal,
  CASE WHEN row_id % 11 = 0 THEN 'unknown' ELSE segment END AS segment FROM {_ML})"""


def _raw_rows(spark, d):
    ml = fixture(spark, d, "fx_ml")
    return ml.select(
        "row_id",
        F.when(F.col("row_id") % 3 == 0, F.regexp_replace(F.col("price").cast("string"), r"\.", ","))
        .otherwise(F.col("price").cast("string")).alias("price"),
        F.when(F.col("row_id") % 13 == 0, F.lit("")).otherwise(F.col("bal").cast("string")).alias("bal"),
        F.when(F.col("row_id") % 11 == 0, F.lit("unknown")).otherwise(F.col("segment")).alias("segment"))


_SEG = (f"(SELECT segment AS cls, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS DOUBLE) AS idx "
        f"FROM (SELECT DISTINCT segment FROM {_ML}))")


@query("encode_new_rows", oracle=f"""
SELECT r.row_id,
  (try_cast(replace(trim(r.price), ',', '.') AS DOUBLE) - (SELECT avg(price) FROM {_ML})) / (SELECT stddev_pop(price) FROM {_ML}) AS price,
  (try_cast(replace(trim(r.bal), ',', '.') AS DOUBLE) - (SELECT avg(bal) FROM {_ML})) / (SELECT stddev_pop(bal) FROM {_ML}) AS bal,
  s.idx AS segment,
  coalesce(CASE WHEN trim(r.price) = '' THEN 'missing value for ''price''' END,
           CASE WHEN trim(r.bal) = '' THEN 'missing value for ''bal''' END,
           CASE WHEN s.idx IS NULL THEN 'unknown value ''' || trim(r.segment) || ''' for segment' END) AS error
FROM {_RAW} r LEFT JOIN {_SEG} s ON s.cls = trim(r.segment)""", floats=("price", "bal", "segment"))
def q_encode_new_rows(spark, d):
    ml = fixture(spark, d, "fx_ml")
    _, mapping = features.label_encode(ml, ["segment"])
    _, sc = features.standardize(ml, ["price", "bal"])
    return models.encode_new_rows(_raw_rows(spark, d), ["price", "bal", "segment"], mapping, sc)


@query("predict")
def q_predict(spark, d):
    ml = fixture(spark, d, "fx_ml")
    return models.predict(ml, ml, _FEATS, "y_class", "classification", "DecisionTreeClassifier")


@query("predict_probabilities")
def q_predict_probabilities(spark, d):
    ml = fixture(spark, d, "fx_ml")
    return models.predict(ml, ml, _FEATS, "y_class", "classification", "LogisticRegression").select(
        "row_id", "predicted_class", "probability")
