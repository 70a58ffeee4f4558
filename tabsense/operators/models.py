"""Model training, evaluation, encoding of new rows and prediction.

Linear and logistic regression are Spark ML fits; trees and forests
(:mod:`trees`), boosting (:mod:`boosting`) and kernel machines
(:mod:`kernels`) are this package's own distributed jobs, since Spark ML's
stop at 32 bins, depth 30, depth-wise rounds and linear kernels.  The split
is a hash of ``row_id`` (same rows whatever the partitioning); metrics are
plain aggregates over (label, prediction).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.numeric import col
from tabsense.operators import boosting, kernels, trees
from tabsense.session import materialize
from tabsense.functions.schema import ROW_ID

# Fixed values of the reference's training setup.
TEST_SHARE = 0.2
SEED = 42
CLASSIFIERS = ["LogisticRegression", "RandomForestClassifier", "DecisionTreeClassifier", "SVC", "LGBMClassifier"]
REGRESSORS = ["LinearRegression", "RandomForestRegressor", "DecisionTreeRegressor", "SVR", "LGBMRegressor"]
FOREST_TREES = 100
# What is fitted in a form of our own (README: the bounds of each).
TRAINED_AS = {"SVC": "SVC on Nystroem landmarks", "SVR": "SVR on Nystroem landmarks",
              "LGBMClassifier": "leaf-wise histogram boosting", "LGBMRegressor": "leaf-wise histogram boosting"}

_MUL = 2654435761
_MOD = 1 << 32


def split_hash(seed: int = SEED):
    """``((row_id % 2^31) * 2654435761 + seed) % 2^32`` (same in SQL)."""
    return ((F.col(ROW_ID) % F.lit(1 << 31)) * F.lit(_MUL) + F.lit(seed)) % F.lit(_MOD)


def train_test_split(df: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds ``split`` = 'test' for about ``test_share`` of the rows, else
    'train'.  Deterministic, independent of partitioning."""
    return df.withColumn("split", F.when(split_hash(seed) < F.lit(int(test_share * _MOD)), F.lit("test"))
                         .otherwise(F.lit("train")))


def train_test_split_exact(df: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Like :func:`train_test_split` with exactly ceil(share x n) test rows: those
    of smallest split hash (ties by ``row_id``), numbered without a global window."""
    from tabsense.operators.rows import with_row_index
    order = with_row_index(df.select(split_hash(seed).alias("__h"), F.col(ROW_ID).alias("__rid")), ["__h", "__rid"], name="__place",
                           tie_break=False)
    tests = math.ceil(test_share * df.count())
    place = order.select(F.col("__rid").alias(ROW_ID), F.when(F.col("__place") < tests, F.lit("test")).otherwise(F.lit("train")).alias("split"))
    return df.join(place, ROW_ID).select(*[col(c) for c in df.columns], "split")


def standardize_target(df: DataFrame, target: str) -> DataFrame:
    """Regression target scaled with its population mean/std (before the split)."""
    r = df.agg(F.avg(col(target)).alias("m"), F.stddev_pop(col(target)).alias("s")).first()
    s = r["s"] if r["s"] else 1.0
    return df.withColumn(target, (col(target).cast("double") - F.lit(r["m"])) / F.lit(s))


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(
        df.withColumns({c: col(c).cast("double") for c in features}))


def class_table(df: DataFrame, target: str) -> DataFrame:
    """(class, label): the distinct values of the target as text, numbered in
    order (a distributed numbering; nulls have no class)."""
    from tabsense.operators.rows import with_row_index
    classes = df.where(col(target).isNotNull()).select(col(target).cast("string").alias("class")).distinct()
    return with_row_index(classes, ["class"], name="label").select("class", F.col("label").cast("double").alias("label"))


def with_label(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """``label`` = dense code of the target (sorted classes), and the class table.
    Rows without a class are left out."""
    classes = class_table(df, target)
    key = classes.select(F.col("class").alias("__class"), "label")
    named = df.withColumn("__target", col(target).cast("string")).drop("label")
    return named.join(key, F.col("__target") == F.col("__class")).drop("__target", "__class"), classes


class FitError(ValueError):
    """Data on which a model can't be fitted; a leaderboard reports it as a row."""


def vector_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(id, x, y) for the trainers: NaN is missing, that is null.  Written once, since fits read it many times."""
    number = lambda c: F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    row = F.col(ROW_ID).cast("long") if ROW_ID in df.columns else F.monotonically_increasing_id()
    return materialize(df.where(number(label).isNotNull()).select(
        row.alias("id"), F.array(*[number(c) for c in features]).alias("x"), number(label).alias("y")), "train-rows")


def _check(rows: DataFrame, name: str, n_classes: int) -> None:
    """Reasons not to fit, told before any work: no rows, one class, missing values where the model takes none."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("x", lambda v: v.isNull())).alias("holes"),
                 F.count_distinct("y").alias("classes")).first()
    if not r["n"]:
        raise FitError("no training rows")
    if r["holes"] and not name.startswith("LGBM"):
        raise FitError(f"{r['holes']} training rows have missing values")
    if n_classes and r["classes"] < 2 and name in ("LogisticRegression", "SVC"):
        raise FitError("training rows hold one class only")


def fit(rows: DataFrame, features: int, name: str, n_classes: int = 0):
    """A trained model with ``scores(rows)``; ``rows``: (id, x, y) of :func:`vector_rows`."""
    _check(rows, name, n_classes)
    if name in ("DecisionTreeClassifier", "DecisionTreeRegressor"):
        return trees.train(rows, features, n_classes, seed=SEED)
    if name == "RandomForestClassifier":
        return trees.train(rows, features, n_classes, FOREST_TREES, max(1, math.isqrt(features)), True, SEED)
    if name == "RandomForestRegressor":
        return trees.train(rows, features, n_classes, FOREST_TREES, None, True, SEED)
    if name in ("LGBMClassifier", "LGBMRegressor"):
        return boosting.train(rows, features, n_classes)
    if name in ("SVC", "SVR"):
        return kernels.train(rows, features, n_classes)
    raise ValueError(f"unknown model {name}")


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], name: str, label: str = "label",
                n_classes: int = 2) -> DataFrame:
    """Fit ``name`` on ``train`` and return ``test`` with ``prediction`` and, for classifiers that have them,
    ``probability`` (an array by class)."""
    rows = vector_rows(train, features, label)
    if name in ("LogisticRegression", "LinearRegression"):
        _check(rows, name, n_classes if name == "LogisticRegression" else 0)
        if name == "LogisticRegression":
            # scikit-learn's C = 1 on a summed loss == Spark's mean loss with regParam 1/n
            model = LogisticRegression(maxIter=500, regParam=1.0 / max(rows.count(), 1), elasticNetParam=0.0,
                                       standardization=False, family="multinomial")
        else:
            model = LinearRegression(regParam=0.0, solver="normal")
        out = model.setLabelCol(label).setFeaturesCol("features").fit(assemble(train, features)).transform(assemble(test, features))
        return (out.withColumn("probability", vector_to_array("probability")) if "probability" in out.columns else out).drop(
            *[c for c in ("features", "rawPrediction") if c in out.columns])
    model = fit(rows, len(features), name, n_classes if name in CLASSIFIERS else 0)
    scored = model.scores(test.withColumn("x", F.array(*[col(c).cast("double") for c in features]))) if "x" not in test.columns else \
        model.scores(test.withColumnRenamed("x", "__x").withColumn("x", F.array(*[col("__x" if c == "x" else c).cast("double") for c in features])))
    scored = scored.drop("x").withColumnRenamed("__x", "x")
    if name not in CLASSIFIERS:
        return scored.withColumn("prediction", F.get("scores", F.lit(0))).drop("scores")
    first = (F.array_position("scores", F.array_max("scores")) - 1).cast("double")  # the first of equal ones
    scored = scored.withColumn("prediction", first)
    return scored.drop("scores") if name == "SVC" else scored.withColumnRenamed("scores", "probability")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision, recall, F1 (0 when a
    denominator is 0).  Confusion counts by one groupBy, then sums."""
    conf = pred.groupBy(col(label).alias("y"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    y_tot = conf.groupBy("y").agg(F.sum("n").alias("support"))
    p_tot = conf.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("predicted"))
    tp = conf.where(F.col("y") == F.col("p")).select("y", F.col("n").alias("tp"))
    per = (y_tot.join(p_tot, "y", "full").join(tp, "y", "left")
           .fillna(0, ["support", "predicted", "tp"]))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    per = per.select("support", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    tot = F.sum("support")
    return per.agg((F.sum("tp") / tot).alias("accuracy"),
                   (F.sum(F.col("support") * F.col("prec")) / tot).alias("precision"),
                   (F.sum(F.col("support") * F.col("rec")) / tot).alias("recall"),
                   (F.sum(F.col("support") * F.col("f1")) / tot).alias("f1"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, MSE, RMSE, R2 in one aggregate."""
    e = col(prediction).cast("double") - col(label).cast("double")
    y = col(label).cast("double")
    return pred.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                    F.sqrt(F.avg(e * e)).alias("rmse"),
                    (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(y) * F.var_pop(y))).alias("r2"))


def linear_coefficients(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Ordinary least squares (normal equations) -> (term, value)."""
    data = assemble(df.where(col(target).isNotNull()), features).withColumn("label", col(target).cast("double"))
    m = LinearRegression(regParam=0.0, solver="normal").fit(data)
    rows = [(f, float(v)) for f, v in zip(features, m.coefficients.toArray())] + [("intercept", float(m.intercept))]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def model_leaderboard(df: DataFrame, target: str | None, features: list[str], ml_type: str,
                      models: list[str] | None = None) -> DataFrame:
    """All models of the type: one row per (model, metric), and an error row
    for data that a model can't be fitted on (any other failure is raised).
    Clustering models are in clusters.py."""
    spark = df.sparkSession
    rows = []
    schema = "model string, trained_as string, metric string, value double, error string"
    if ml_type not in ("classification", "regression"):
        return spark.createDataFrame([], schema)
    data = train_test_split(df)
    if ml_type == "regression":
        data = standardize_target(data, target).withColumn("label", col(target).cast("double"))
        names = models or REGRESSORS
        n_classes = 0
    else:
        data, classes = with_label(data, target)
        names = models or CLASSIFIERS
        n_classes = classes.count()
    data = materialize(data)
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    for name in names:
        fitted = TRAINED_AS.get(name, name)
        try:
            pred = fit_predict(train, test, features, name, n_classes=n_classes)
            m = (classification_metrics(pred) if ml_type == "classification" else regression_metrics(pred)).first()
            rows += [(name, fitted, k, float(v) if v is not None else None, None) for k, v in m.asDict().items()]
        except FitError as exc:
            rows.append((name, fitted, "error", None, str(exc).splitlines()[0][:500]))
    return spark.createDataFrame(rows, schema)


def encode_new_rows(raw: DataFrame, features: list[str], mapping: DataFrame, scaler: DataFrame) -> DataFrame:
    """Encode raw text inputs like the training data: classes via the label
    map (unknown -> error), numbers with a decimal comma accepted and
    scaled, unmapped columns as plain numbers, empty -> error.  Batch; one
    ``error`` column (first problem, in feature order) instead of raising."""
    out = raw
    errors = []
    sc = {r["column"]: (r["mean"], r["scale"]) for r in scaler.collect()}   # one row per column
    mapped = {r["column"] for r in mapping.select("column").distinct().collect()}
    for c in features:
        v = F.trim(col(c).cast("string"))
        missing = v.isNull() | (v == "")
        if c in mapped:
            m = mapping.where(F.col("column") == c).select(F.col("class").alias(f"__cls_{c}"),
                                                            F.col("idx").cast("double").alias(f"__idx_{c}"))
            out = out.join(m, v == F.col(f"__cls_{c}"), "left")
            val = F.col(f"__idx_{c}")
            err = (F.when(missing, F.lit(f"missing value for '{c}'"))
                   .when(val.isNull(), F.concat(F.lit("unknown value '"), v, F.lit(f"' for {c}"))))
            out = out.withColumn(f"__err_{c}", err).withColumn(c, val).drop(f"__cls_{c}", f"__idx_{c}")
        else:
            num = F.expr(f"try_cast(replace(trim(`{c}`), ',', '.') AS DOUBLE)")
            err = (F.when(missing, F.lit(f"missing value for '{c}'"))
                   .when(num.isNull(), F.concat(F.lit("cannot read '"), v, F.lit(f"' as a number for {c}"))))
            if c in sc and sc[c][0] is not None:
                num = (num - F.lit(sc[c][0])) / F.lit(sc[c][1])
            out = out.withColumn(f"__err_{c}", err).withColumn(c, num)
        errors.append(F.col(f"__err_{c}"))
    out = out.withColumn("error", F.coalesce(*errors) if errors else F.lit(None).cast("string"))
    return out.drop(*[f"__err_{c}" for c in features])


def predict(train: DataFrame, new_rows: DataFrame, features: list[str], target: str | None, ml_type: str,
            model: str) -> DataFrame:
    """Fit ``model`` once on all training rows and score the batch; adds
    ``prediction`` (and ``predicted_class`` for classification) and, when the
    model has them, ``probability`` as an array.  Rows with a missing feature
    (such as those :func:`encode_new_rows` gives an error) come through
    without a prediction; training leaves incomplete rows out."""
    complete = F.lit(True)
    for c in features:
        complete = complete & col(c).cast("double").isNotNull()
    good, rest = new_rows.where(complete), new_rows.where(~complete)
    train = train.where(complete)
    if ml_type == "clustering":
        from tabsense.operators.clusters import kmeans_model
        pred = kmeans_model(train, features).transform(assemble(good, features)).drop("features")
        return pred.unionByName(rest, allowMissingColumns=True)
    if ml_type == "regression":
        data, classes = train.where(col(target).isNotNull()).withColumn("label", col(target).cast("double")), None
    else:
        data, classes = with_label(train, target)
        data, classes = materialize(data), materialize(classes)
    pred = fit_predict(data, good.drop("label"), features, model, n_classes=classes.count() if classes else 0)
    if classes is not None:
        names = classes.select(F.col("label").alias("__label"), F.col("class").alias("predicted_class"))
        pred = pred.join(names, F.col("prediction") == F.col("__label"), "left").drop("__label")
    return pred.unionByName(rest, allowMissingColumns=True)
