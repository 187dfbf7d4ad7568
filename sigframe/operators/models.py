"""Cross-validated classification on a feature matrix
``(id, target, features array<double>)``.

* M-1 / M-2 / M-3: deterministic hash folds (md5 of the key), hold-out and
  subject-grouped folds — repeatable, unlike unseeded shuffles.
* M-5 Gaussian naive Bayes in relational form: per (fold, class, feature)
  mean / variance from the rows that train that fold, log-likelihood sums for
  the test rows, argmax with ties to the lowest class.  Variance floor is
  1e-9 x the largest feature variance of the fold's training rows.
* M-4 / J-8 / W-8 exact k-nearest neighbours by blocks of rows
  (``neighbours``); ties by (distance, train id), vote ties to the lowest class.
* ``knn`` has k-NN as a Spark ML estimator, to be stored and passed on.
* M-6 forest (``forest``, an estimator too) and ML naive Bayes via Spark ML, fitted per fold (``FITS`` folds
  at the same time, in threads of the driver); M-7 / M-8 softmax boosted trees (``boosting``);
  M-12 prediction with a stored model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.columns import hash_fold
from sigframe.operators import boosting
from sigframe.operators.forest import Forest
from sigframe.operators.knn import NearestNeighbours
from sigframe.operators.neighbours import BLOCK_ROWS, nearest, vote

N_FOLDS = 3
HOLDOUT = 0.33
KNN_K = 7
VAR_SMOOTHING = 1e-9
#: Folds that are fitted at the same time; the driver holds what grows of each.
FITS = 3


def with_folds(matrix: DataFrame, key: str = "id", k: int = N_FOLDS) -> DataFrame:
    """M-1 (key = row id) / M-3 (key = subject): fold number 0..k-1."""
    return matrix.withColumn("fold", hash_fold(key, k))


def holdout(matrix: DataFrame, key: str = "id", test_share: float = HOLDOUT) -> DataFrame:
    """M-2: ``is_test`` from the hash bucket (share in percent buckets)."""
    return matrix.withColumn("is_test", hash_fold(key, 100) < int(round(test_share * 100)))


def _train_copies(df: DataFrame, k: int) -> DataFrame:
    """Each row once per fold it trains (all folds except its own)."""
    others = F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda f: f != F.col("fold"))
    return df.withColumn("f", F.explode(others))


def gaussian_nb_cv(matrix: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """M-5 under k-fold CV: ``(fold, id, y, yhat, p_true)``."""
    pts = matrix.select("id", F.col("target").alias("y"), "fold", F.posexplode("features").alias("j", "x"))
    train = _train_copies(pts, k)
    stats = train.groupBy("f", "y", "j").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
    eps = train.groupBy("f", "j").agg(F.var_pop("x").alias("v")).groupBy("f").agg(
        (F.max("v") * VAR_SMOOTHING).alias("eps"))
    prior = train.filter(F.col("j") == 0).groupBy("f", "y").agg(F.count(F.lit(1)).alias("nc"))
    prior = prior.withColumn("lp", F.log(F.col("nc") / F.sum("nc").over(Window.partitionBy("f"))))
    model = stats.join(eps, "f").join(prior.select("f", "y", "lp"), ["f", "y"]).select(
        "f", F.col("y").alias("c"), "j", "mu", (F.col("var") + F.col("eps")).alias("var"), "lp")
    test = pts.withColumnRenamed("fold", "f")
    term = -0.5 * (F.log(F.lit(2 * math.pi) * F.col("var")) + (F.col("x") - F.col("mu")) ** 2 / F.col("var"))
    scores = test.join(model, ["f", "j"]).groupBy("f", "id", "y", "c").agg(
        (F.sum(term) + F.first("lp")).alias("score"))
    return _argmax(scores)


def _argmax(scores: DataFrame) -> DataFrame:
    """Pick the best class per test row (ties -> lowest class) and its probability."""
    w = Window.partitionBy("f", "id").orderBy(F.col("score").desc(), F.col("c"))
    wa = Window.partitionBy("f", "id")
    top = F.max("score").over(wa)
    ranked = scores.withColumn("_r", F.row_number().over(w)).withColumn(
        "_lse", top + F.log(F.sum(F.exp(F.col("score") - top)).over(wa)))
    p_true = F.max(F.when(F.col("c") == F.col("y"), F.exp(F.col("score") - F.col("_lse")))).over(wa)
    ranked = ranked.withColumn("p_true", p_true)
    return ranked.filter(F.col("_r") == 1).select(F.col("f").alias("fold"), "id", "y", F.col("c").alias("yhat"),
                                                  "p_true")


def knn_cv(matrix: DataFrame, k: int = KNN_K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """M-4 exact k-NN under cross-validation: ``(fold, id, y, yhat)``; a row's
    neighbours come from the other folds."""
    rows = matrix.select("id", F.col("target").alias("y"), F.col("fold").alias("grp"), "features")
    out = vote(nearest(rows, rows, k, block_rows))
    return matrix.select("fold", "id", F.col("target").alias("y")).join(out, "id").select(
        "fold", "id", "y", F.col("yhat").cast(matrix.schema["target"].dataType).alias("yhat"))


# X-4: classifier registry (name -> factory(seed) returning an ML estimator)
CLASSIFIERS: dict[str, object] = {}

#: M-7, M-8: the presets of the softmax boosted trees.
BOOSTED = {"BoostedTreesA": boosting.PRESET_A, "BoostedTreesB": boosting.PRESET_B}


#: A classifier's name, or a factory ``(seed) -> Estimator``.
Classifier = str | Callable[[int], object]


def register_classifier(name: str, factory) -> None:
    """Add or replace a classifier factory ``factory(seed) -> Estimator``."""
    CLASSIFIERS[name] = factory


def ml_estimator(name: Classifier, seed: int = 42, **params):
    """M-6, ML naive Bayes, k-NN and registered classifiers with the source presets;
    ``params`` replace a preset's own.  A factory in place of a name is called (X-4)."""
    from pyspark.ml.classification import NaiveBayes, RandomForestClassifier

    if callable(name):
        return name(seed)
    if name == "KNeighborsClassifier":
        return NearestNeighbours(**{"k": KNN_K} | params)
    if name == "RandomForestClassifier":  # depth 32 exceeds Spark's limit of 30
        own = {"numTrees": 240, "maxDepth": 30, "featureSubsetStrategy": "log2", "seed": seed} | params
        # what Forest lacks (other impurities, limits of a leaf, more than 256 bins) is Spark ML's
        plain = all(Forest().hasParam(p) for p in own) and own.get("maxBins", 32) <= 256
        return (Forest if plain else RandomForestClassifier)(**own)
    if name == "GaussianNB":
        return NaiveBayes(**{"modelType": "gaussian"} | params)
    if name in CLASSIFIERS:
        return CLASSIFIERS[name](seed)
    raise ValueError(f"unknown classifier {name}")


def boosted_cv(matrix: DataFrame, settings: boosting.Settings, n_folds: int = N_FOLDS) -> DataFrame:
    """M-7 / M-8 under cross-validation, all folds' models grown together: ``(fold, id, y, yhat)``."""
    out = None
    for f, model in enumerate(boosting.fit_folds(matrix, settings, n_folds)):
        pred = boosting.predict(model, matrix.where(F.col("fold") == f)).select(
            "fold", "id", F.col("target").alias("y"), F.col("prediction").alias("yhat"))
        out = pred if out is None else out.unionByName(pred)
    return out


def to_ml(matrix: DataFrame) -> DataFrame:
    """M-13 vector form for Spark ML: ``features`` vector and double ``label``."""
    from pyspark.ml.functions import array_to_vector

    return matrix.withColumn("vec", array_to_vector("features")).withColumn("label", F.col("target").cast("double"))


def ml_cv(matrix: DataFrame, name: Classifier, n_folds: int = N_FOLDS, **params) -> DataFrame:
    """M-9 by name: predictions ``(fold, id, y, yhat)``; ML estimators are fitted and applied once per
    fold, ``FITS`` folds at the same time, since either is a chain of jobs that leaves cores idle."""
    if isinstance(name, str) and name in BOOSTED:
        return boosted_cv(matrix, replace(BOOSTED[name], **params), n_folds)
    # the vector table feeds every fold's fit: materialise it once
    from sigframe.session import cut_lineage

    data = cut_lineage(to_ml(matrix))
    ests = [ml_estimator(name, **params).setFeaturesCol("vec").setLabelCol("label") for _ in range(n_folds)]
    fit = inheritable_thread_target(matrix.sparkSession)(lambda f: ests[f].fit(data.filter(F.col("fold") != f)))
    apply = inheritable_thread_target(matrix.sparkSession)(lambda f: models[f].transform(data.filter(F.col("fold") == f)))
    with ThreadPool(min(n_folds, FITS)) as pool:
        models = pool.map(fit, range(n_folds), chunksize=1)
        applied = pool.map(apply, range(n_folds), chunksize=1)
    out = None
    for f, rows in enumerate(applied):
        pred = rows.select(
            F.lit(f).alias("fold"), "id", F.col("target").alias("y"), F.col("prediction").cast("int").alias("yhat"))
        out = pred if out is None else out.unionByName(pred)
    return out


def cv_predictions(matrix: DataFrame, name: Classifier, n_folds: int = N_FOLDS, **params) -> DataFrame:
    """M-9: ``(fold, id, y, yhat)`` of one classifier; the relational forms of naive
    Bayes and k-NN serve all folds in one job."""
    if name == "GaussianNB" and not params:
        return gaussian_nb_cv(matrix, n_folds).drop("p_true")
    if name == "KNeighborsClassifier" and not params:
        return knn_cv(matrix)
    return ml_cv(matrix, name, n_folds, **params)


def fit_pipeline(matrix: DataFrame, name: Classifier, **params):
    """M-10 / S-12: fit one classifier on all rows given as a persistable model: a
    PipelineModel, or the trees of a boosted preset."""
    from pyspark.ml import Pipeline

    if isinstance(name, str) and name in BOOSTED:
        return boosting.fit(matrix, replace(BOOSTED[name], **params))
    est = ml_estimator(name, **params).setFeaturesCol("vec").setLabelCol("label")
    return Pipeline(stages=[est]).fit(to_ml(matrix))


def predict(model, matrix: DataFrame) -> DataFrame:
    """M-12: apply a stored model: ``(id, prediction)``."""
    if isinstance(model, boosting.Model):
        return boosting.predict(model, matrix).select("id", "prediction")
    return model.transform(to_ml(matrix)).select("id", F.col("prediction").cast("int").alias("prediction"))
