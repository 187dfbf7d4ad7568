"""Registered queries: matrix preparation, folds, classifiers and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.functions.columns import round_sig
from sigframe.operators import matrix as X
from sigframe.operators import metrics as A
from sigframe.operators import models as M
from sigframe.operators.knn import NearestNeighbours
from sigframe.plans.flows import compare_datasets
from sigframe.plans.oracle import SERIES_CTE, r, rs, with_ctes
from sigframe.plans.q_selection import FEATURES_CTE, _features
from sigframe.plans.q_series import events_series
from sigframe.plans.registry import register
from sigframe.sources.standins import matrix_from_embeddings
from sigframe.sources.tables import load

FOLD_SQL = "CAST(CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8) AS BIGINT) % {n} AS INTEGER)"

NAMES_CTE = FEATURES_CTE + """,
nm2 AS (SELECT DISTINCT feature, regexp_replace(feature, '[^A-Za-z0-9_]', '', 'g') AS clean_feature FROM imp),
nk AS (SELECT feature, clean_feature, feature = min(feature) OVER (PARTITION BY clean_feature) AS kept FROM nm2),
cl AS (SELECT i.series_id, n.clean_feature AS feature,
              coalesce(CASE WHEN isnan(i.value) THEN NULL ELSE i.value END, -1.0) AS value
       FROM imp i JOIN nk n USING (feature) WHERE n.kept)"""

MATRIX_CTE = f"""mx AS (SELECT vec_id AS id, label AS target, {FOLD_SQL.format(k='vec_id', n=M.N_FOLDS)} AS fold,
                 CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"""

_GNB = f""",
pts AS (SELECT id, target AS y, fold, generate_subscripts(features, 1) - 1 AS j, unnest(features) AS x FROM mx),
tr AS (SELECT p.*, ff.f FROM pts p CROSS JOIN range(0, {M.N_FOLDS}) ff(f) WHERE ff.f <> p.fold),
st AS (SELECT f, y, j, avg(x) AS mu, var_pop(x) AS var FROM tr GROUP BY 1, 2, 3),
ep AS (SELECT f, max(v) * {M.VAR_SMOOTHING!r} AS eps FROM (SELECT f, j, var_pop(x) AS v FROM tr GROUP BY 1, 2) GROUP BY 1),
pr AS (SELECT f, y, ln(nc / sum(nc) OVER (PARTITION BY f)) AS lp FROM (SELECT f, y, count(*) AS nc FROM tr WHERE j = 0
       GROUP BY 1, 2)),
md AS (SELECT st.f, st.y AS c, st.j, st.mu, st.var + ep.eps AS var, pr.lp FROM st JOIN ep USING (f) JOIN pr USING (f, y)),
sc AS (SELECT t.fold AS f, t.id, t.y, md.c,
              sum(-0.5 * (ln(6.283185307179586 * md.var) + pow(t.x - md.mu, 2) / md.var)) + any_value(md.lp) AS score
       FROM pts t JOIN md ON md.f = t.fold AND md.j = t.j GROUP BY 1, 2, 3, 4),
ag AS (SELECT *, row_number() OVER (PARTITION BY f, id ORDER BY score DESC, c) AS rr,
              max(score) OVER (PARTITION BY f, id) AS top FROM sc),
ls AS (SELECT *, top + ln(sum(exp(score - top)) OVER (PARTITION BY f, id)) AS lse FROM ag),
gnb AS (SELECT 'embeddings' AS dataset, 'GaussianNB' AS classifier, f AS fold, id, y, c AS yhat, p_true FROM (
          SELECT *, max(CASE WHEN c = y THEN exp(score - lse) END) OVER (PARTITION BY f, id) AS p_true FROM ls)
        WHERE rr = 1)"""
GNB_CTE = MATRIX_CTE + _GNB

_DIST = ("sqrt(list_reduce(list_transform(range(1, len(q.features) + 1), "
         "lambda i: (q.features[i] - t.features[i]) * (q.features[i] - t.features[i])), lambda s, v: s + v))")
_KNN = f""",
kp AS (SELECT q.id, q.target AS y, q.fold, t.id AS tid, t.target AS ty, {_DIST} AS dist
       FROM mx q JOIN mx t ON t.fold <> q.fold),
kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS rr FROM kp)
       WHERE rr <= {M.KNN_K}),
kv AS (SELECT fold, id, y, ty, count(*) AS v FROM kt GROUP BY 1, 2, 3, 4),
knn AS (SELECT 'embeddings' AS dataset, 'KNeighborsClassifier' AS classifier, fold, id, y, ty AS yhat FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, ty) AS rr FROM kv) WHERE rr = 1)"""
KNN_CTE = GNB_CTE + _KNN

SCORES_SQL = """SELECT dataset, classifier, fold, tp / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
FROM (SELECT dataset, classifier, fold, sum(hit) AS tp, sum(given - hit) AS fp, sum(had - hit) AS fn, sum(had) AS n
      FROM (SELECT dataset, classifier, fold, c, sum(had) AS had, sum(given) AS given, sum(hit) AS hit
            FROM (SELECT dataset, classifier, fold, y AS c, 1 AS had, 0 AS given, CAST(y = yhat AS INTEGER) AS hit FROM {src}
                  UNION ALL SELECT dataset, classifier, fold, yhat, 0, 1, 0 FROM {src}) GROUP BY 1, 2, 3, 4)
      GROUP BY 1, 2, 3)"""


def _matrix(spark, d):
    return M.with_folds(matrix_from_embeddings(load(spark, d, "embeddings")))


def _gnb(spark, d):
    return M.gaussian_nb_cv(_matrix(spark, d)).select(
        F.lit("embeddings").alias("dataset"), F.lit("GaussianNB").alias("classifier"), "*")


def _knn(spark, d):
    return M.knn_cv(_matrix(spark, d)).select(
        F.lit("embeddings").alias("dataset"), F.lit("KNeighborsClassifier").alias("classifier"), "*")


@register("series_drop_channels", "P-8",
          with_ctes(SERIES_CTE, f"SELECT series_id, subject, target, channel, t, {r('x', 'x')} FROM series "
                                "WHERE channel NOT IN ('isLR', 'peopleIndex', 'target')"))
def q_series_drop_channels(spark, d):
    return X.drop_channels(events_series(spark, d))


@register("matrix_names", "P-9 P-10", with_ctes(NAMES_CTE, "SELECT feature, clean_feature, kept FROM nk"))
def q_matrix_names(spark, d):
    return X.name_map(_features(spark, d))


@register("matrix_clean", "P-11", with_ctes(NAMES_CTE, f"SELECT series_id, feature, {r('value', 'value')} FROM cl"))
def q_matrix_clean(spark, d):
    return X.clean_features(_features(spark, d))


@register("matrix_vectors", "M-13", with_ctes(NAMES_CTE + """,
ix AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM cl))""",
                                              f"SELECT series_id, list({rs('value')} ORDER BY idx) AS features "
                                              "FROM cl JOIN ix USING (feature) GROUP BY series_id"))
def q_matrix_vectors(spark, d):
    return X.assemble(X.clean_features(_features(spark, d)))


@register("matrix_labels", "P-12 P-13",
          with_ctes(SERIES_CTE, "SELECT target, count(*) AS n FROM (SELECT DISTINCT series_id, subject, target "
                                "FROM series) GROUP BY target"))
def q_matrix_labels(spark, d):
    return X.label_report(X.labels(events_series(spark, d)))


@register("model_folds", "M-1 J-9",
          f"SELECT vec_id AS id, label AS target, {FOLD_SQL.format(k='vec_id', n=M.N_FOLDS)} AS fold FROM embeddings")
def q_model_folds(spark, d):
    return _matrix(spark, d).select("id", "target", "fold")


@register("model_holdout", "M-2",
          f"SELECT vec_id AS id, {FOLD_SQL.format(k='vec_id', n=100)} < 33 AS is_test FROM embeddings")
def q_model_holdout(spark, d):
    return M.holdout(matrix_from_embeddings(load(spark, d, "embeddings"))).select("id", "is_test")


@register("model_subject_folds", "M-3",
          with_ctes(SERIES_CTE, f"SELECT DISTINCT series_id, subject, {FOLD_SQL.format(k='subject', n=M.N_FOLDS)} "
                                "AS fold FROM series"))
def q_model_subject_folds(spark, d):
    return M.with_folds(X.labels(events_series(spark, d)), key="subject").select("series_id", "subject", "fold")


@register("model_gnb_predictions", "M-5",
          with_ctes(GNB_CTE, f"SELECT dataset, classifier, fold, id, y, yhat, {r('p_true', 'p_true')} FROM gnb"))
def q_model_gnb(spark, d):
    return _gnb(spark, d)


@register("model_knn_predictions", "M-4 J-8 W-8",
          with_ctes(KNN_CTE, "SELECT dataset, classifier, fold, id, y, yhat FROM knn"))
def q_model_knn(spark, d):
    return _knn(spark, d)


@register("model_cv_scores", "A-7 A-8 M-9 U-4",
          with_ctes(KNN_CTE + ",\nfm AS (" + SCORES_SQL.format(src="(SELECT dataset, classifier, fold, id, y, yhat "
                                                                    "FROM gnb UNION ALL SELECT * FROM knn)") + ")",
                    "SELECT dataset, classifier, " + ", ".join(r(f"avg({m})", m) for m in A.METRICS) +
                    " FROM fm GROUP BY dataset, classifier"))
def q_model_cv_scores(spark, d):
    pred = _gnb(spark, d).drop("p_true").unionByName(_knn(spark, d))
    return A.cv_scores(pred)


@register("model_confusion", "A-9",
          with_ctes(GNB_CTE, "SELECT dataset, classifier, y, yhat, count(*) AS n FROM gnb GROUP BY 1, 2, 3, 4"))
def q_model_confusion(spark, d):
    return A.confusion(_gnb(spark, d))


@register("model_log_loss", "A-10",
          with_ctes(GNB_CTE, f"SELECT dataset, classifier, {r('avg(-ln(greatest(p_true, 1e-15)))', 'log_loss')} "
                             "FROM gnb GROUP BY 1, 2"))
def q_model_log_loss(spark, d):
    return A.log_loss(_gnb(spark, d))


@register("model_class_metrics", "A-11",
          with_ctes(GNB_CTE + """,
cells AS (SELECT dataset, classifier, y, yhat, count(*) AS n FROM gnb GROUP BY 1, 2, 3, 4),
cls_ AS (SELECT DISTINCT dataset, classifier, y AS c FROM cells UNION SELECT DISTINCT dataset, classifier, yhat FROM cells),
cm AS (SELECT k.dataset, k.classifier, k.c,
         coalesce((SELECT sum(n) FROM cells e WHERE e.dataset = k.dataset AND e.classifier = k.classifier
                   AND e.y = k.c AND e.yhat = k.c), 0) AS tp,
         coalesce((SELECT sum(n) FROM cells e WHERE e.dataset = k.dataset AND e.classifier = k.classifier
                   AND e.yhat = k.c), 0) AS pp,
         coalesce((SELECT sum(n) FROM cells e WHERE e.dataset = k.dataset AND e.classifier = k.classifier
                   AND e.y = k.c), 0) AS ap FROM cls_ k),
cp AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p_, CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS r_
       FROM cm)""", f"""SELECT dataset, classifier, c, {r('p_', 'precision')}, {r('r_', 'recall')},
  {r('CASE WHEN p_ + r_ > 0 THEN 2 * p_ * r_ / (p_ + r_) ELSE 0.0 END', 'f1')} FROM cp"""))
def q_model_class_metrics(spark, d):
    return A.class_metrics(_gnb(spark, d))


@register("model_comparison", "P-16 M-14",
          with_ctes(KNN_CTE + ",\nfm AS (" + SCORES_SQL.format(src="(SELECT dataset, classifier, fold, id, y, yhat "
                                                                    "FROM gnb UNION ALL SELECT * FROM knn)") + """),
sc2 AS (SELECT dataset, classifier, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall,
               avg(f1) AS f1 FROM fm GROUP BY 1, 2),
lg AS (SELECT * FROM sc2 UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1)))""",
                    f"SELECT dataset, classifier, metric, {r('value', 'value')}, "
                    "CAST(rank() OVER (PARTITION BY dataset, metric ORDER BY value DESC) AS INTEGER) AS rank FROM lg"))
def q_model_comparison(spark, d):
    pred = _gnb(spark, d).drop("p_true").unionByName(_knn(spark, d))
    return A.compare(A.cv_scores(pred))


@register("model_forest_predictions", "M-6 M-9 M-10")
def q_model_forest(spark, d):
    return M.ml_cv(_matrix(spark, d), "RandomForestClassifier").select(
        F.lit("embeddings").alias("dataset"), F.lit("RandomForestClassifier").alias("classifier"), "*")


@register("model_ml_nb_predictions", "M-5 M-9")
def q_model_ml_nb(spark, d):
    return M.ml_cv(_matrix(spark, d), "GaussianNB").select(
        F.lit("embeddings").alias("dataset"), F.lit("GaussianNB").alias("classifier"), "*")


def _extents(spark, d):
    """A second dataset: number, mean, minimum and maximum of each series' points."""
    x0 = events_series(spark, d).where(F.col("channel") == "x_0")
    stats = x0.groupBy(F.col("series_id").alias("id"), F.col("target").cast("int").alias("target")).agg(
        F.array(F.count("x").cast("double"), round_sig(F.avg("x")), F.min("x"), F.max("x")).alias("features"))
    return M.with_folds(stats)


EXTENTS_CTE = SERIES_CTE + f""",
mx AS (SELECT id, target, {FOLD_SQL.format(k='id', n=M.N_FOLDS)} AS fold, features FROM (
         SELECT series_id AS id, CAST(target AS INTEGER) AS target,
                [CAST(count(x) AS DOUBLE), {rs('avg(x)')}, min(x), max(x)] AS features
         FROM series WHERE channel = 'x_0' GROUP BY 1, 2))"""

#: k-NN with three votes beside ``knn``.
_THREE = """,
v3 AS (SELECT fold, id, y, ty, count(*) AS v FROM kt WHERE rr <= 3 GROUP BY 1, 2, 3, 4),
knn3 AS (SELECT 'embeddings' AS dataset, 'ThreeNearest' AS classifier, fold, id, y, ty AS yhat FROM (
           SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, ty) AS rr FROM v3) WHERE rr = 1)"""


def _predictions_sql(ctes: str, dataset: str) -> str:
    return (f"SELECT '{dataset}' AS dataset, classifier, fold, id, y, yhat FROM (" + with_ctes(
        ctes + _GNB + _KNN + _THREE, "SELECT classifier, fold, id, y, yhat FROM gnb UNION ALL SELECT classifier, fold, id, y, yhat "
        "FROM knn UNION ALL SELECT classifier, fold, id, y, yhat FROM knn3") + ")")


@register("model_scores_by_dataset", "U-4 U-5 M-11 M-14 X-4",
          with_ctes(f"ap AS ({_predictions_sql(MATRIX_CTE, 'embeddings')} UNION ALL {_predictions_sql(EXTENTS_CTE, 'extents')}),\n"
                    "fm AS (" + SCORES_SQL.format(src="ap") + ")",
                    "SELECT dataset, classifier, " + ", ".join(r(f"avg({m})", m) for m in A.METRICS) +
                    " FROM fm GROUP BY dataset, classifier"))
def q_model_scores_by_dataset(spark, d):
    return compare_datasets({"embeddings": _matrix(spark, d), "extents": _extents(spark, d)}, {
        "GaussianNB": "GaussianNB", "KNeighborsClassifier": "KNeighborsClassifier",
        "ThreeNearest": lambda seed: NearestNeighbours(k=3)})


@register("model_stored_neighbours", "M-4 M-9 M-12 S-12",
          with_ctes(MATRIX_CTE + f""",
kp AS (SELECT q.id, t.id AS tid, t.target AS ty, {_DIST} AS dist FROM mx q JOIN mx t ON t.fold <> {M.N_FOLDS - 1}),
kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS rr FROM kp)
       WHERE rr <= {M.KNN_K}),
kv AS (SELECT id, ty, count(*) AS v FROM kt GROUP BY 1, 2)""", """SELECT id, ty AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, ty) AS rr FROM kv) WHERE rr = 1"""))
def q_model_stored_neighbours(spark, d):
    """The model of the last fold, stored, loaded and applied to all rows."""
    from sigframe.plans.q_more import _shared_folder
    from sigframe.sources.tables import load_model, save_model

    matrix = _matrix(spark, d)
    path = _shared_folder(spark, "neighbours")
    save_model(M.fit_pipeline(matrix.where(F.col("fold") != M.N_FOLDS - 1), "KNeighborsClassifier"), path)
    return M.predict(load_model(path), matrix)
