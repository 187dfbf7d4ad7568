"""End-to-end plans — the four entry points of the analysed workload, each a
lazy DataFrame pipeline with explicit materialisation points:

* :func:`extract_regions` (entry A): voxels + atlas(es) -> region series ->
  optional confound removal / standardisation -> equalised lengths -> table.
* :func:`extract_features` (entry B): series -> feature families -> imputation
  -> FRESH selection -> labelled long feature table.
* :func:`build_models` (entry C): feature matrix -> k-fold CV of every
  registered classifier -> score table (+ persisted models).
* :func:`resting_regions` (entry D): resting-state region series cleaned of
  confounds, written per subject and run.

Lineage is cut with reliable checkpoints (shared ``spark.checkpoint.dir``) or
written tables, never with local checkpoints.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators import matrix as X
from sigframe.operators import metrics as A
from sigframe.operators import models as M
from sigframe.operators import regions as R
from sigframe.operators import selection as V
from sigframe.operators import series as S
from sigframe.operators.features.extract import COMPREHENSIVE, extract
from sigframe.operators.features.impute import impute
from sigframe.operators.ordering import dense_index
from sigframe.session import cut_lineage
from sigframe.sources.tables import Catalog, save_model, write_runs


def regions_as_series(regions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Region table -> canonical long series: ``subjects(scan_id, subject, target)``
    tags each scan, and an optional ``run`` orders the scans of one subject and
    class: a run's points follow the whole run before it.  Channels are
    ``x_<label>``; ``t`` is the dense position inside each channel (the original
    time is kept as ``time``)."""
    run = F.col("run") if "run" in subjects.columns else F.lit(0)
    tagged = regions.join(subjects, "scan_id").select(
        series_key(F.col("subject"), F.col("target")).alias("series_id"), "subject", "target",
        F.concat(F.lit("x_"), F.col("label").cast("string")).alias("channel"), run.alias("_run"), "scan_id",
        F.col("t").alias("time"), "x")
    return dense_index(tagged, ["series_id", "channel"], ["_run", "time", "scan_id"]).drop("_run", "scan_id")


#: Classes that a series key has room for.
MOST_TARGETS = 1 << 20


def series_key(subject, target):
    """One number for each pair of subject and class code (0 to ``MOST_TARGETS`` - 1; others raise)."""
    fits = target.between(0, MOST_TARGETS - 1)
    return F.when(fits, subject.cast("bigint") * MOST_TARGETS + target).otherwise(
        F.raise_error(F.concat(F.lit("class code out of range: "), target.cast("string"))))


def extract_regions(voxels: DataFrame, atlas: DataFrame, subjects: DataFrame, catalog: Catalog | None = None,
                    table: str | None = None, clean: bool = False, standardize: bool = False) -> DataFrame:
    """Entry A: region series of every scan, equalised to the shortest channel."""
    regions = R.region_time_series(voxels, atlas, clean=clean, standardize=standardize)
    series = regions_as_series(regions, subjects)
    out = S.equalise(series, channel=None)
    if catalog is not None and table:
        catalog.write_table(table, out)
    return out


def extract_features(series: DataFrame, families: Sequence[str] = COMPREHENSIVE, select: bool = True,
                     catalog: Catalog | None = None, table: str | None = None) -> DataFrame:
    """Entry B: long features with labels; relevant features only when ``select``."""
    feats = cut_lineage(impute(extract(series, families)))
    labels = X.labels(series)
    if select:
        targets = labels.select("series_id", F.col("target").cast("double").alias("target"))
        rel = V.benjamini_yekutieli(V.feature_pvalues(feats, targets))
        feats = V.select_relevant(feats, rel)
    out = feats.join(labels, "series_id")
    if catalog is not None and table:
        catalog.write_table(table, out)
    return out


def feature_matrix(features: DataFrame) -> DataFrame:
    """Long features -> ``(id, subject, target, features array)`` with folds by row id."""
    clean = X.clean_features(features.select("series_id", "feature", "value"))
    vec = X.assemble(clean)
    labels = features.select("series_id", "subject", "target").distinct()
    return M.with_folds(vec.join(labels, "series_id").withColumnRenamed("series_id", "id"))


#: The classifiers that entry C compares.
FIVE = ("GaussianNB", "KNeighborsClassifier", "RandomForestClassifier", "BoostedTreesA", "BoostedTreesB")


def build_models(matrix: DataFrame, dataset: str, classifiers: Sequence[str] | Mapping[str, M.Classifier] = FIVE,
                 catalog: Catalog | None = None, model_dir: str | None = None, last_fold: bool = False,
                 params: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Entry C: CV scores per classifier for one dataset, and every model stored.

    ``classifiers``: names, or names with factories ``(seed) -> Estimator`` (X-4).
    With ``model_dir``, each classifier's model is saved under
    ``<model_dir>/<dataset>_<classifier>``: fitted on all rows, or, with
    ``last_fold``, on the rows that train the last fold.  ``params`` replaces
    settings of a classifier's preset.
    """
    chosen = classifiers if isinstance(classifiers, Mapping) else {name: name for name in classifiers}
    matrix = cut_lineage(matrix)
    train = matrix.where(F.col("fold") != M.N_FOLDS - 1) if last_fold else matrix
    preds = []
    for name, classifier in chosen.items():
        own = (params or {}).get(name, {})
        preds.append(M.cv_predictions(matrix, classifier, **own).select(
            F.lit(dataset).alias("dataset"), F.lit(name).alias("classifier"), "fold", "id", "y", "yhat"))
        if model_dir:
            save_model(M.fit_pipeline(train, classifier, **own), f"{model_dir}/{dataset}_{name}")
    scores = A.cv_scores(reduce(DataFrame.unionByName, preds))
    if catalog is not None:
        catalog.write_table(f"{dataset}_model", scores)
    return scores


def compare_datasets(matrices: Mapping[str, DataFrame], classifiers: Sequence[str] | Mapping[str, M.Classifier] = FIVE,
                     **settings) -> DataFrame:
    """Entry C over several datasets: the score tables of ``build_models``, one
    under the other, keyed by ``(dataset, classifier)`` (U-4, U-5, M-11)."""
    return reduce(DataFrame.unionByName, [build_models(m, name, classifiers, **settings) for name, m in matrices.items()])


def resting_regions(voxels: DataFrame, atlas: DataFrame, runs: DataFrame, catalog: Catalog, table: str) -> DataFrame:
    """Entry D: confound-cleaned region series written per subject and run.

    ``runs(scan_id, subject, run)`` names each scan.
    """
    cleaned = R.region_time_series(voxels, atlas, clean=True)
    out = cleaned.join(runs, "scan_id").select("subject", "run", "label", "t", "x")
    write_runs(catalog, table, out)
    return out
