"""Entry C: five classifiers fitted, compared over datasets, stored, loaded and applied."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sigframe.operators import boosting
from sigframe.operators import models as M
from sigframe.operators.knn import NearestNeighbours
from sigframe.plans import flows
from sigframe.sources.tables import Catalog, load_model

FEW = {"RandomForestClassifier": {"numTrees": 5, "maxDepth": 4}, "BoostedTreesA": {"rounds": 3}, "BoostedTreesB": {"rounds": 3}}


def _points(n=90, seed=1):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    return rng.normal(size=(n, 4)) + y[:, None], y


def _matrix(spark, seed=1):
    x, y = _points(seed=seed)
    return M.with_folds(spark.createDataFrame([(k, int(y[k]), [float(v) for v in x[k]]) for k in range(len(y))],
                                              "id long, target int, features array<double>"))


def _plain(x, y, q, k):
    out = []
    for row in q:
        near = sorted((float(((row - x[j]) ** 2).sum()), j) for j in range(len(x)))[:k]
        votes = {}
        for _, j in near:
            votes[y[j]] = votes.get(y[j], 0) + 1
        out.append(min(votes, key=lambda c: (-votes[c], c)))
    return out


def test_all_five_are_compared_stored_and_applied(spark, tmp_path):
    data = {"a": _matrix(spark), "b": _matrix(spark, 2)}
    cat = Catalog(spark, str(tmp_path / "db"))
    scores = flows.compare_datasets(data, catalog=cat, model_dir=str(tmp_path / "models"), last_fold=True, params=FEW)
    got = {(r["dataset"], r["classifier"]): r for r in scores.collect()}
    assert set(got) == {(d, c) for d in data for c in flows.FIVE}
    assert all(r["accuracy"] > 0.4 for r in got.values())
    assert cat.read_table("a_model").count() == cat.read_table("b_model").count() == 5
    for name in flows.FIVE:  # predictions equal those of a model fitted on the last fold's training rows here
        stored = load_model(f"{tmp_path}/models/a_{name}")
        assert isinstance(stored, (PipelineModel, boosting.Model))
        fresh = M.fit_pipeline(data["a"].where("fold <> 2"), name, **FEW.get(name, {}))
        assert sorted(M.predict(stored, data["a"]).collect()) == sorted(M.predict(fresh, data["a"]).collect())


def test_stored_neighbours_equal_a_plain_search(spark, tmp_path):
    x, y = _points()
    model = M.fit_pipeline(_matrix(spark), "KNeighborsClassifier", k=5, blockRows=16)
    model.write().overwrite().save(f"{tmp_path}/m")
    q = np.random.default_rng(7).normal(size=(40, 4)) + 1
    asked = spark.createDataFrame([(k, 0, [float(v) for v in q[k]]) for k in range(40)] * 2,
                                  "id long, target int, features array<double>")
    got = load_model(f"{tmp_path}/m").transform(M.to_ml(asked)).select("id", "prediction").collect()
    want = _plain(x, y, q, 5)
    assert len(got) == 80 and all(r["prediction"] == want[r["id"]] for r in got)


def test_neighbours_keep_rows_and_columns(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 1, [1.0, 1.0]), (None, 1, [0.0, 0.0]), (4, None, [0.0, 0.0]), (5, 1, None), (6, 1, [0.0, None])]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    model = NearestNeighbours(k=1).fit(df)
    assert model.rows.count() == 2
    asked = df.withColumn("_knn_row", F.lit("kept")).withColumn("grp", F.lit(3))
    out = model.transform(asked)
    assert out.columns == [*asked.columns, "prediction"]
    got = {r["id"]: r["prediction"] for r in out.where("id is not null").collect()}
    assert got == {1: 0.0, 2: 1.0, 4: 0.0, 5: None, 6: None} and out.where("_knn_row = 'kept' and grp = 3").count() == 6
    assert NearestNeighbours(k=1).fit(df.limit(0)).transform(df).where("prediction is not null").count() == 0


def test_a_factory_is_a_classifier(spark):
    matrix = _matrix(spark)
    by_value = M.cv_predictions(matrix, lambda seed: NearestNeighbours(k=7)).orderBy("id").collect()
    M.register_classifier("seven", lambda seed: NearestNeighbours(k=7))
    assert by_value == M.cv_predictions(matrix, "seven").orderBy("id").collect()
    assert by_value == M.knn_cv(matrix).orderBy("id").collect()


def test_folds_are_fitted_at_the_same_time(spark):
    """Each fit waits for the other two; one after the other they would break the barrier."""
    from threading import Barrier

    all_three = Barrier(3, timeout=30)

    class Waits(NearestNeighbours):
        def _fit(self, dataset):
            all_three.wait()
            return super()._fit(dataset)

    matrix = _matrix(spark)
    assert M.ml_cv(matrix, lambda seed: Waits(k=7)).orderBy("id").collect() == M.knn_cv(matrix).orderBy("id").collect()
