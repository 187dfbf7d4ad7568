"""The forest against plain recursive trees with the same draws, and its edges."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from sigframe.operators import forest as T
from sigframe.operators import models as M
from sigframe.operators.forest import Forest, ForestModel
from sigframe.sources.tables import load_model, save_model

ROWS = "id long, label int, features array<double>"


def _data(n=150, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.column_stack([y + rng.normal(0, 1.5, n), rng.integers(0, 4, n), rng.normal(size=n), rng.normal(size=n)])
    return [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]


def _plain(model, keys, rows):
    """Sums of class shares by trees grown one node at a time."""
    s, y = model.settings, np.array([r[1] for r in rows])
    bins = T.binned(model.cuts, np.array([r[2] for r in rows])).astype(int)
    out = np.zeros((len(rows), s.classes))

    def gini(at, w):
        c = np.bincount(y[at], w[at], s.classes)
        return w[at].sum() - (c ** 2).sum() / w[at].sum()

    def node(at, asked, w, tree, path, depth):
        """The leaves below: (rows asked that end there, class weights)."""
        own = [(asked, np.bincount(y[at], w[at], s.classes))]
        tried = []
        if depth < s.depth and len(np.unique(y[at])) > 1:
            for j in s.features(tree, np.array([path]))[0]:
                for cut in np.unique(bins[at, j])[:-1]:
                    left = bins[at, j] <= cut
                    tried.append((gini(at, w) - gini(at[left], w) - gini(at[~left], w), j, cut))
        top = max((t[0] for t in tried), default=0)
        if top <= 1e-9:
            return own
        _, j, cut = next(t for t in tried if t[0] >= top - 1e-9)
        parts = []
        for k, side in enumerate((lambda a: bins[a, j] <= cut, lambda a: bins[a, j] > cut)):
            parts.append(node(at[side(at)], asked[side(asked)], w, tree, 2 * path + 1 + k, depth + 1))
        if len(parts[0]) == len(parts[1]) == 1 and parts[0][0][1].argmax() == parts[1][0][1].argmax():
            return own
        return parts[0] + parts[1]

    for tree in range(int(model.top.tree.max()) + 1):
        w = s.weights(keys, tree).astype(float)
        for asked, counts in node(np.flatnonzero(w > 0), np.arange(len(rows)), w, tree, 0, 0):
            out[asked] += counts / counts.sum()
    return out


def _raw(model, df):
    return {r["id"]: r["rawPrediction"].toArray() for r in model.transform(df).collect()}


@pytest.mark.parametrize("settings", [{"maxDepth": 12, "maxBins": 16}, {"maxDepth": 3, "maxBins": 32, "featureSubsetStrategy": "all"}])
def test_trees_equal_plain_ones(spark, settings):
    rows = _data()
    df = spark.createDataFrame(rows, ROWS)
    model = Forest(numTrees=5, seed=3, taskRows=40, **settings).fit(df)
    keys = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id", F.col("label").cast("double"), "features").alias("k")).collect()}
    want = _plain(model, np.array([keys[r[0]] for r in rows], np.int64).view(np.uint64), rows)
    got = _raw(model, df)
    assert np.array([got[r[0]] for r in rows]) == pytest.approx(want, abs=1e-9)
    assert (model.top.branch >= 0).sum() > 5  # some nodes were split over blocks, others grown in tasks


def test_trees_do_not_depend_on_task_rows_or_partitions(spark):
    df = spark.createDataFrame(_data(400), ROWS)
    settings = dict(numTrees=6, maxDepth=20, featureSubsetStrategy="log2")
    a = Forest(taskRows=10, **settings).fit(df.repartition(7))
    b = Forest(taskRows=10 ** 6, **settings).fit(df.coalesce(1))
    assert len(b.top.tree) == 6 < len(a.top.tree)
    one, two = _raw(a, df), _raw(b, df.repartition(5))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-9) for k in one)


def _jobs(spark, run):
    sc = spark.sparkContext
    group = f"forest-{np.random.default_rng().integers(1 << 60)}"
    sc.setJobGroup(group, "count jobs")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_deep_trees_take_no_more_passes(spark):
    """nodes with a few rows each must not be split in a job a level or group."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(rng.integers(10)), [float(v) for v in rng.normal(size=8)]) for i in range(300)],
                               "id long, target int, features array<double>").cache()
    shallow = _jobs(spark, lambda: M.fit_pipeline(df, "RandomForestClassifier", maxDepth=2))
    deep = _jobs(spark, lambda: M.fit_pipeline(df, "RandomForestClassifier"))
    assert deep <= shallow


def test_preset_keeps_all_trees_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(rng.integers(4)), [float(v) for v in rng.normal(size=8)]) for i in range(120)],
                               "id long, target int, features array<double>")
    model = M.fit_pipeline(df, "RandomForestClassifier")
    stage = model.stages[0]
    assert isinstance(stage, ForestModel) and stage.branches.count() == 240 and stage.settings.depth == 30 and stage.settings.subset == 3
    save_model(model, str(tmp_path / "m"))
    a, b = (m.transform(M.to_ml(df)).select("id", "probability", "prediction").orderBy("id").collect()
            for m in (model, load_model(str(tmp_path / "m"))))
    assert a == b
    raw = model.transform(M.to_ml(df)).select("rawPrediction").collect()
    assert all(r[0].toArray().sum() == pytest.approx(240) for r in raw)


def test_more_rows_than_the_branches_grew_on(spark, monkeypatch):
    df = spark.createDataFrame(_data(300), ROWS)
    model = Forest(numTrees=4, maxDepth=20, taskRows=20).fit(df.where("id < 90"))
    want = _raw(model, df.repartition(2))
    monkeypatch.setattr(T, "DEALT_ROWS", 10)  # branches are copied to several tasks
    monkeypatch.setattr(T, "MANY_ROWS", 50)
    got = _raw(model, df)
    assert len(got) == 300 and all((got[k] == want[k]).all() for k in want)


@pytest.mark.parametrize(("dims", "most"), [(1, 2), (5, 32), (64, 32), (3, 256), (7, 17)])
def test_bins_are_sent_whole(dims, most):
    bins = np.random.default_rng(1).integers(0, most, (5000, dims)).astype(np.uint8)
    sent = T.squeezed(bins, most)
    assert sent.shape[1] == -(-dims * (most - 1).bit_length() // 8) and (T.spread(sent, dims, most) == bins).all()


def test_edges(spark):
    same = spark.createDataFrame([(None, 1, [1.0, 2.0])] * 30 + [(2, 0, [1.0, 2.0])] * 9, ROWS)  # no feature tells them apart
    out = Forest(numTrees=40, taskRows=8).fit(same).transform(same.withColumn("_forest_row", F.lit("kept")))
    assert out.columns == ["id", "label", "features", "_forest_row", "rawPrediction", "probability", "prediction"]
    assert out.where("_forest_row = 'kept'").count() == 39 and {r[0] for r in out.select("prediction").collect()} <= {0.0, 1.0}
    one = spark.createDataFrame([(1, 2, [0.0])], ROWS)
    assert Forest(numTrees=30).fit(one).transform(one).first()["prediction"] == 2
    assert Forest(numTrees=3, maxDepth=0, taskRows=5).fit(spark.createDataFrame(_data(60), ROWS)).branches.count() == 0
    for bad in ((1, None, [0.0]), (1, -1, [0.0]), (1, 1, None), (1, 1, [float("nan")]), (1, 1, [None]), (1, 1, [0.0, 1.0]), (1, 100, [0.0])):
        with pytest.raises(ValueError):
            Forest().fit(spark.createDataFrame([(0, 0, [0.0]), bad], ROWS))
    with pytest.raises(ValueError):
        Forest().fit(one.limit(0))


def test_close_to_spark_ml_on_rows_not_seen(spark):
    rows = _data(1200, 5)
    train, test = spark.createDataFrame(rows[:800], ROWS), spark.createDataFrame(rows[800:], ROWS)
    own = Forest(numTrees=40, maxDepth=8).fit(train).transform(test)
    ml = RandomForestClassifier(numTrees=40, maxDepth=8, seed=42, featuresCol="vec").fit(
        M.to_ml(train.withColumnRenamed("label", "target"))).transform(M.to_ml(test.withColumnRenamed("label", "target")))
    a, b = (d.where("prediction = label").count() / 400 for d in (own, ml))
    assert abs(a - b) < 0.05


def test_settings_that_the_forest_lacks_go_to_spark_ml(spark):
    assert isinstance(M.ml_estimator("RandomForestClassifier", maxBins=16), Forest)
    for lacks in ({"impurity": "entropy"}, {"minInstancesPerNode": 5}, {"maxBins": 300}):
        assert isinstance(M.ml_estimator("RandomForestClassifier", **lacks), RandomForestClassifier)
