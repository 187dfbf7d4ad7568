"""Softmax boosting against a small numpy version over raw values, and its edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import boosting as B

ROWS = "id long, target int, features array<double>"


def _data(n=240, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.column_stack([y + rng.normal(0, 0.7, n), rng.integers(0, 4, n), rng.normal(size=n) - (y == 2)])
    return [(i, int(y[i]) * 5, [float(v) for v in x[i]]) for i in range(n)]


def _plain(rows, s):
    """Exact greedy trees on raw values: all midpoints tried, one class at a time; returns scores."""
    x = np.array([r[2] for r in rows])
    classes = sorted({r[1] for r in rows})
    y = np.array([classes.index(r[1]) for r in rows])
    f = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    for _ in range(s.rounds):
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        step = np.zeros_like(f)
        for c in range(len(classes)):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def node(at, depth, c=c, g=g, h=h):
                tried = []
                if depth < s.depth:
                    for j in range(x.shape[1]):
                        for cut in np.unique(x[at, j])[:-1]:
                            left, right = at[x[at, j] <= cut], at[x[at, j] > cut]
                            if min(h[left].sum(), h[right].sum()) < s.min_child_weight:
                                continue
                            q = lambda i: g[i].sum() ** 2 / (h[i].sum() + s.l2)
                            tried.append((q(left) + q(right) - q(at), (left, right)))
                top = max((t[0] for t in tried), default=0)
                best = next((t for t in tried if t[0] >= top - B.TIE * max(1.0, top)), None) if top > 1e-9 else None
                if best is None:
                    step[at, c] = -s.rate * g[at].sum() / (h[at].sum() + s.l2)
                else:
                    for part in best[1]:
                        node(part, depth + 1)

            node(np.arange(len(y)), 0)
        f += step
    return f


def test_scores_equal_plain_exact_boosting(spark):
    rows = _data(60)
    s = B.Settings(rounds=5, rate=0.3, depth=2, l2=0.5, min_child_weight=1.0, bins=256, checkpoint_every=2)
    model = B.fit(spark.createDataFrame(rows, ROWS).repartition(3), s)
    got = model.scores(np.array([r[2] for r in rows]))
    assert got == pytest.approx(_plain(rows, s), abs=1e-9)


def test_leaves_are_regularised_and_children_weigh_enough(spark):
    df = spark.createDataFrame(_data(), ROWS)
    heavy = B.fit(df, B.Settings(rounds=1, rate=1.0, depth=3, l2=1e6))
    assert max(np.abs(t.value).max() for t in heavy.trees[0]) < 1e-3
    stump = B.fit(df, B.Settings(rounds=1, rate=1.0, depth=3, min_child_weight=1e6))
    assert all((t.feature == -1).all() for t in stump.trees[0])


def test_predictions_learn_and_survive_json_and_edges(spark):
    rows = _data()
    df = spark.createDataFrame([*rows, (900, None, [1.0, 1.0, 1.0]), (901, 5, None), (902, 0, [None, float("nan"), -1.0])], ROWS)
    model = B.fit(df, B.Settings(rounds=6, rate=0.3, depth=3))
    again = B.Model.from_json(model.to_json())
    out = {r["id"]: r["prediction"] for r in B.predict(again, df).collect()}
    assert out == {r["id"]: r["prediction"] for r in B.predict(model, df).collect()}
    assert out[901] is None and out[902] in (0, 5, 10) and len(out) == len(rows) + 3
    assert sum(out[i] == y for i, y, _ in rows) > 0.8 * len(rows)
    one = B.fit(df.where("target = 5"), B.Settings(rounds=2, rate=0.1))
    assert {r[0] for r in B.predict(one, df.where(F.col("features").isNotNull())).select("prediction").collect()} == {5}
    with pytest.raises(ValueError, match="no rows"):
        B.fit(df.limit(0), B.PRESET_B)


def test_models_of_all_folds_equal_one_fit_per_fold(spark):
    rows = [(*r, r[0] % 3) for r in _data(90)]
    df = spark.createDataFrame(rows, ROWS + ", fold int")
    s = B.Settings(rounds=3, rate=0.3, depth=2, bins=256)
    x = np.array([r[2] for r in rows])
    for m, model in enumerate(B.fit_folds(df, s, 3)):
        alone = _plain([r for r in rows if r[3] != m], s)
        assert model.scores(x[[r[3] != m for r in rows]]) == pytest.approx(alone, abs=1e-9)


def test_stored_models_predict_the_same(spark, tmp_path):
    from sigframe.operators import models as M
    from sigframe.sources.tables import load_model, save_model

    df = M.with_folds(spark.createDataFrame(_data(60), ROWS))
    model = M.fit_pipeline(df, "BoostedTreesB", rounds=3)
    save_model(model, str(tmp_path / "trees"))
    want = sorted(tuple(r) for r in M.predict(model, df).collect())
    assert sorted(tuple(r) for r in M.predict(load_model(str(tmp_path / "trees")), df).collect()) == want
    cv = M.ml_cv(M.with_folds(spark.createDataFrame(_data(300), ROWS)), "BoostedTreesA", rounds=4).collect()
    assert len(cv) == 300 and sum(r["y"] == r["yhat"] for r in cv) > 200


def test_the_driver_gets_splits_and_no_histogram(spark, monkeypatch):
    import pickle

    sizes, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda *a: sizes.append(level(*a)) or sizes[-1])
    rows = [(*r, r[0] % 3) for r in _data(240)]
    B.fit_folds(spark.createDataFrame(rows, ROWS + ", fold int").repartition(4), B.Settings(rounds=2, rate=0.3, depth=3, bins=64), 3)
    # a histogram of this run's last level has 2 * 9 * 4 * 3 * 64 doubles
    assert len(sizes) == 6 and max(len(pickle.dumps(f)) for f in sizes) < 16384
