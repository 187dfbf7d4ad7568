"""Selection statistics against brute force; classifier and metric identities."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import metrics as A
from sigframe.operators import models as M
from sigframe.operators import selection as V


def _kendall_brute(xs, ys):
    cd = sum((1 if (a - c) * (b - d) > 0 else -1 if (a - c) * (b - d) < 0 else 0)
             for (a, b), (c, d) in itertools.combinations(zip(xs, ys), 2))
    n = len(xs)
    n0 = n * (n - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in (xs.count(v) for v in set(xs)))
    ty = sum(c * (c - 1) / 2 for c in (ys.count(v) for v in set(ys)))
    return cd / math.sqrt((n0 - tx) * (n0 - ty))


def test_kendall_matches_pairwise(spark):
    rnd = random.Random(7)
    xs = [rnd.choice([1.0, 2.0, 2.5, 3.0, 4.0, 4.0]) for _ in range(40)]
    ys = [float(rnd.randint(0, 3)) for _ in range(40)]
    feats = spark.createDataFrame([(i, "f", x) for i, x in enumerate(xs)], "series_id long, feature string, value double")
    tg = spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "series_id long, target double")
    got = V.kendall(feats, tg).collect()[0]
    assert got["statistic"] == pytest.approx(_kendall_brute(xs, ys), abs=1e-12)
    assert 0.0 <= got["p_value"] <= 1.0


def test_by_procedure(spark):
    pv = spark.createDataFrame([("a", 0.0001), ("b", 0.001), ("c", 0.2), ("d", 0.04)], "feature string, p_value double")
    rel = {r["feature"]: r["relevant"] for r in V.benjamini_yekutieli(pv).collect()}
    # thresholds 0.05 * k / (4 * (1 + 1/2 + 1/3 + 1/4)): 0.006, 0.012, 0.018, 0.024
    assert rel == {"a": True, "b": True, "d": False, "c": False}
    # the first misses 0.0167, but the second meets 0.0333: both are relevant
    pv = spark.createDataFrame([("a", 0.03), ("b", 0.03), ("n", None)], "feature string, p_value double").where("feature <> 'n'")
    assert {r["feature"]: r["relevant"] for r in V.benjamini_yekutieli(pv).collect()} == {"a": True, "b": True}


def test_fold_metrics_count_false_negatives_apart(spark):
    from sigframe.operators import metrics

    p = spark.createDataFrame([("d", "k", 0, 1, 1), ("d", "k", 0, 1, 2), ("d", "k", 0, 2, None), ("d", "k", 0, 3, 3)],
                              "dataset string, classifier string, fold int, y int, yhat int")
    r = metrics.fold_metrics(p).first()
    assert (r["accuracy"], r["precision"], r["recall"]) == pytest.approx((2 / 4, 2 / 3, 2 / 4))


def test_autocorrelation_on_a_large_offset(spark):
    from sigframe.operators.features.autocorr import autocorrelation
    from sigframe.operators.features.naming import column_name

    rnd = random.Random(9)
    xs = [1e8 + rnd.gauss(0, 1) for _ in range(400)]
    df = spark.createDataFrame([(1, "c", t, x) for t, x in enumerate(xs)], "series_id long, channel string, t long, x double")
    row = autocorrelation(df).first()
    m = math.fsum(xs) / len(xs)
    v = math.fsum((x - m) ** 2 for x in xs) / len(xs)
    for k in (1, 5):
        want = math.fsum((a - m) * (b - m) for a, b in zip(xs, xs[k:], strict=False)) / ((len(xs) - k) * v)
        assert row[column_name("autocorrelation", lag=k)] == pytest.approx(want, abs=1e-6)


def test_kinds(spark):
    f = spark.createDataFrame([(1, "c", 1.0), (2, "c", 1.0), (1, "b", 0.0), (2, "b", 1.0), (1, "r", 0.5),
                               (2, "r", 0.7), (3, "r", 0.9)], "series_id long, feature string, value double")
    assert {r["feature"]: r["kind"] for r in V.feature_kinds(f).collect()} == {"c": "constant", "b": "binary",
                                                                               "r": "real"}


def _points(spark, n=60, seed=3):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        c = i % 3
        data.append((i, c, [c * 2.0 + rnd.gauss(0, 0.4), -c + rnd.gauss(0, 0.4)]))
    data.append((n, 1, [2.0, -1.0]))  # an exact duplicate location with a different id
    data.append((n + 1, 2, [2.0, -1.0]))
    return M.with_folds(spark.createDataFrame(data, "id long, target int, features array<double>"))


def test_knn_exact_against_brute_force(spark):
    df = _points(spark)
    got = {r["id"]: r["yhat"] for r in M.knn_cv(df, k=7, block_rows=9).collect()}
    assert got == {r["id"]: r["yhat"] for r in M.knn_cv(df, k=7).collect()}
    rows = [(r["id"], r["target"], r["fold"], r["features"]) for r in df.collect()]
    for qid, _, qf, qx in rows:
        cands = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(qx, tx))), tid, ty) for tid, ty, tf, tx in rows if tf != qf)[:7]
        votes = {}
        for _, _, ty in cands:
            votes[ty] = votes.get(ty, 0) + 1
        best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        assert got[qid] == best


def test_gnb_separable_and_metric_identity(spark):
    pred = M.gaussian_nb_cv(_points(spark)).select(F.lit("d").alias("dataset"), F.lit("nb").alias("classifier"), "*")
    s = A.cv_scores(pred).collect()[0]
    assert s["accuracy"] > 0.9
    assert s["accuracy"] == pytest.approx(s["precision"]) == pytest.approx(s["recall"]) == pytest.approx(s["f1"])
    assert A.log_loss(pred).collect()[0]["log_loss"] >= 0


def test_folds_disjoint_and_complete(spark):
    df = _points(spark)
    folds = {r["id"]: r["fold"] for r in df.collect()}
    assert set(folds.values()) <= {0, 1, 2} and len(folds) == df.count()
    again = {r["id"]: r["fold"] for r in M.with_folds(df.drop("fold")).collect()}
    assert again == folds


def test_confusion_and_class_metrics(spark):
    pred = spark.createDataFrame([("d", "m", 0, 1, 0, 0), ("d", "m", 0, 2, 1, 0), ("d", "m", 0, 3, 2, 2),
                                  ("d", "m", 0, 4, 2, 2)], "dataset string, classifier string, fold int, id long, y int, yhat int")
    cm = {(r["y"], r["yhat"]): r["n"] for r in A.confusion(pred).collect()}
    assert cm == {(0, 0): 1, (1, 0): 1, (2, 2): 2}
    per = {r["c"]: r for r in A.class_metrics(pred).collect()}
    assert per[1]["recall"] == 0.0 and per[0]["precision"] == pytest.approx(0.5)


def test_ml_cv_beats_majority_and_is_repeatable(spark):
    df = _points(spark)
    a = M.ml_cv(df, "RandomForestClassifier", numTrees=10, maxDepth=5)
    b = M.ml_cv(df, "RandomForestClassifier", numTrees=10, maxDepth=5)
    ra = sorted(tuple(r) for r in a.collect())
    assert ra == sorted(tuple(r) for r in b.collect())
    acc = sum(r[2] == r[3] for r in ra) / len(ra)
    assert acc > 0.5  # three balanced classes: majority baseline is about 1/3
    nb = M.ml_cv(df, "GaussianNB")
    assert nb.count() == df.count()


def test_nearest_ranks_ties_by_id_and_survives_few_rows(spark):
    from sigframe.operators.neighbours import nearest

    schema = "id long, y int, grp int, features array<double>"
    rows = [(i, i % 2, None if i == 9 else i % 3, [float(i // 3), 1e8]) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    for block_rows in (2, 100):
        got = {}
        for r in nearest(df, df, 4, block_rows).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["dist"], r["tid"]))
        for i, _, g, x in rows:
            cands = sorted((abs(x[0] - t[0]), j) for j, _, h, t in rows if h != g)[:4]
            assert sorted(got[i]) == [(n + 1, d, j) for n, (d, j) in enumerate(cands)]
    assert len(nearest(df, df.limit(1), 4).collect()) == 12 - sum(1 for r in rows if r[2] == 0)
    assert nearest(df, df.limit(0), 4).collect() == [] and nearest(df.limit(0), df, 4).collect() == []


def test_nearest_holds_one_tile_at_a_time(spark):
    """150 rows in blocks of 2 are tiles of 4 blocks; pairs of blocks never stand in rows of one batch."""
    from sigframe.operators.neighbours import nearest

    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (150, 3)).astype(float)
    rows = [(i, i % 4, i % 3 if i % 10 else None, [float(v) for v in x[i]]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y long, grp long, features array<double>")
    found = nearest(df, df, 5, 2)
    want = set()
    for i, _, g, _ in rows:
        other = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(150) if rows[j][2] != g)[:5]
        want |= {(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(other)}
    assert {(r["id"], r["rank"], r["tid"], round(r["dist"], 9)) for r in found.collect()} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "MapInPandas" not in plan


def test_nearest_passes_over_blocks_that_are_too_far(spark):
    """Points along a line and one far away: a block meets its neighbours, and what it leaves out does not matter."""
    from sigframe.operators import neighbours as N

    rng = np.random.default_rng(8)
    x = np.concatenate([np.sort(rng.uniform(0, 1000, 799)), [1e6]])
    x[100:140] = x[100]
    rows = [(i, i % 2, i % 3, [float(v), float(np.sin(v))]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y long, grp long, features array<double>")
    base = df.select("id", "y", "grp", "features")
    own, n = N._packed(base, N._cells(base, 800, 32), 32)
    asked = own.select(*[F.col(c).alias(c) for c in own.columns])
    visits = N._visits(asked, own, 3).select(F.size("visit").alias("n")).collect()
    assert len(visits) == n >= 25 and sum(r["n"] for r in visits) < n * n / 3
    pts = np.array([r[3] for r in rows])
    got = {}
    for r in N.nearest(df, df, 3, 32).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["tid"]))
    for i in range(800):
        d = np.sqrt(((pts[i] - pts) ** 2).sum(axis=1))
        want = sorted((d[j], j) for j in range(800) if j % 3 != i % 3)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
