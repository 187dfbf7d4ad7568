"""Hand-made frames for series, regions and matrix preparation (FIXTURES §3)."""

import math

import pytest
from pyspark.sql import functions as F

from sigframe.operators import matrix as X
from sigframe.operators import regions as R
from sigframe.operators import series as S

NAN = float("nan")


def test_equalise_uses_non_null_count(spark):
    rows = []
    for sid, vals in ((1, [1, 2, 3, 4, 5]), (2, [1, NAN, 3]), (3, [1, 2, 3, 4])):
        for t, v in enumerate(vals):
            rows.append((sid, sid, 0, "x_0", t, float(v)))
            rows.append((sid, sid, 0, "x_1", t, float(t)))
    df = spark.createDataFrame(rows, "series_id long, subject long, target int, channel string, t long, x double")
    assert S.min_length(df).collect()[0]["min_length"] == 2
    eq = S.equalise(df)
    lens = {(r["series_id"], r["channel"]): r["count"] for r in eq.groupBy("series_id", "channel").count().collect()}
    assert set(lens.values()) == {2} and len(lens) == 6


def test_region_mean_drops_background(spark):
    # 2 x 2 x 1 grid as four voxels, labels {0, 1, 2}, three time points
    atlas = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "voxel long, label int")
    vox = spark.createDataFrame([(7, v, t, float(10 * v + t)) for v in range(4) for t in range(3)],
                                "scan_id long, voxel long, t int, x double")
    got = {(r["label"], r["t"]): r["x"] for r in R.region_series(vox, atlas).collect()}
    assert 0 not in {k[0] for k in got}
    assert got[(1, 0)] == pytest.approx(15.0) and got[(2, 2)] == pytest.approx(32.0)


def test_confound_removal_leaves_orthogonal_residual(spark):
    rows = [(1, lab, t, float(lab * t + (t % 3))) for lab in (1, 2, 3) for t in range(12)]
    reg = spark.createDataFrame(rows, "scan_id long, label int, t int, x double")
    out = R.remove_confounds(reg)
    g = R.global_signal(reg)
    j = out.join(g, ["scan_id", "t"]).groupBy("label").agg(F.sum("x").alias("s"), F.covar_pop("x", "g").alias("c"))
    for r in j.collect():
        assert abs(r["s"]) < 1e-9 and abs(r["c"]) < 1e-9


def test_standardise_regions(spark):
    reg = spark.createDataFrame([(1, 1, t, float(t)) for t in range(5)] + [(1, 2, t, 3.0) for t in range(5)],
                                "scan_id long, label int, t int, x double")
    z = {(r["label"], r["t"]): r["x"] for r in R.standardise_regions(reg).collect()}
    assert z[(2, 3)] == 0.0 and z[(1, 2)] == pytest.approx(0.0) and z[(1, 4)] == pytest.approx(math.sqrt(2))


def test_name_collisions_keep_first_and_fill(spark):
    feats = spark.createDataFrame([
        (1, 'a__m_-1', 1.0), (1, 'a__m_1', 2.0), (1, 'a__q_"x"', NAN), (1, "b", float("inf")),
        (2, 'a__m_-1', None), (2, 'a__m_1', 4.0), (2, 'a__q_"x"', 5.0), (2, "b", -1.5)],
        "series_id long, feature string, value double")
    nm = {r["feature"]: (r["clean_feature"], r["kept"]) for r in X.name_map(feats).collect()}
    assert nm["a__m_-1"] == ("a__m_1", True) and nm["a__m_1"] == ("a__m_1", False)
    assert nm['a__q_"x"'] == ("a__q_x", True)
    clean = {(r["series_id"], r["feature"]): r["value"] for r in X.clean_features(feats).collect()}
    assert clean[(1, "a__m_1")] == 1.0 and clean[(2, "a__m_1")] == -1.0
    assert clean[(1, "a__q_x")] == -1.0 and clean[(1, "b")] == float("inf")
    vec = {r["series_id"]: r["features"] for r in X.assemble(X.clean_features(feats)).collect()}
    assert vec[1] == [1.0, -1.0, float("inf")] and vec[2] == [-1.0, 5.0, -1.5]


def test_number_series_and_wide(spark):
    keys = spark.createDataFrame([(5, 1), (3, 2), (5, 0), (3, 2)], "subject long, target int")
    got = sorted(tuple(r) for r in S.number_series(keys).collect())
    assert got == [(3, 2, 0), (5, 0, 1), (5, 1, 2)]


def test_connectivity_multi_block_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(40, 4))
    data[:, 1] += 0.8 * data[:, 0]
    rows = [(1, lab, t, float(data[t, lab])) for t in range(40) for lab in range(4) if not (lab == 3 and t % 7 == 0)]
    reg = spark.createDataFrame(rows, "scan_id long, label int, t int, x double")
    got = {(r["label_a"], r["label_b"]): r for r in R.connectivity(reg, block=8).collect()}
    ref = np.corrcoef(data[:, :3].T)
    assert got[(0, 1)]["corr"] == pytest.approx(ref[0, 1], abs=1e-12)
    assert got[(1, 2)]["n"] == 40
    common = [t for t in range(40) if t % 7 != 0]
    assert got[(0, 3)]["n"] == len(common)
    assert got[(0, 3)]["corr"] == pytest.approx(np.corrcoef(data[common, 0], data[common, 3])[0, 1], abs=1e-12)
