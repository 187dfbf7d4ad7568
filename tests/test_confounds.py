"""High-variance confounds against a numpy eigen-solve on a small grid."""

import numpy as np
import pytest

from sigframe.operators import confounds as C


def _grid(spark, seed=11, T=30, V=400):
    rng = np.random.default_rng(seed)
    t = np.arange(T)
    comps = np.stack([np.sin(t / 3.0), np.cos(t / 5.0), np.sign(np.sin(t / 2.0)), t % 4 - 1.5, np.cos(t)], axis=1)
    load = rng.normal(size=(5, V)) * np.array([[8], [6], [5], [4], [3]])
    data = comps @ load + rng.normal(scale=0.5, size=(T, V)) + 0.1 * t[:, None]
    rows = [(1, v, int(tt), float(data[tt, v])) for v in range(V) for tt in range(T)]
    return spark.createDataFrame(rows, "scan_id long, voxel long, t int, x double"), data


def _numpy_confounds(data, n=5, pct=2.0):
    T = data.shape[0]
    tt = np.arange(T, dtype=float)
    A = np.stack([np.ones(T), tt], axis=1)
    coef, *_ = np.linalg.lstsq(A, data, rcond=None)
    d = data - A @ coef
    var = (d ** 2).mean(axis=0)
    thr = np.quantile(var, 1 - pct / 100)
    s = d[:, var > thr]
    vals, vecs = np.linalg.eigh(s @ s.T / s.shape[0])
    return vecs[:, np.argsort(vals)[::-1][:n]]


def test_confound_subspace_matches_eigh(spark):
    df, data = _grid(spark)
    got = C.high_variance_confounds(df).collect()
    T = data.shape[0]
    U = np.zeros((T, 5))
    for r in got:
        U[r["t"], r["c"]] = r["u"]
    ref = _numpy_confounds(data)
    assert np.allclose(U.T @ U, np.eye(5), atol=1e-8)
    # same subspace: projection matrices agree
    assert np.allclose(U @ U.T, ref @ ref.T, atol=1e-6)


def test_project_out_removes_confounds(spark):
    df, data = _grid(spark)
    conf = C.high_variance_confounds(df)
    regions = df.withColumnRenamed("voxel", "label")
    res = C.project_out(regions.filter("label < 5"), conf).collect()
    U = {(r["t"], r["c"]): r["u"] for r in conf.collect()}
    for lab in range(5):
        xs = {r["t"]: r["x"] for r in res if r["label"] == lab}
        for c in range(5):
            assert abs(sum(xs[t] * U[(t, c)] for t in xs)) < 1e-8


@pytest.mark.parametrize("basis", [C.BASIS, 30])  # 30: with restarts
def test_confounds_of_a_flat_spectrum_converge(spark, basis):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(70, 150))  # noise alone: eigenvalues fall slowly
    rows = [(1, v, t, float(data[t, v])) for v in range(150) for t in range(70)]
    df = spark.createDataFrame(rows, "scan_id long, voxel long, t int, x double")
    u = np.zeros((70, 5))
    for r in C.high_variance_confounds(df, percentile=60.0, basis=basis).collect():
        u[r["t"], r["c"]] = r["u"]
    ref = _numpy_confounds(data, pct=60.0)
    assert np.allclose(u.T @ u, np.eye(5), atol=1e-8)
    assert np.allclose(u @ u.T, ref @ ref.T, atol=1e-6)
    with pytest.raises(RuntimeError, match="not converged"):
        C.high_variance_confounds(df, percentile=60.0, iterations=2)


def test_project_out_on_ragged_grids_equals_lstsq(spark):
    rng = np.random.default_rng(6)
    conf, rows, want = [], [], {}
    for scan in (1, 2):
        u = np.linalg.qr(rng.normal(size=(30, 3)))[0]
        conf += [(scan, t, c, float(u[t, c])) for t in range(30) for c in range(3)]
        present = {0: range(30), 1: range(0, 30, 2), 2: range(2), 3: [5], 4: sorted(rng.choice(30, 11, replace=False))}
        for label, ts in present.items():
            ts = [int(t) for t in ts]
            x = 10 + rng.normal(size=len(ts))
            rows += [(scan, label, t, float(v)) for t, v in zip(ts, x)]
            want |= {(scan, label, t): v for t, v in zip(ts, x - u[ts] @ np.linalg.lstsq(u[ts], x, rcond=1e-8)[0])}
    rows += [(1, 0, 99, 4.0), (3, 0, 0, 7.0)]  # a time and a scan without confounds
    want |= {(1, 0, 99): 4.0, (3, 0, 0): 7.0}
    regions = spark.createDataFrame(rows, "scan_id long, label int, t long, x double")
    confounds = spark.createDataFrame(conf, "scan_id long, t long, c int, u double")
    got = {(r["scan_id"], r["label"], r["t"]): r["x"] for r in C.project_out(regions, confounds).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    same = C.project_out(regions, confounds.limit(0)).collect()
    assert sorted(r["x"] for r in same) == sorted(r[3] for r in rows)
