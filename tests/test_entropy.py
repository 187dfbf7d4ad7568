"""Template matches by range counting, against all pairs."""

import time

import numpy as np
import pytest

from sigframe.operators.features import entropy as E
from sigframe.operators.features.naming import column_name

POINTS = "series_id long, channel string, t long, x double"


def _near(x, m, r):
    t = np.array([x[i:i + m] for i in range(len(x) - m + 1)]).reshape(-1, m)
    return (np.abs(t[:, None] - t[None]).max(axis=2) <= r).sum(axis=1)


def _approximate(x, r):
    if len(x) <= 3:
        return 0.0
    phi = [np.log(c / len(c)).mean() for c in (_near(x, m, r * np.std(x)) for m in (2, 3))]
    return abs(phi[0] - phi[1])


def _sample(x):
    b, a = ((c.sum() - len(c)) if len(c) else 0 for c in (_near(x, m, 0.2 * np.std(x)) if len(x) >= m else np.zeros(0) for m in (2, 3)))
    return -np.log(a / b) if a > 0 and b > 0 else None


@pytest.mark.parametrize("m", [2, 3])
def test_matches_equal_all_pairs(m):
    rng = np.random.default_rng(m)
    for n, q in ((1, 3), (2, 2), (37, 50), (300, 260)):
        for draw in (lambda k: rng.normal(size=(k, m)), lambda k: rng.integers(0, 5, (k, m)).astype(float),
                     lambda k: np.round(rng.normal(size=(k, m)), 1)):
            pts, ask = draw(n), draw(q)
            for r in (0.0, 0.1, 0.3, 1.0, 100.0):
                want = (np.abs(pts[None] - ask[:, None]).max(axis=2) <= r).sum(axis=1)
                assert (E.matches(pts, ask, r) == want).all()
    assert (E.matches(np.zeros((0, m)), np.zeros((3, m)), 1.0) == 0).all()


def test_matches_grow_nearly_linearly():
    rng = np.random.default_rng(0)
    took = []
    for n in (4000, 16000):
        x = rng.normal(size=(n, 3))
        t = time.perf_counter()
        E.matches(x, x, 0.5)
        took.append(time.perf_counter() - t)
    assert took[1] < 9 * took[0]  # all pairs would be 16 times


@pytest.mark.parametrize("block_rows", [7, 1 << 14])
def test_entropies_equal_their_definitions(spark, block_rows):
    rng = np.random.default_rng(4)
    data = {1: rng.normal(size=60), 2: np.sin(np.arange(45) / 2), 3: rng.integers(0, 3, 50).astype(float), 4: np.ones(9),
            5: np.array([1.0]), 6: np.array([1.0, 2.0]), 7: np.array([1.0, 2.0, 1.5]), 8: np.array([3.0, 1.0, 3.0, 1.0])}
    df = spark.createDataFrame([(i, "c", t, float(v)) for i, x in data.items() for t, v in enumerate(x)], POINTS)
    got = {r["series_id"]: r for r in E.entropy(df, block_rows).collect()}
    assert set(got) == set(data)
    for i, x in data.items():
        for r in E.APPROXIMATE_R:
            assert got[i][column_name("approximate_entropy", m=2, r=r)] == pytest.approx(_approximate(x, r), abs=1e-9)
        assert got[i]["sample_entropy"] == (None if _sample(x) is None else pytest.approx(_sample(x), abs=1e-9))


def test_no_series(spark):
    assert E.entropy(spark.createDataFrame([], POINTS)).collect() == []


def _series():
    rng = np.random.default_rng(6)
    data = {i: np.round(rng.normal(size=n), 1).tolist() for i, n in enumerate((1, 2, 3, 4, 5, 5, 5, 19, 20, 21, 40, 64, 65))}
    data[20] = [1.0, None, 2.0, 3.0, 2.5, 1.0, 2.0, None]
    data[21] = [None, None, None, None]
    data[22] = [1.0, 2.0, float("nan"), 2.0, 1.0, 2.0]
    return data


@pytest.mark.parametrize("short", [4, 20])
def test_short_series_go_together_and_give_what_blocks_give(spark, monkeypatch, short):
    data = _series()
    df = spark.createDataFrame([(i, "c", t, v) for i, x in data.items() for t, v in enumerate(x)], POINTS)
    monkeypatch.setattr(E, "SHORT", 1 << 9)
    together = {r["series_id"]: r for r in E.entropy(df).collect()}
    monkeypatch.setattr(E, "SHORT", short)
    parts = {r["series_id"]: r for r in E.entropy(df).collect()}
    assert set(together) == set(parts) == set(data)
    for i in data:
        for a, b in zip(together[i], parts[i], strict=True):
            assert a == b or (a is not None and b is not None and a == pytest.approx(b, abs=1e-12)), (i, together[i], parts[i])


def test_short_series_are_not_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "template_counts", lambda *a: pytest.fail("short series in blocks"))
    df = spark.createDataFrame([(i, "c", t, float(t * t % 7)) for i in range(200) for t in range(i % 9 + 1)], POINTS)
    assert E.entropy(df).count() == 200
