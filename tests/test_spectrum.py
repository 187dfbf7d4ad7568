"""Full spectra by two grouped passes, against numpy."""

import numpy as np
import pytest

from sigframe.operators.features import spectrum as S

POINTS = "series_id long, channel string, t long, x double"


def _series(lengths):
    rng = np.random.default_rng(3)
    return {i: rng.normal(size=n) + np.sin(np.arange(n) / 3) for i, n in enumerate(lengths)}


def _frame(spark, data):
    return spark.createDataFrame([(i, "c", t, float(v)) for i, xs in data.items() for t, v in enumerate(xs)], POINTS)


def test_spectrum_of_composite_and_prime_lengths(spark):
    # 1009 is prime and 2 * 521 nearly so: both go by the chirp sum
    data = _series([1, 2, 3, 12, 97, 360, 1009, 1042])
    got = {}
    for r in S.spectrum(_frame(spark, data)).collect():
        got.setdefault(r["series_id"], {})[r["coeff"]] = r["abs"]
    for i, xs in data.items():
        want = np.abs(np.fft.rfft(xs))
        assert [got[i][k] for k in range(len(want))] == pytest.approx(want, abs=1e-8 * len(xs))
        assert len(got[i]) == len(want)


def test_moments_of_the_spectrum(spark):
    data = _series([1, 2, 40, 97, 360, 1009]) | {50: np.zeros(8), 51: np.ones(16)}
    got = {r["series_id"]: tuple(r)[2:] for r in S.fft_aggregated(_frame(spark, data)).collect()}
    for i, xs in data.items():
        a = np.abs(np.fft.rfft(xs))
        if i == 50:
            assert got[i] == (None, None, None, None)
            continue
        k = np.arange(len(a))
        m = [(a * k ** p).sum() / a.sum() for p in range(5)]
        var = m[2] - m[1] ** 2
        assert got[i][:2] == pytest.approx((m[1], var), abs=1e-6)
        if var >= 0.5:
            c = [(a * (k - m[1]) ** p).sum() / a.sum() for p in (3, 4)]
            assert got[i][2:] == pytest.approx((c[0] / var ** 1.5, c[1] / var ** 2), rel=1e-6, abs=1e-6)
        else:
            assert got[i][2:] == (None, None)


def test_empty_series(spark):
    assert S.fft_aggregated(_frame(spark, {})).collect() == []
