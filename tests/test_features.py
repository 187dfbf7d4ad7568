"""Feature families: multi-block invariance, edge cases, known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import sigframe.operators.ordering as O
from sigframe.functions.columns import round_doubles
from sigframe.operators.features.autocorr import autocorrelation, partial_autocorrelation
from sigframe.operators.features.changes import changes
from sigframe.operators.features.distribution import distribution
from sigframe.operators.features.location import location
from sigframe.operators.features.ordered import ordered
from sigframe.operators.features.quantiles import quantiles
from sigframe.operators.features.reoccurrence import reoccurrence
from sigframe.operators.features.spectral import fft_coefficients
from sigframe.operators.features.trend import change_quantiles, trend
from sigframe.operators.series import median_smooth, savgol_smooth

SCHEMA = "series_id long, channel string, t long, x double"


def _long_series(spark):
    data = []
    for sid, n in ((1, 300), (2, 40), (3, 7)):
        for t in range(n):
            data.append((sid, "x_0", t, float((t * 37) % 101 - 50) + 10 * math.sin(t / 5.0)))
    return spark.createDataFrame(data, SCHEMA)


def _frame(spark, values, sid=1):
    return spark.createDataFrame([(sid, "x_0", t, float(v)) for t, v in enumerate(values)], SCHEMA)


def _collect(df):
    return sorted(tuple(r) for r in round_doubles(df).collect())


@pytest.mark.parametrize("family", [changes, autocorrelation, ordered, trend, change_quantiles, partial_autocorrelation,
                                    lambda s: median_smooth(s, 3), lambda s: savgol_smooth(s, 5, 2)])
def test_multi_block_equals_single_block(spark, family, monkeypatch):
    s = _long_series(spark)
    whole = _collect(family(s))
    monkeypatch.setattr(O, "DEFAULT_BLOCK", 128)
    split = _collect(family(s))
    assert whole == split


def test_constant_and_short_series(spark):
    df = _frame(spark, [2, 2, 2, 2, 2]).unionByName(_frame(spark, [7], sid=2))
    d = {r["series_id"]: r for r in distribution(df).collect()}
    assert d[1]["variance"] == 0 and d[1]["skewness"] == 0 and d[1]["kurtosis"] == 0
    assert d[2]["skewness"] is None and d[2]["length"] == 1
    a = {r["series_id"]: r for r in autocorrelation(df).collect()}
    assert a[1]["autocorrelation__lag_1"] is None
    assert a[1]["agg_autocorrelation__f_agg_mean__maxlag_40"] == 0.0
    c = {r["series_id"]: r for r in changes(df).collect()}
    assert c[2]["mean_change"] is None and c[2]["absolute_sum_of_changes"] == 0.0


def test_linear_ramp_trend(spark):
    r = trend(_frame(spark, range(10))).collect()[0]
    assert r["linear_trend__attr_slope"] == pytest.approx(1.0)
    assert r["linear_trend__attr_rvalue"] == pytest.approx(1.0)
    assert r["linear_trend__attr_intercept"] == pytest.approx(0.0, abs=1e-12)


def test_fft_peak_and_parseval(spark):
    n, k0 = 32, 5
    xs = [math.cos(2 * math.pi * k0 * t / n) for t in range(n)]
    got = {r["coeff"]: r for r in fft_coefficients(_frame(spark, xs)).collect()}
    ref = np.fft.rfft(xs)
    for k in range(n // 2 + 1):
        assert got[k]["real"] == pytest.approx(ref[k].real, abs=1e-9)
        assert got[k]["imag"] == pytest.approx(ref[k].imag, abs=1e-9)
    assert max(got, key=lambda k: got[k]["abs"]) == k0


def test_quantiles_match_numpy(spark):
    xs = [5.0, 1.0, 9.0, 3.0, 3.0, 7.5, -2.0]
    r = quantiles(_frame(spark, xs)).collect()[0]
    assert r["median"] == pytest.approx(np.quantile(xs, 0.5))
    assert r["quantile__q_0p1"] == pytest.approx(np.quantile(xs, 0.1))
    assert r["quantile__q_0p7"] == pytest.approx(np.quantile(xs, 0.7))


def test_location_and_reoccurrence_known(spark):
    xs = [1, 3, 3, 0, 3, 1, -1]
    lo = location(_frame(spark, xs)).collect()[0]
    assert lo["first_location_of_maximum"] == pytest.approx(1 / 7)
    assert lo["last_location_of_maximum"] == pytest.approx(5 / 7)
    assert lo["count_above_mean"] == 3
    ro = reoccurrence(_frame(spark, xs)).collect()[0]
    assert ro["has_duplicate"] == 1.0 and ro["has_duplicate_min"] == 0.0 and ro["has_duplicate_max"] == 1.0
    assert ro["percentage_of_reoccurring_values_to_all_values"] == pytest.approx(2 / 4)
    assert ro["percentage_of_reoccurring_datapoints_to_all_datapoints"] == pytest.approx(5 / 7)
    assert ro["sum_of_reoccurring_data_points"] == pytest.approx(11.0)


def test_strikes_and_peaks(spark):
    xs = [0, 5, 6, 7, 0, 0, 9, 0, 1, 0]
    r = ordered(_frame(spark, xs)).collect()[0]
    assert r["longest_strike_above_mean"] == 3
    assert r["longest_strike_below_mean"] == 3
    assert r["number_peaks__n_1"] == 3


def _pacf_numpy(x, nlags):
    x = np.asarray(x, float)
    n, m = len(x), np.mean(x)
    acov = np.array([np.sum((x[k:] - m) * (x[:n - k] - m)) / (n - k) for k in range(nlags + 1)])
    rho = acov / acov[0]
    phi, out = [], [1.0]
    for k in range(1, nlags + 1):
        kk = (rho[k] - sum(phi[j] * rho[k - 1 - j] for j in range(k - 1))) / (
            1 - sum(phi[j] * rho[j + 1] for j in range(k - 1)))
        phi = [phi[j] - kk * phi[k - 2 - j] for j in range(k - 1)] + [kk]
        out.append(kk)
    return out


def test_pacf_matches_durbin_levinson(spark):
    xs = [float((t * 37) % 101 - 50) + 10 * math.sin(t / 5.0) for t in range(60)]
    r = partial_autocorrelation(_frame(spark, xs)).collect()[0]
    ref = _pacf_numpy(xs, 9)
    for k in range(10):
        assert r[f"partial_autocorrelation__lag_{k}"] == pytest.approx(ref[k], abs=1e-9)


def _welch_numpy(x, coeffs=(2, 5, 8)):
    x = np.asarray(x, float)
    n = len(x)
    L = min(n, 256)
    step = L - L // 2
    S = (n - L // 2) // step
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(L) / L)
    acc = np.zeros(L // 2 + 1)
    for s in range(S):
        seg = x[s * step: s * step + L]
        y = (seg - seg.mean()) * w
        p = np.abs(np.fft.rfft(y)) ** 2 / np.sum(w * w)
        if L % 2:
            p[1:] *= 2
        else:
            p[1:-1] *= 2
        acc += p
    acc /= S
    return [acc[c] if c < len(acc) else None for c in coeffs]


def test_welch_matches_numpy(spark):
    from sigframe.operators.features.spectral import welch_density

    for n in (600, 40, 11):
        xs = [float((t * 37) % 101 - 50) + 10 * math.sin(t / 5.0) for t in range(n)]
        r = welch_density(_frame(spark, xs)).collect()[0]
        ref = _welch_numpy(xs)
        for c, v in zip((2, 5, 8), ref):
            got = r[f"spkt_welch_density__coeff_{c}"]
            assert (got is None and v is None) or got == pytest.approx(v, rel=1e-9)


def test_partial_autocorrelation_divides_by_zero_as_ieee(spark):
    """a, b, a has rho_1 = -1: the recursion's divisor is 0, which ANSI mode raises on."""
    df = _frame(spark, [1, 4, 1]).unionByName(_frame(spark, [1, 2, 4, 3, 7, 5, 9, 8, 2, 6, 4, 1, 3], sid=2))
    got = {r["series_id"]: r for r in partial_autocorrelation(df).collect()}
    assert got[1]["partial_autocorrelation__lag_1"] == -1.0
    assert got[1]["partial_autocorrelation__lag_2"] == -math.inf
    assert math.isfinite(got[2]["ar_coefficient__coeff_10__k_10"])


def test_cwt_makes_one_group_a_width(spark):
    """Sums against the definition, with a null point and short series; no row a position before the sums."""
    from sigframe.operators.features.spectral import CWT_COEFFS, CWT_WIDTHS, cwt_coefficients

    rng = np.random.default_rng(3)
    points = {1: [float(v) for v in rng.normal(size=33)], 2: [3.0, -1.0], 3: [1.0, None, 2.0, 5.0]}
    df = spark.createDataFrame([(s, "x_0", t, v) for s, p in points.items() for t, v in enumerate(p)], SCHEMA)
    out = cwt_coefficients(df)
    want = {}
    for s, p in points.items():
        n = sum(v is not None for v in p)
        for w in CWT_WIDTHS:
            length = min(10 * w, n)
            for c in range(min(CWT_COEFFS, n)):
                cells = [(t, c + (length - 1) // 2 - t) for t in range(len(p))]
                on = [(p[t], m - (length - 1) / 2) for t, m in cells if 0 <= m < length]
                have = [x * 2 / (math.sqrt(3 * w) * math.pi ** 0.25) * (1 - v * v / w ** 2) * math.exp(-v * v / (2 * w * w))
                        for x, v in on if x is not None]
                if on:
                    want[(s, w, c)] = sum(have) if have else None
    got = {(r["series_id"], r["w"], r["coeff"]): r["value"] for r in out.collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-12) if v is not None else got[k] is None for k, v in want.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "coeff" in line.split("], [")[0] for line in plan.splitlines())


def test_impute_ranks_values_once(spark):
    """The fills are worked out when they are asked for; readers of the table do not rank its values again."""
    from sigframe.operators.features.impute import impute

    rows = [(i, "f", None if i == 4 else float(i)) for i in range(8)] + [(1, "g", float("inf")), (2, "g", None)]
    out = impute(spark.createDataFrame(rows, "series_id long, feature string, value double"))
    assert {r["value"] for r in out.where("feature = 'f' and series_id = 4").collect()} == {3.0}
    assert [r["value"] for r in out.where("feature = 'g'").collect()] == [0.0, 0.0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
