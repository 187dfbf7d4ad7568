"""Rank tests over real targets: brute force, slices of a few points, small scales, exact tails."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sigframe.operators import selection as V
from sigframe.operators.ordering import running
from sigframe.operators.rankcorr import kendall_s

FEATS = "series_id long, feature string, value double"


def _sign(a):
    return (a > 0) - (a < 0)


def _s(xy):
    return sum(_sign(a - c) * _sign(b - d) for (a, b), (c, d) in itertools.combinations(xy, 2))


def _sets():
    rnd = random.Random(5)
    n = 700
    return {
        "noise": [(rnd.random(), rnd.random()) for _ in range(n)],
        "tied": [(float(rnd.randint(0, 9)), float(rnd.randint(0, 5))) for _ in range(n)],
        "hot": [(1.0 if rnd.random() < 0.6 else rnd.random() * 2, rnd.random()) for _ in range(n)],
        "both hot": [(0.0 if rnd.random() < 0.5 else rnd.gauss(0, 1), 0.0 if rnd.random() < 0.5 else rnd.gauss(0, 1)) for _ in range(n)],
        "rising": [(float(i), float(i) ** 3) for i in range(n)],
        "one": [(1.0, 2.0)], "flat": [(3.0, float(i)) for i in range(50)],
    }


@pytest.mark.parametrize("slice_rows", [16, 100_000])
def test_kendall_s_over_slices_equals_pairs(spark, slice_rows):
    sets = _sets()
    pts = spark.createDataFrame([(f, x, y) for f, xy in sets.items() for x, y in xy] + [("one", None, 1.0), ("one", 1.0, None)],
                                "feature string, x double, y double")
    assert {r["feature"]: r["s"] for r in kendall_s(pts, slice_rows).collect()} == {f: _s(xy) for f, xy in sets.items()}
    assert kendall_s(pts.limit(0), slice_rows).collect() == []


def test_kendall_with_2000_distinct_targets(spark):
    rnd = random.Random(8)
    ys = [rnd.gauss(0, 1) for _ in range(2000)]
    xs = [round(y + rnd.gauss(0, 2), 1) for y in ys]
    feats = spark.createDataFrame([(i, "f", x) for i, x in enumerate(xs)], FEATS)
    tg = spark.createDataFrame(list(enumerate(ys)), "series_id long, target double")
    got = V.kendall(feats, tg, slice_rows=300).first()
    tx = sum(c * (c - 1) / 2 for c in (xs.count(v) for v in set(xs)))
    n0 = 2000 * 1999 / 2
    assert got["statistic"] == pytest.approx(_s(list(zip(xs, ys))) / math.sqrt((n0 - tx) * n0), abs=1e-12)


def test_values_are_compared_as_they_are(spark):
    rows = [(i, "tiny", i * 1e-10) for i in range(9)] + [(i, "offset", 1000 + i * 1e-7) for i in range(8)]
    kinds = {r["feature"]: (r["n_distinct"], r["kind"]) for r in V.feature_kinds(spark.createDataFrame(rows, FEATS)).collect()}
    assert kinds == {"tiny": (9, "real"), "offset": (8, "real")}
    tg = spark.createDataFrame([(i, i * 1e-12) for i in range(9)], "series_id long, target double")
    p = {r["feature"]: r["statistic"] for r in V.feature_pvalues(spark.createDataFrame(rows, FEATS), tg).collect()}
    assert p == pytest.approx({"tiny": 1.0, "offset": 1.0})


def test_selection_keeps_the_feature_that_predicts_a_real_target(spark):
    rnd = random.Random(2)
    ys = [rnd.random() for _ in range(300)]
    feats = spark.createDataFrame([(i, "good", y + rnd.random() / 5) for i, y in enumerate(ys)]
                                  + [(i, "bad", rnd.random()) for i in range(300)]
                                  + [(i, "step", float(y > 0.5)) for i, y in enumerate(ys)], FEATS)
    tg = spark.createDataFrame(list(enumerate(ys)), "series_id long, target double")
    rel = V.benjamini_yekutieli(V.feature_pvalues(feats, tg))
    kept = {r["feature"] for r in V.select_relevant(feats, rel).select("feature").distinct().collect()}
    assert kept == {"good", "step"}


def test_ks_of_a_real_target_equals_its_definition(spark):
    rnd = random.Random(4)
    pts = [(float(rnd.random() < 0.4), round(rnd.gauss(0, 1), 1)) for _ in range(150)]
    feats = spark.createDataFrame([(i, "f", x) for i, (x, _) in enumerate(pts)], FEATS)
    tg = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(pts)], "series_id long, target double")
    a, b = ([y for x, y in pts if x == v] for v in (0.0, 1.0))
    want = max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t in {y for _, y in pts})
    assert V.ks_binary(feats, tg).first()["statistic"] == pytest.approx(want, abs=1e-12)


def test_running_sums_over_many_blocks(spark):
    rows = [(f"k{i % 3}", i, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["s"] for r in running(df, ["k"], ["o"], {"s": "v"}, block=8).collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(v for k2, o2, v in rows if k2 == k and o2 <= o)


def test_fisher_equals_exact_fractions_on_every_small_table(spark):
    tables = [(a, b, c, n - a - b - c) for n in (1, 2, 5, 12, 30) for a in range(n + 1) for b in range(0, n + 1 - a, 1 if n < 13 else 4)
              for c in range(0, n + 1 - a - b, 1 if n < 13 else 3)]
    tables = [t for t in tables if (t[0] + t[1]) and (t[2] + t[3])]  # both feature values occur
    points, target = [], []
    cells = [(1.0, 1), (1.0, 0), (0.0, 1), (0.0, 0)]
    ids = itertools.count()
    for k, t in enumerate(tables):
        for (x, y), m in zip(cells, t, strict=True):
            for _ in range(m):
                i = next(ids)
                points.append((i, str(k), x))
                target.append((i, y))
    got = {r["feature"]: r["p_value"] for r in V.fisher(
        spark.createDataFrame(points, FEATS), spark.createDataFrame(target, "series_id long, target int")).collect()}
    for k, (a, b, c, d) in enumerate(tables):
        row, col, n = a + b, a + c, a + b + c + d
        p = {x: Fraction(math.comb(col, x) * math.comb(n - col, row - x), math.comb(n, row))
             for x in range(max(0, row + col - n), min(row, col) + 1)}
        assert got[str(k)] == pytest.approx(float(sum(q for q in p.values() if q <= p[a])), abs=1e-9)


def test_fisher_on_large_counts(spark):
    points = [(i, "f", float(i % 2)) for i in range(4000)]
    target = [(i, int((i % 2 and i % 3 == 0) or i % 5 == 0)) for i in range(4000)]
    r = V.fisher(spark.createDataFrame(points, FEATS), spark.createDataFrame(target, "series_id long, target int")).first()
    hi = [(x, y) for (_, _, x), (_, y) in zip(points, target)]
    a, b, c, d = (sum(1 for p in hi if p == q) for q in ((1.0, 1), (1.0, 0), (0.0, 1), (0.0, 0)))
    p = [Fraction(math.comb(a + c, x) * math.comb(b + d, a + b - x), math.comb(4000, a + b)) for x in range(max(0, a + b + a + c - 4000), min(a + b, a + c) + 1)]
    own = Fraction(math.comb(a + c, a) * math.comb(b + d, b), math.comb(4000, a + b))
    assert r["p_value"] == pytest.approx(float(sum(q for q in p if q <= own)), rel=1e-7)
    assert r["statistic"] == pytest.approx(a * d / (b * c)) and F is not None
