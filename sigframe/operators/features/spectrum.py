"""F-33 fft_aggregated: centroid, variance, skew and kurtosis of the amplitude spectrum.

The whole spectrum of a series of n points is a transform in two grouped passes.
With n <= n1 * n2, write t = n2 * t1 + t2 and k = k1 + n1 * k2 for n = n1 * n2:

  X[k1 + n1 k2] = sum over t2 of  w_n^(t2 k1) * w_n2^(t2 k2) * ( sum over t1 of  w_n1^(t1 k1) * x[n2 t1 + t2] )

The inner sum is a group of (series, t2, k1) over n1 points, the outer one of
(series, k1, k2) over n2, so the work is n * (n1 + n2), about 2 n^1.5, in two
shuffles of rows that Spark combines on the map side, and no series sits in one task.
A prime n has no factors; its transform is the chirp sum

  X[k] = c[k] * sum over t of (x[t] c[t]) * conj(c[k - t]),   c[t] = exp(-i pi t^2 / n),

a convolution, which is exact at the composite length m of the next square of at
least 2n, and is done by the same two passes there, forth and back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name

#: The four attributes, in the order of the columns.
ATTRIBUTES = ("centroid", "variance", "skew", "kurtosis")


def _turn(num: Column, den: Column) -> Column:
    """Angle of ``num / den`` turns, the whole turns taken off first."""
    return F.lit(2 * math.pi) * F.pmod(num, den).cast("double") / den


def _factor(n: Column) -> Column:
    """The largest divisor of n up to its square root, by trial over at most sqrt(n) numbers."""
    root = F.floor(F.sqrt(n.cast("double")) + 1e-9).cast("long")
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), root), lambda d: n % d == 0))


def dft(points: DataFrame, sign: int = -1) -> DataFrame:
    """``points(keys..., n, n1, t, re, im)`` to ``(keys..., n, n1, t, re, im)``, t now the
    coefficient: the transform of length n = n1 * (n / n1) of each key's points
    (missing ones are 0); ``sign`` is that of the exponent."""
    n, n1 = F.col("n"), F.col("n1")
    n2 = F.floor(n / n1).cast("long")
    k1 = F.explode(F.sequence(F.lit(0).cast("long"), n1 - 1))
    rows = points.select(*KEY, "n", "n1", (F.col("t") % n2).alias("t2"), F.floor(F.col("t") / n2).cast("long").alias("t1"),
                         "re", "im", k1.alias("k1"))
    a = sign * _turn(F.col("t1") * F.col("k1"), n1)
    inner = rows.groupBy(*KEY, "n", "n1", "t2", "k1").agg(
        F.sum(F.col("re") * F.cos(a) - F.col("im") * F.sin(a)).alias("re"),
        F.sum(F.col("re") * F.sin(a) + F.col("im") * F.cos(a)).alias("im"))
    k2 = F.explode(F.sequence(F.lit(0).cast("long"), n2 - 1))
    outer = inner.select("*", k2.alias("k2"))
    b = sign * _turn(F.col("t2") * (F.col("k1") + n1 * F.col("k2")), n)
    return outer.groupBy(*KEY, "n", "n1", (F.col("k1") + n1 * F.col("k2")).alias("t")).agg(
        F.sum(F.col("re") * F.cos(b) - F.col("im") * F.sin(b)).alias("re"),
        F.sum(F.col("re") * F.sin(b) + F.col("im") * F.cos(b)).alias("im"))


def _chirp(t: Column, n: Column) -> Column:
    """Angle of c[t] without its sign: pi t^2 / n, t^2 taken modulo 2n."""
    return F.lit(math.pi) * F.pmod(t * t, 2 * n).cast("double") / n


def _by_chirp(points: DataFrame) -> DataFrame:
    """The transform of keys whose n has no useful divisor: ``(keys..., n, t, re, im)``."""
    a = _chirp(F.col("t"), F.col("n"))
    side = F.ceil(F.sqrt(2.0 * F.col("n"))).cast("long")
    lengths = points.select(*KEY, F.col("n").alias("own")).distinct().withColumn("n1", F.ceil(F.sqrt(2.0 * F.col("own"))).cast("long"))
    x = points.select(*KEY, "t", (F.col("x") * F.cos(a)).alias("re"), (-F.col("x") * F.sin(a)).alias("im"),
                      side.alias("n1")).withColumn("n", F.col("n1") * F.col("n1"))
    # conj(c) at -(own - 1) .. own - 1, the negative places counted from the end
    place = F.explode(F.sequence(1 - F.col("own"), F.col("own") - 1))
    b = lengths.select(*KEY, "own", "n1", (F.col("n1") * F.col("n1")).alias("n"), place.alias("s"))
    angle = _chirp(F.col("s"), F.col("own"))
    b = b.select(*KEY, "n", "n1", F.pmod("s", "n").alias("t"), F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    fx, fb = dft(x), dft(b)
    both = fx.join(fb.select(*KEY, "t", F.col("re").alias("c"), F.col("im").alias("d")), [*KEY, "t"])
    product = both.select(*KEY, "n", "n1", "t", (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"),
                          (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))
    back = dft(product, 1).join(lengths.select(*KEY, "own"), KEY).where(F.col("t") < F.col("own"))
    a = _chirp(F.col("t"), F.col("own"))
    re, im = F.col("re") / F.col("n"), F.col("im") / F.col("n")
    return back.select(*KEY, F.col("own").alias("n"), "t", (re * F.cos(a) + im * F.sin(a)).alias("re"),
                       (im * F.cos(a) - re * F.sin(a)).alias("im"))


def spectrum(series: DataFrame) -> DataFrame:
    """``(series_id, channel, coeff, n, abs)`` for all coefficients 0 .. floor(n / 2) of
    ``series(series_id, channel, t, x)``, t dense from 0; null values make the series' sums null."""
    lengths = series.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("n1", _factor(F.col("n")))
    # the two passes cost n / n1 + n1 a point; the chirp's three transforms of 2n points beat that from here on
    poor = F.col("n") / F.col("n1") > 24 * F.sqrt(F.col("n").cast("double"))
    points = series.select(*KEY, "t", "x").join(lengths, KEY)
    direct = dft(points.where(~poor).select(*KEY, "n", "n1", "t", F.col("x").alias("re"), F.lit(0.0).alias("im")))
    chirped = _by_chirp(points.where(poor).drop("n1"))
    all_ = direct.select(*KEY, "n", "t", "re", "im").unionByName(chirped)
    return all_.where(F.col("t") <= F.floor(F.col("n") / 2)).select(
        *KEY, F.col("t").alias("coeff"), "n", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("abs"))


def fft_aggregated(series: DataFrame) -> DataFrame:
    """F-33, a column per attribute.  With weights abs(X[k]): the centroid is the mean of
    k, the variance its second central moment; skew and kurtosis are null where
    the variance is under 0.5, as they then depend on rounding."""
    k, w = F.col("coeff").cast("double"), F.col("abs")
    sums = spectrum(series).groupBy(*KEY).agg(F.sum(w).alias("_w"), *[F.sum(w * F.pow(k, F.lit(float(p)))).alias(f"_{p}") for p in (1, 2, 3, 4)])
    m1, m2, m3, m4 = (F.when(F.col("_w") > 0, F.col(f"_{p}") / F.col("_w")) for p in (1, 2, 3, 4))
    var = m2 - m1 * m1
    skew = F.when(var >= 0.5, (m3 - 3 * m1 * var - m1 * m1 * m1) / F.pow(var, F.lit(1.5)))
    kurt = F.when(var >= 0.5, (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * F.pow(m1, F.lit(4.0))) / (var * var))
    return sums.select(*KEY, *[v.alias(column_name("fft_aggregated", aggtype=a))
                               for a, v in zip(ATTRIBUTES, (m1, var, skew, kurt), strict=True)])
