"""Spectral features as grouped sums over a bounded coefficient grid:

F-32 fft_coefficient (k = 0..99, k <= n/2; real, imag, abs, angle in degrees)
— a direct DFT: every point is expanded to at most 100 coefficient rows and
immediately partially aggregated per (series, channel, k);
F-35 cwt_coefficients (Ricker widths 2, 5, 10, 20; positions 0..14) — only
points within the kernel reach of the first 15 positions contribute, so the
work per series is bounded regardless of its length.
Returned in long form (one row per coefficient) to keep plans narrow.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.columns import round_sig
from sigframe.operators.features import KEY

# Default parameter grids of the calculators.
FFT_COEFFS = 100
CWT_WIDTHS = [2, 5, 10, 20]
CWT_COEFFS = 15


def _n(series: DataFrame) -> DataFrame:
    return series.groupBy(*KEY).agg(F.count("x").alias("_n"))


def fft_coefficients(series: DataFrame) -> DataFrame:
    """``(series_id, channel, coeff, real, imag, abs, angle)``."""
    j = series.join(_n(series), KEY)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(FFT_COEFFS - 1).cast("bigint"),
                                                              F.floor(F.col("_n") / 2).cast("bigint"))))
    rows = j.select(*KEY, "t", "x", "_n", k.alias("coeff"))
    arg = F.lit(2 * math.pi) * F.pmod(F.col("coeff") * F.col("t"), F.col("_n")) / F.col("_n")
    agg = rows.groupBy(*KEY, "coeff").agg(F.sum(F.col("x") * F.cos(arg)).alias("real"),
                                          (-F.sum(F.col("x") * F.sin(arg))).alias("imag"))
    re, im = round_sig("real"), round_sig("imag")
    return agg.select(*KEY, "coeff", "real", "imag", F.sqrt(F.col("real") * F.col("real") + F.col("imag") * F.col("imag")).alias("abs"),
                      F.degrees(F.atan2(im, re)).alias("angle"))


def cwt_coefficients(series: DataFrame) -> DataFrame:
    """``(series_id, channel, w, coeff, value)`` of the Ricker transform (mode 'same')."""
    j = series.join(_n(series), KEY)
    wid = j.select(*KEY, "t", "x", "_n", F.explode(F.array(*[F.lit(w).cast("bigint") for w in CWT_WIDTHS])).alias("w"))
    length = F.least(F.col("w") * 10, F.col("_n"))
    half = F.floor((length - 1) / 2)
    wid = wid.withColumn("_L", length).withColumn("_h", half).filter(F.col("t") <= CWT_COEFFS - 1 + F.col("_h"))
    # one group a width with a sum for each position, not a group and a row a position
    a = F.col("w").cast("double")
    amp = F.lit(2.0) / (F.sqrt(a * 3.0) * F.lit(math.pi ** 0.25))
    sums, reached = [], F.lit(0)
    for c in range(CWT_COEFFS):
        m = F.lit(c).cast("bigint") + F.col("_h") - F.col("t")
        on = (F.lit(c) < F.col("_n")) & (m >= 0) & (m < F.col("_L"))
        v = m - (F.col("_L") - 1) / 2.0
        ricker = amp * (1 - v * v / (a * a)) * F.exp(-v * v / (2 * a * a))
        sums.append(F.sum(F.when(on, F.col("x") * ricker)).alias(f"_s{c}"))
        reached = reached.bitwiseOR(F.when(on, 1 << c).otherwise(0))
    per = wid.groupBy(*KEY, "w").agg(F.bit_or(reached).alias("_on"), *sums)
    cells = F.array(*[F.when(F.col("_on").bitwiseAND(1 << c) != 0, F.struct(F.lit(c).cast("bigint").alias("coeff"),
                                                                            F.col(f"_s{c}").alias("value")))
                      for c in range(CWT_COEFFS)])
    return per.select(*KEY, "w", F.inline(F.filter(cells, lambda e: e.isNotNull())))


# Welch density parameters (segment cap, coefficients).
WELCH_MAX_SEGMENT = 256
WELCH_COEFFS = [2, 5, 8]


def welch_density(series: DataFrame) -> DataFrame:
    """F-34 spkt_welch_density: Welch power density (periodic Hann window,
    half-overlapping segments of ``L = min(n, 256)`` points, constant detrend,
    one-sided density scaling, mean over segments) at coefficients 2, 5, 8.

    Each point falls in at most two segments and contributes to three
    coefficients, so the work is linear in the series length.
    """
    j = series.join(_n(series), KEY)
    length = F.least(F.col("_n"), F.lit(WELCH_MAX_SEGMENT))
    step = length - F.floor(length / 2)
    nseg = F.floor((F.col("_n") - F.floor(length / 2)) / step)
    j = j.withColumn("_L", length).withColumn("_step", step).withColumn("_S", nseg)
    last = F.floor(F.col("t") / F.col("_step"))
    segs = F.filter(F.array(last - 1, last), lambda s: (s >= 0) & (s < F.col("_S")) &
                    (F.col("t") - s * F.col("_step") < F.col("_L")))
    rows = j.select(*KEY, "t", "x", "_L", F.explode(segs).alias("seg"))
    rows = rows.withColumn("_j", F.col("t") - F.col("seg") * (F.col("_L") - F.floor(F.col("_L") / 2)))
    rows = rows.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in WELCH_COEFFS])).alias("coeff"))
    two_pi = 2 * math.pi
    w = F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(two_pi) * F.col("_j") / F.col("_L"))
    arg = F.lit(two_pi) * F.pmod(F.col("_j") * F.col("coeff"), F.col("_L")) / F.col("_L")
    per = rows.groupBy(*KEY, "seg", "coeff").agg(
        F.sum(F.col("x") * w * F.cos(arg)).alias("_xc"), F.sum(F.col("x") * w * F.sin(arg)).alias("_xs"),
        F.sum("x").alias("_sx"), F.sum(w * F.cos(arg)).alias("_wc"), F.sum(w * F.sin(arg)).alias("_ws"),
        F.sum(w * w).alias("_w2"), F.first("_L").alias("_L"))
    m = F.col("_sx") / F.col("_L")
    re, im = F.col("_xc") - m * F.col("_wc"), F.col("_xs") - m * F.col("_ws")
    half = F.floor(F.col("_L") / 2)
    onesided = F.when((F.col("coeff") == 0) | ((F.col("_L") % 2 == 0) & (F.col("coeff") == half)), F.lit(1.0)) \
        .otherwise(F.lit(2.0))
    pxx = F.when((F.col("_w2") > 0) & (F.col("coeff") <= half), (re * re + im * im) / F.col("_w2") * onesided)
    dens = per.select(*KEY, "coeff", pxx.alias("_p")).groupBy(*KEY, "coeff").agg(F.avg("_p").alias("value"))
    from sigframe.operators.features.naming import column_name

    return dens.groupBy(*KEY).agg(*[F.max(F.when(F.col("coeff") == k, F.col("value"))).alias(
        column_name("spkt_welch_density", coeff=k)) for k in WELCH_COEFFS])
