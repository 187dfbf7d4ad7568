"""Features that compare each point with whole-series statistics (a stats
table joined back on the series key; AQE broadcasts it when small and splits
skewed partitions otherwise):

F-18 count_above_mean / count_below_mean, F-24 ratio_beyond_r_sigma,
F-20 first/last location of maximum/minimum, F-29 energy_ratio_by_chunks,
F-31 binned_entropy, F-37 benford_correlation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name

# Default parameter grids of the calculators.
BEYOND_SIGMA_R = [0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10]
ENERGY_SEGMENTS = 10
ENTROPY_BINS = 10
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def series_stats(series: DataFrame) -> DataFrame:
    x = F.col("x")
    return series.groupBy(*KEY).agg(
        F.count(x).alias("_n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.max(x).alias("_mx"),
        F.min(x).alias("_mn"), F.sum(x * x).alias("_e"))


def chunk_of(t, n, segments: int):
    """Index of ``t`` among ``segments`` array_split chunks of ``n`` points."""
    q = F.floor(n / segments)
    rem = n - q * segments
    big = rem * (q + 1)
    return F.when(t < big, F.floor(t / (q + 1))).otherwise(rem + F.floor((t - big) / F.greatest(q, F.lit(1))))


def histogram_bin(x, mn, mx, bins: int):
    """Equal-width bin of ``x`` on [mn, mx] with edge checks against the linspace edges."""
    width = mx - mn
    raw = F.floor((x - mn) * (F.lit(float(bins)) / width))
    idx = F.least(raw, F.lit(bins - 1))
    edge = lambda i: mn + i * (width / bins)
    idx = F.when(x < edge(idx), idx - 1).otherwise(idx)
    idx = F.when((x >= edge(idx + 1)) & (idx != bins - 1), idx + 1).otherwise(idx)
    return idx


def leading_digit(x):
    """First significant digit of |x| (0 for 0), robust to log10 rounding at powers of ten."""
    a = F.abs(x)
    d = F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a))))
    return F.when(a == 0, F.lit(0)).when(d >= 10, F.lit(1)).when(d < 1, F.lit(9)).otherwise(d).cast("int")


def location(series: DataFrame) -> DataFrame:
    st = series_stats(series)
    j = series.join(st, KEY)
    x, t, n, m, s = F.col("x"), F.col("t"), F.col("_n"), F.col("_m"), F.col("_s")
    mx, mn, e = F.col("_mx"), F.col("_mn"), F.col("_e")
    chunk = chunk_of(t, n, ENERGY_SEGMENTS)
    aggs = [
        F.count_if(x > m).alias("count_above_mean"),
        F.count_if(x < m).alias("count_below_mean"),
        (F.min(F.when(x == mx, t)) / F.first(n)).alias("first_location_of_maximum"),
        ((F.max(F.when(x == mx, t)) + 1) / F.first(n)).alias("last_location_of_maximum"),
        (F.min(F.when(x == mn, t)) / F.first(n)).alias("first_location_of_minimum"),
        ((F.max(F.when(x == mn, t)) + 1) / F.first(n)).alias("last_location_of_minimum"),
    ]
    aggs += [(F.count_if(F.abs(x - m) > r * s) / F.first(n)).alias(column_name("ratio_beyond_r_sigma", r=r))
             for r in BEYOND_SIGMA_R]
    aggs += [(F.coalesce(F.sum(F.when(chunk == i, x * x)), F.lit(0.0)) / F.nullif(F.first(e), F.lit(0.0)))
             .alias(column_name("energy_ratio_by_chunks", num_segments=ENERGY_SEGMENTS, segment_focus=i))
             for i in range(ENERGY_SEGMENTS)]
    digit = leading_digit(x)
    aggs += [F.count_if(digit == dgt).alias(f"_d{dgt}") for dgt in range(1, 10)]
    base = j.groupBy(*KEY).agg(*aggs, F.first(n).alias("_nn"))
    # Benford: Pearson correlation of the 9 digit frequencies with the fixed law.
    p = [F.col(f"_d{dgt}") / F.col("_nn") for dgt in range(1, 10)]
    pbar = sum(p) / 9.0
    bbar = sum(BENFORD) / 9.0
    cov = sum((p[i] - pbar) * (BENFORD[i] - bbar) for i in range(9))
    vp = sum((p[i] - pbar) * (p[i] - pbar) for i in range(9))
    vb = sum((b - bbar) ** 2 for b in BENFORD)
    benford = F.when(vp > 0, cov / F.sqrt(vp * F.lit(vb)))
    # Binned entropy: per-bin counts (partial aggregate on (key, bin)).
    binned = j.withColumn("_bin", F.when(mx > mn, histogram_bin(x, mn, mx, ENTROPY_BINS)).otherwise(F.lit(0)))
    counts = binned.groupBy(*KEY, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    pr = F.col("_c") / F.col("_n")
    ent = counts.groupBy(*KEY).agg((-F.sum(pr * F.log(pr))).alias(column_name("binned_entropy", max_bins=ENTROPY_BINS)))
    keep = [c for c in base.columns if not c.startswith("_")]
    return base.select(*keep, benford.alias("benford_correlation")).join(ent, KEY)
