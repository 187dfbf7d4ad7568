"""Exact quantile features without per-series value buffers:
F-1 median, F-4 quantile, F-25 symmetry_looking.

Values are ranked inside each (series, channel) with the range-partitioned
dense index (a hot series spans many tasks); each requested quantile needs
two ranks, fetched with an equi-join on ``(series_id, channel, r)``; linear
interpolation as ``lo + frac * (hi - lo)`` with ``pos = q * (n - 1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name
from sigframe.operators.ordering import dense_index

# Default parameter grids of the calculators.
QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
SYMMETRY_R = [round(0.05 * i, 2) for i in range(20)]


def quantile_table(df: DataFrame, qs: Sequence[float], keys: Sequence[str] = tuple(KEY),
                   value: str = "x", tie: str = "t") -> DataFrame:
    """Long ``(keys..., q, value)`` of exact interpolated quantiles of ``value``.

    ``tie`` completes the rank order (a unique column inside each key group).
    """
    keys = list(keys)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(tie).alias("_tie"),
                                                                         F.col(value).alias("_v"))
    ranked = dense_index(clean, keys, ["_v", "_tie"], out="_r")
    n = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    want = n.select(*keys, "_n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    pos = F.col("q") * (F.col("_n") - 1)
    want = want.withColumn("_lo", F.floor(pos).cast("bigint")).withColumn("_frac", pos - F.floor(pos))
    want = want.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    picks = want.select(*keys, "q", "_frac", F.explode(F.array(
        F.struct(F.col("_lo").alias("r"), F.lit(0).alias("role")),
        F.struct(F.col("_hi").alias("r"), F.lit(1).alias("role")))).alias("p"))
    picks = picks.select(*keys, "q", "_frac", F.col("p.r").alias("_r"), F.col("p.role").alias("role"))
    got = picks.join(ranked.select(*keys, "_r", "_v"), [*keys, "_r"])
    vals = got.groupBy(*keys, "q").agg(
        F.max(F.when(F.col("role") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("role") == 1, F.col("_v"))).alias("_b"), F.max("_frac").alias("_f"))
    return vals.select(*keys, "q", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("value"))


def quantiles(series: DataFrame) -> DataFrame:
    """Wide ``median``, ``quantile__q_*`` and ``symmetry_looking__r_*`` per series."""
    qt = quantile_table(series, [0.5] + QUANTILES)
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    wide = qt.groupBy(*KEY).agg(pick(0.5).alias("median"),
                                *[pick(q).alias(column_name("quantile", q=q)) for q in QUANTILES])
    stats = series.groupBy(*KEY).agg(F.avg("x").alias("_m"), F.max("x").alias("_mx"), F.min("x").alias("_mn"))
    out = wide.join(stats, KEY)
    sym = [(F.abs(F.col("_m") - F.col("median")) < r * (F.col("_mx") - F.col("_mn"))).cast("double")
           .alias(column_name("symmetry_looking", r=r)) for r in SYMMETRY_R]
    return out.select(*KEY, "median", *[column_name("quantile", q=q) for q in QUANTILES], *sym)
