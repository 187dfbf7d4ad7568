"""Change features (ordered, block/halo windows then partial aggregates):
F-6 absolute_sum_of_changes / mean_abs_change / mean_change,
F-7 mean_second_derivative_central, F-8 cid_ce, F-26 number_crossing_m,
F-30 c3 and time_reversal_asymmetry_statistic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name
from sigframe.operators.ordering import HALO, block_window, blocked

# Default parameter grids of the calculators.
CROSSING_M = [-1, 0, 1]
C3_LAGS = [1, 2, 3]


def changes(series: DataFrame) -> DataFrame:
    halo = 2 * max(C3_LAGS)
    b = blocked(series, halo=halo)
    w = block_window(KEY)
    leads = {k: F.lead("x", k).over(w) for k in range(1, halo + 1)}
    b = b.select(*KEY, "x", HALO, *[leads[k].alias(f"_x{k}") for k in leads])
    own = b.filter(~F.col(HALO))
    x, x1, x2 = F.col("x"), F.col("_x1"), F.col("_x2")
    d = x1 - x
    std = F.stddev_pop(x)
    cid = F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0)))
    aggs = [
        F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("absolute_sum_of_changes"),
        F.avg(F.abs(d)).alias("mean_abs_change"),
        F.avg(d).alias("mean_change"),
        F.avg((x2 - 2 * x1 + x) / 2).alias("mean_second_derivative_central"),
        cid.alias("cid_ce__normalize_False"),
        F.when(std != 0, cid / std).otherwise(F.lit(0.0)).alias("cid_ce__normalize_True"),
    ]
    for m in CROSSING_M:
        aggs.append(F.count_if(x1.isNotNull() & ((x > m) != (x1 > m))).alias(column_name("number_crossing_m", m=m)))
    for lag in C3_LAGS:
        xl, x2l = F.col(f"_x{lag}"), F.col(f"_x{2 * lag}")
        aggs.append(F.coalesce(F.avg(x2l * xl * x), F.lit(0.0)).alias(column_name("c3", lag=lag)))
        aggs.append(F.coalesce(F.avg(F.when(x2l.isNotNull(), x2l * x2l * xl - xl * x * x)), F.lit(0.0))
                    .alias(column_name("time_reversal_asymmetry_statistic", lag=lag)))
    return own.groupBy(*KEY).agg(*aggs)
