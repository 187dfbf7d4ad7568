"""Distribution features (pure aggregates, map-side combined):
F-1 length/sum/mean/min/max, F-2 variance/stddev/variation coefficient/RMS,
F-3 sample-adjusted skewness and kurtosis, F-5 abs_energy, F-23 value and
range counts, F-25 large_standard_deviation / variance_larger_than_standard_deviation,
F-37 absolute_maximum, F-18 count_above/count_below (t=0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.columns import safe_div
from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name

# Default parameter grids of the calculators.
LARGE_STD_R = [round(0.05 * i, 2) for i in range(1, 20)]
VALUE_COUNT_VALUES = [0, 1, -1]


def distribution(series: DataFrame) -> DataFrame:
    x = F.col("x")
    n = F.count(x)
    nd = n.cast("double")
    var, std = F.var_pop(x), F.stddev_pop(x)
    mn, mx = F.min(x), F.max(x)
    skew = F.when(n >= 3, F.when(var == 0, F.lit(0.0)).otherwise(
        F.skewness(x) * F.sqrt(nd * (nd - 1)) / (nd - 2)))
    kurt = F.when(n >= 4, F.when(var == 0, F.lit(0.0)).otherwise(
        ((nd + 1) * F.kurtosis(x) + 6) * (nd - 1) / ((nd - 2) * (nd - 3))))
    aggs = [
        n.alias("length"),
        F.sum(x).alias("sum_values"),
        F.avg(x).alias("mean"),
        mn.alias("minimum"),
        mx.alias("maximum"),
        var.alias("variance"),
        std.alias("standard_deviation"),
        safe_div(std, F.avg(x)).alias("variation_coefficient"),
        F.sqrt(F.avg(x * x)).alias("root_mean_square"),
        F.sum(x * x).alias("abs_energy"),
        F.max(F.abs(x)).alias("absolute_maximum"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
        (var > std).cast("double").alias("variance_larger_than_standard_deviation"),
        (F.count_if(x > 0) / nd).alias("count_above__t_0"),
        (F.count_if(x < 0) / nd).alias("count_below__t_0"),
        F.count_if((x >= -1) & (x < 1)).alias("range_count__max_1__min_m1"),
    ]
    aggs += [F.count_if(x == v).alias(column_name("value_count", value=v)) for v in VALUE_COUNT_VALUES]
    aggs += [(std > r * (mx - mn)).cast("double").alias(column_name("large_standard_deviation", r=r))
             for r in LARGE_STD_R]
    return series.groupBy(*KEY).agg(*aggs)
