"""Value-count features (F-21, F-22) from one ``(series, channel, x)`` count
table — a partial aggregate keyed by the value itself, so a hot series is
spread over its distinct values:

has_duplicate, has_duplicate_max, has_duplicate_min,
percentage_of_reoccurring_values_to_all_values (values seen more than once /
distinct values), percentage_of_reoccurring_datapoints_to_all_datapoints
(points whose value is seen more than once / points), sum_of_reoccurring_values,
sum_of_reoccurring_data_points, ratio_value_number_to_time_series_length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY


def reoccurrence(series: DataFrame) -> DataFrame:
    vc = series.filter(F.col("x").isNotNull()).groupBy(*KEY, "x").agg(F.count(F.lit(1)).alias("c"))
    c, x = F.col("c"), F.col("x")
    n = F.sum(c)
    nd = F.count(F.lit(1))
    rep = c > 1
    return vc.groupBy(*KEY).agg(
        (nd < n).cast("double").alias("has_duplicate"),
        (F.max_by(c, x) > 1).cast("double").alias("has_duplicate_max"),
        (F.min_by(c, x) > 1).cast("double").alias("has_duplicate_min"),
        (F.count_if(rep) / nd).alias("percentage_of_reoccurring_values_to_all_values"),
        (F.coalesce(F.sum(F.when(rep, c)), F.lit(0)) / n).alias(
            "percentage_of_reoccurring_datapoints_to_all_datapoints"),
        F.coalesce(F.sum(F.when(rep, x)), F.lit(0.0)).alias("sum_of_reoccurring_values"),
        F.coalesce(F.sum(F.when(rep, x * c)), F.lit(0.0)).alias("sum_of_reoccurring_data_points"),
        (nd / n).alias("ratio_value_number_to_time_series_length"),
    )
