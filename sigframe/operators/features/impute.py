"""F-38 column-wise imputation of a long feature table.

Per feature: NULL/NaN -> median of the finite values, +inf -> their maximum,
-inf -> their minimum; a feature without finite values becomes 0.  The
median is the exact distributed quantile (rank join), not a value buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features.quantiles import quantile_table
from sigframe.session import cut_lineage

INF = float("inf")


def impute(features: DataFrame) -> DataFrame:
    v = F.col("value")
    finite = features.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF))
    stats = finite.groupBy("feature").agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
    med = quantile_table(finite, [0.5], keys=["feature"], value="value", tie="series_id").select(
        "feature", F.col("value").alias("_med"))
    fill = cut_lineage(stats.join(med, "feature", "left"))  # a row a feature; readers of the result do not rank the values again
    j = features.join(fill, "feature", "left")
    filled = (F.when(v.isNull() | F.isnan(v), F.coalesce(F.col("_med"), F.lit(0.0)))
              .when(v == INF, F.coalesce(F.col("_hi"), F.lit(0.0)))
              .when(v == -INF, F.coalesce(F.col("_lo"), F.lit(0.0)))
              .otherwise(v))
    return j.select("series_id", "feature", filled.alias("value"))
