"""F-39 / V-9: run feature families and return the long feature table
``(series_id, feature, value)`` with ``<channel>__<calculator>__<params>`` names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.autocorr import autocorrelation, partial_autocorrelation
from sigframe.operators.features.changes import changes
from sigframe.operators.features.distribution import distribution
from sigframe.operators.features.entropy import entropy
from sigframe.operators.features.location import location
from sigframe.operators.features.naming import feature_name, to_long
from sigframe.operators.features.ordered import ordered
from sigframe.operators.features.quantiles import quantiles
from sigframe.operators.features.reoccurrence import reoccurrence
from sigframe.operators.features.spectral import CWT_WIDTHS, cwt_coefficients, fft_coefficients, welch_density
from sigframe.operators.features.spectrum import fft_aggregated
from sigframe.operators.features.trend import change_quantiles, trend
from sigframe.session import cut_lineage

WIDE_FAMILIES = {
    "distribution": distribution, "quantiles": quantiles, "changes": changes, "autocorrelation": autocorrelation,
    "partial_autocorrelation": partial_autocorrelation, "location": location, "reoccurrence": reoccurrence,
    "ordered": ordered, "trend": trend, "change_quantiles": change_quantiles, "welch": welch_density,
    "fft_aggregated": fft_aggregated, "entropy": entropy,
}
LONG_FAMILIES = ("fft", "cwt")
MINIMAL = ("distribution",)
COMPREHENSIVE = tuple(WIDE_FAMILIES) + LONG_FAMILIES


def fft_long(series: DataFrame) -> DataFrame:
    fft = fft_coefficients(series)
    attrs = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).alias("v")) for a in ("real", "imag", "abs", "angle")])
    rows = fft.select(*KEY, "coeff", F.inline(attrs))
    name = F.format_string('fft_coefficient__attr_"%s"__coeff_%d', F.col("a"), F.col("coeff"))
    return rows.select("series_id", F.concat_ws("__", "channel", name).alias("feature"), F.col("v").alias("value"))


def cwt_long(series: DataFrame) -> DataFrame:
    widths = feature_name("x", widths=tuple(CWT_WIDTHS)).split("__", 1)[1]
    name = F.format_string("cwt_coefficients__coeff_%d__w_%d__" + widths, F.col("coeff"), F.col("w"))
    return cwt_coefficients(series).select("series_id", F.concat_ws("__", "channel", name).alias("feature"),
                                           "value")


def extract(series: DataFrame, families=COMPREHENSIVE, stored: bool = False) -> DataFrame:
    """Long feature table for the chosen families (default: all).  With ``stored``, the wide
    families are worked out now, one row a series and channel, for readers that pass
    over the long table several times."""
    keep = cut_lineage if stored else (lambda wide: wide)
    parts = [to_long(keep(WIDE_FAMILIES[f](series))) for f in families if f in WIDE_FAMILIES]
    if "fft" in families:
        parts.append(fft_long(series))
    if "cwt" in families:
        parts.append(cwt_long(series))
    return reduce(DataFrame.unionByName, parts)
