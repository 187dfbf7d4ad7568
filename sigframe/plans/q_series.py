"""Registered queries: series construction, equalisation and feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.operators import series as S
from sigframe.operators.features.autocorr import autocorrelation
from sigframe.operators.features.changes import changes
from sigframe.operators.features.distribution import distribution
from sigframe.operators.features.naming import to_long
from sigframe.plans import feature_oracles as FO
from sigframe.plans.oracle import EQUALISED_CTE, SERIES_CTE, r, rs, with_ctes
from sigframe.plans.registry import register
from sigframe.session import cut_lineage
from sigframe.sources.standins import series_from_events
from sigframe.sources.tables import load


def events_series(spark, d):
    return series_from_events(load(spark, d, "events"))


@register("series_points", "W-1 P-6 P-7 P-15 U-1 A-4 L-5",
          with_ctes(SERIES_CTE, f"SELECT series_id, subject, target, channel, t, {r('x', 'x')} FROM series"))
def q_series_points(spark, d):
    return events_series(spark, d)


@register("series_counts", "A-1 J-7",
          with_ctes(SERIES_CTE, "SELECT series_id, subject, target, count(CASE WHEN NOT isnan(x) THEN x END) AS n_points "
                                "FROM series WHERE channel = 'x_0' GROUP BY series_id, subject, target"))
def q_series_counts(spark, d):
    return S.point_counts(events_series(spark, d))


@register("series_min_length", "A-2",
          with_ctes(SERIES_CTE, "SELECT min(n) AS min_length FROM (SELECT series_id, "
                                "count(CASE WHEN NOT isnan(x) THEN x END) AS n FROM series "
                                "WHERE channel = 'x_0' GROUP BY series_id)"))
def q_series_min_length(spark, d):
    return S.min_length(events_series(spark, d))


@register("series_equalised", "W-2",
          with_ctes(EQUALISED_CTE, f"SELECT series_id, subject, target, channel, t, {r('x', 'x')} FROM eq"))
def q_series_equalised(spark, d):
    return S.equalise(events_series(spark, d))


@register("features_distribution", "F-1 F-2 F-3 F-5 F-18 F-23 F-25 F-37",
          with_ctes(SERIES_CTE, FO.distribution_sql()))
def q_features_distribution(spark, d):
    return distribution(events_series(spark, d))


@register("features_changes", "F-6 F-7 F-8 F-26 F-30", with_ctes(SERIES_CTE, FO.changes_sql()))
def q_features_changes(spark, d):
    return changes(events_series(spark, d))


@register("features_autocorrelation", "F-10 F-11", with_ctes(SERIES_CTE, FO.autocorrelation_sql()))
def q_features_autocorrelation(spark, d):
    return autocorrelation(events_series(spark, d))


def names_values(cols) -> str:
    """SQL VALUES list mapping family column names to feature text."""
    from sigframe.operators.features.naming import FEATURE_TEXT

    rows = ", ".join(f"('{c}', '{FEATURE_TEXT.get(c, c)}')" for c in cols)
    return f"(VALUES {rows}) nm(calc, txt)"


def long_sql(ctes: str, family_sql: str, cols) -> str:
    """Oracle for ``naming.to_long``: unpivot a family, keep NULLs, map names."""
    body = f"""
SELECT series_id, channel || '__' || coalesce(nm.txt, u.calc) AS feature, {rs('value')} AS value
FROM (SELECT * FROM fam UNPIVOT INCLUDE NULLS (value FOR calc IN (COLUMNS(* EXCLUDE (series_id, channel))))) u
LEFT JOIN {names_values(cols)} USING (calc)"""
    return with_ctes(f"{ctes},\nfam AS ({family_sql})", body)


def long_ctes(family_sql: str, cols, src_name: str = "flong") -> str:
    """CTE fragment defining ``src_name(series_id, feature, value)`` (unrounded)."""
    return f"""fam AS ({family_sql}),
{src_name} AS (
  SELECT series_id, channel || '__' || coalesce(nm.txt, u.calc) AS feature, CAST(value AS DOUBLE) AS value
  FROM (SELECT * FROM fam UNPIVOT INCLUDE NULLS (value FOR calc IN (COLUMNS(* EXCLUDE (series_id, channel))))) u
  LEFT JOIN {names_values(cols)} USING (calc))"""


def family_columns(family_sql: str) -> list[str]:
    """Output column names of a family oracle (aliases after AS)."""
    import re

    return list(dict.fromkeys(re.findall(r' AS "?([A-Za-z0-9_]+)"?', family_sql)))


def _equalised_long_sql() -> str:
    sql = FO.distribution_sql("eq")
    return long_sql(EQUALISED_CTE, sql, family_columns(sql))


@register("equalised_features_long", "W-2 F-1 F-2 F-39", _equalised_long_sql())
def q_equalised_features_long(spark, d):
    eq = S.equalise(events_series(spark, d))
    return to_long(distribution(eq))


from sigframe.operators.features.location import location  # noqa: E402
from sigframe.operators.features.ordered import ordered  # noqa: E402
from sigframe.operators.features.quantiles import quantiles  # noqa: E402
from sigframe.operators.features.reoccurrence import reoccurrence  # noqa: E402


@register("features_quantiles", "F-1 F-4 F-25", with_ctes(SERIES_CTE, FO.quantiles_sql()))
def q_features_quantiles(spark, d):
    return quantiles(events_series(spark, d))


@register("features_location", "F-18 F-20 F-24 F-29 F-31 F-37", with_ctes(SERIES_CTE, FO.location_sql()))
def q_features_location(spark, d):
    return location(events_series(spark, d))


@register("features_reoccurrence", "F-21 F-22", with_ctes(SERIES_CTE, FO.reoccurrence_sql()))
def q_features_reoccurrence(spark, d):
    return reoccurrence(events_series(spark, d))


@register("features_ordered", "F-19 F-27 F-28 F-37",
          with_ctes(SERIES_CTE, FO.ordered_sql()))
def q_features_ordered(spark, d):
    return ordered(events_series(spark, d))


from sigframe.operators.features.spectral import cwt_coefficients, fft_coefficients  # noqa: E402
from sigframe.operators.features.trend import change_quantiles, trend  # noqa: E402


@register("features_trend", "F-14 F-15 F-16", with_ctes(SERIES_CTE, FO.trend_sql()))
def q_features_trend(spark, d):
    return trend(events_series(spark, d))


@register("features_change_quantiles", "F-9", with_ctes(SERIES_CTE, FO.change_quantiles_sql()))
def q_features_change_quantiles(spark, d):
    return change_quantiles(events_series(spark, d))


@register("features_fft", "F-32", with_ctes(SERIES_CTE, FO.fft_sql()))
def q_features_fft(spark, d):
    return fft_coefficients(events_series(spark, d))


@register("features_cwt", "F-35", with_ctes(SERIES_CTE, FO.cwt_sql()))
def q_features_cwt(spark, d):
    return cwt_coefficients(events_series(spark, d))


from sigframe.operators.features.entropy import entropy  # noqa: E402
from sigframe.operators.features.spectral import welch_density  # noqa: E402
from sigframe.operators.features.spectrum import fft_aggregated  # noqa: E402


@register("features_welch", "F-34", with_ctes(SERIES_CTE, FO.welch_sql()))
def q_features_welch(spark, d):
    return welch_density(events_series(spark, d))


@register("features_fft_aggregated", "F-33", with_ctes(SERIES_CTE, FO.fft_aggregated_sql()))
def q_features_fft_aggregated(spark, d):
    return fft_aggregated(events_series(spark, d))


@register("features_entropy", "F-36", with_ctes(SERIES_CTE, FO.entropy_sql()))
def q_features_entropy(spark, d):
    return entropy(events_series(spark, d))


def _all_long_sql() -> str:
    """Union of every family oracle in long form (F-39 names)."""
    wide = {
        "distribution": FO.distribution_sql(), "quantiles": FO.quantiles_sql(), "changes": FO.changes_sql(),
        "autocorrelation": FO.autocorrelation_sql(), "partial_autocorrelation": FO.pacf_sql(),
        "location": FO.location_sql(), "reoccurrence": FO.reoccurrence_sql(), "ordered": FO.ordered_sql(),
        "trend": FO.trend_sql(), "change_quantiles": FO.change_quantiles_sql(), "welch": FO.welch_sql(),
        "fft_aggregated": FO.fft_aggregated_sql(), "entropy": FO.entropy_sql(),
    }
    ctes, parts = [], []
    for i, (name, sql) in enumerate(wide.items()):
        cols = family_columns(sql)
        body = sql.strip()
        if body.upper().startswith("WITH RECURSIVE "):
            body = body[len("WITH RECURSIVE "):]
            # hoist the family's own CTEs under unique names
            inner = body
            for cte in ("st", "ac", "rh", "dl"):
                inner = re.sub(rf"\b{cte}\b", f"{cte}{i}", inner)
            head, _, tail = inner.rpartition("\nSELECT ")
            ctes.append(head)
            body = "SELECT " + tail
        elif body.upper().startswith("WITH "):
            inner = body[len("WITH "):]
            names = re.findall(r"(?:^|,\s*\n?)([a-z_][a-z0-9_]*) AS \(", inner)
            for cte in sorted(set(names), key=len, reverse=True):
                inner = re.sub(rf"\b{cte}\b", f"{cte}_{i}", inner)
            head, _, tail = inner.rpartition("\nSELECT ")
            ctes.append(head)
            body = "SELECT " + tail
        ctes.append(f"fam{i} AS ({body})")
        parts.append(f"""SELECT series_id, channel || '__' || coalesce(nm.txt, u.calc) AS feature, {rs('value')} AS value
FROM (SELECT * FROM fam{i} UNPIVOT INCLUDE NULLS (value FOR calc IN (COLUMNS(* EXCLUDE (series_id, channel))))) u
LEFT JOIN {names_values(cols)} USING (calc)""")
    parts.append(f"""SELECT series_id, channel || '__fft_coefficient__attr_"' || attr || '"__coeff_' || CAST(coeff AS VARCHAR)
  AS feature, {rs('value')} AS value FROM (SELECT * FROM ({FO.fft_sql().strip()}) UNPIVOT INCLUDE NULLS
  (value FOR attr IN ("real", "imag", "abs", "angle")))""")
    widths = "(" + ", ".join(str(w) for w in CWT_WIDTHS_) + ")"
    parts.append(f"""SELECT series_id, channel || '__cwt_coefficients__coeff_' || CAST(coeff AS VARCHAR) || '__w_'
  || CAST(w AS VARCHAR) || '__widths_{widths}' AS feature, {rs('value')} AS value FROM ({FO.cwt_sql().strip()})""")
    recursive = any(FO.pacf_sql().strip().upper().startswith("WITH RECURSIVE") for _ in [0])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + SERIES_CTE + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


import re  # noqa: E402

from sigframe.operators.features.extract import COMPREHENSIVE, extract  # noqa: E402
from sigframe.operators.features.spectral import CWT_WIDTHS as CWT_WIDTHS_  # noqa: E402


@register("features_all_long", "F-39 V-9", _all_long_sql())
def q_features_all_long(spark, d):
    return extract(cut_lineage(events_series(spark, d)), COMPREHENSIVE)  # read by every family
