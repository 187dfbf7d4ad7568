"""Registered queries: imputation, partial autocorrelation and FRESH selection
over features extracted from the ``events`` series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.functions.columns import round_sig
from sigframe.operators import selection as V
from sigframe.operators.features.autocorr import partial_autocorrelation
from sigframe.operators.features.extract import MINIMAL, extract
from sigframe.operators.features.impute import impute
from sigframe.plans import feature_oracles as FO
from sigframe.plans.oracle import SERIES_CTE, normal_p_sql, r, rs, with_ctes
from sigframe.plans.q_series import events_series, family_columns, long_ctes
from sigframe.plans.registry import register

_DIST = FO.distribution_sql()
FEATURES_CTE = SERIES_CTE + ",\n" + long_ctes(_DIST, family_columns(_DIST)) + f""",
fstats AS (SELECT feature, max(value) AS hi, min(value) AS lo, quantile_cont(value, 0.5) AS med
           FROM flong WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY feature),
imp AS (SELECT f.series_id, f.feature,
          CASE WHEN f.value IS NULL OR isnan(f.value) THEN coalesce(s.med, 0.0)
               WHEN isinf(f.value) AND f.value > 0 THEN coalesce(s.hi, 0.0)
               WHEN isinf(f.value) THEN coalesce(s.lo, 0.0) ELSE f.value END AS value
        FROM flong f LEFT JOIN fstats s USING (feature)),
tg AS (SELECT DISTINCT series_id, CAST(target AS DOUBLE) AS target FROM series),
pts AS (SELECT i.feature, i.series_id, {rs('i.value')} AS value, tg.target FROM imp i JOIN tg USING (series_id)),
kinds AS (SELECT feature, count(DISTINCT {rs('value')}) AS n_distinct FROM imp GROUP BY feature)"""


def _ks_p_sql(d: str, na: str, nb: str) -> str:
    en = f"({na} * {nb} / ({na} + {nb}))"
    lam = f"((sqrt({en}) + 0.12 + 0.11 / sqrt({en})) * {d})"
    terms = " + ".join(f"({(-1) ** (j - 1)} * exp({-2.0 * j * j!r} * {lam} * {lam}))" for j in range(1, V.KS_TERMS + 1))
    return f"CASE WHEN {lam} < {V.KS_LAMBDA_MIN} THEN 1.0 ELSE least(greatest(2 * ({terms}), 0.0), 1.0) END"


PVALUES_CTE = FEATURES_CTE + f""",
rl AS (SELECT p.* FROM pts p JOIN kinds k USING (feature) WHERE k.n_distinct > 2),
cdp AS (SELECT a.feature, CAST(sum(sign(a.value - b.value) * sign(a.target - b.target)) AS DOUBLE) AS cd
        FROM rl a JOIN rl b ON a.feature = b.feature AND a.series_id < b.series_id GROUP BY a.feature),
xt AS (SELECT feature, sum(t) AS n, sum(t * (t - 1) / 2) AS xt, sum(t * (t - 1) * (2 * t + 5)) AS x1,
              sum(t * (t - 1) * (t - 2)) AS x2
       FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS t FROM rl GROUP BY 1, 2) GROUP BY 1),
yt AS (SELECT feature, sum(u * (u - 1) / 2) AS yt, sum(u * (u - 1) * (2 * u + 5)) AS y1,
              sum(u * (u - 1) * (u - 2)) AS y2
       FROM (SELECT feature, target, CAST(count(*) AS DOUBLE) AS u FROM rl GROUP BY 1, 2) GROUP BY 1),
kd AS (SELECT feature, cd, n, xt, x1, x2, yt, y1, y2, n * (n - 1) / 2 AS n0, n * (n - 1) AS m,
              (n * (n - 1) / 2 - xt) * (n * (n - 1) / 2 - yt) AS den
       FROM cdp JOIN xt USING (feature) JOIN yt USING (feature)),
kv AS (SELECT *, ((m * (2 * n + 5) - x1 - y1) / 18 + (2 * xt * yt) / m + x2 * y2 / (9 * m * (n - 2))) AS var FROM kd),
kendall AS (SELECT feature, 'real' AS kind, CASE WHEN den > 0 THEN cd / sqrt(den) END AS statistic,
                   CASE WHEN den > 0 AND var > 0 AND n > 2 THEN {normal_p_sql('cd / sqrt(var)')} END AS p_value FROM kv),
bn AS (SELECT p.*, min(p.value) OVER (PARTITION BY p.feature) AS lo FROM pts p JOIN kinds k USING (feature)
       WHERE k.n_distinct = 2),
bc AS (SELECT feature, target, count_if(value = lo) AS a, count_if(value <> lo) AS b FROM bn GROUP BY 1, 2),
bf AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa,
              sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb,
              sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb
       FROM bc WINDOW w AS (PARTITION BY feature ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bd AS (SELECT feature, max(abs(fa - fb)) AS d, any_value(na) AS na, any_value(nb) AS nb FROM bf GROUP BY 1),
ks AS (SELECT feature, 'binary' AS kind, d AS statistic,
              CASE WHEN d > 0 THEN {_ks_p_sql('d', 'na', 'nb')} ELSE 1.0 END AS p_value FROM bd),
pv AS (SELECT * FROM kendall UNION ALL SELECT * FROM ks),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY p_value ASC NULLS LAST, feature) AS INTEGER) AS rank FROM pv),
hk AS (SELECT *, (SELECT sum(1.0 / rank) FROM rk) AS h, (SELECT count(*) FROM rk) AS m FROM rk),
th AS (SELECT feature, kind, statistic, p_value, rank, 0.05 * rank / (m * h) AS threshold FROM hk),
rel AS (SELECT th.*, coalesce(rank <= (SELECT max(rank) FROM th WHERE p_value <= threshold), false) AS relevant FROM th)"""


def _features(spark, d, series=None):
    series = series if series is not None else events_series(spark, d)
    return impute(extract(series, MINIMAL, stored=True))


def _targets(spark, d, series=None):
    series = series if series is not None else events_series(spark, d)
    return series.select("series_id", F.col("target").cast("double").alias("target")).distinct()


def _features_targets(spark, d):
    """Features and targets from one series build (one dense index)."""
    s = events_series(spark, d)
    return _features(spark, d, s), _targets(spark, d, s)


def comparable(features):
    """Values as the oracle compares them (9 digits): two engines add in different
    orders, so ties differ in their last bits.  The operators compare values as they are."""
    return features.withColumn("value", round_sig("value"))


def _feature_max(series):
    """A real-valued target that features predict: each series' largest ``x_0``."""
    return series.where(F.col("channel") == "x_0").groupBy("series_id").agg(F.max("x").alias("target"))


@register("features_imputed", "F-38 F-39 V-9",
          with_ctes(FEATURES_CTE, f"SELECT series_id, feature, {r('value', 'value')} FROM imp"))
def q_features_imputed(spark, d):
    return _features(spark, d)


@register("features_partial_autocorrelation", "F-12 F-13", with_ctes(SERIES_CTE, FO.pacf_sql()))
def q_features_pacf(spark, d):
    return partial_autocorrelation(events_series(spark, d))


@register("selection_kinds", "V-1",
          with_ctes(FEATURES_CTE, """SELECT feature, n_distinct,
  CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct = 2 THEN 'binary' ELSE 'real' END AS kind FROM kinds"""))
def q_selection_kinds(spark, d):
    return V.feature_kinds(comparable(_features(spark, d)))


@register("selection_pvalues", "V-2 V-3 V-6",
          with_ctes(PVALUES_CTE, f"SELECT feature, kind, {r('statistic', 'statistic')}, {r('p_value', 'p_value')} "
                                 "FROM pv"))
def q_selection_pvalues(spark, d):
    feats, targets = _features_targets(spark, d)
    return V.feature_pvalues(comparable(feats), targets)


@register("selection_relevance", "V-7",
          with_ctes(PVALUES_CTE, f"SELECT feature, kind, {r('statistic', 'statistic')}, {r('p_value', 'p_value')}, "
                                 f"rank, {r('threshold', 'threshold')}, relevant FROM rel"))
def q_selection_relevance(spark, d):
    feats, targets = _features_targets(spark, d)
    return V.benjamini_yekutieli(V.feature_pvalues(comparable(feats), targets))


@register("selection_apply", "V-8",
          with_ctes(PVALUES_CTE, f"SELECT series_id, feature, {r('value', 'value')} FROM imp "
                                 "WHERE feature IN (SELECT feature FROM rel WHERE relevant)"))
def q_selection_apply(spark, d):
    feats, targets = _features_targets(spark, d)
    rel = V.benjamini_yekutieli(V.feature_pvalues(comparable(feats), targets))
    return V.select_relevant(feats, rel)


_REAL_CTE = PVALUES_CTE.replace(
    "tg AS (SELECT DISTINCT series_id, CAST(target AS DOUBLE) AS target FROM series)",
    "tg AS (SELECT series_id, max(x) AS target FROM series WHERE channel = 'x_0' GROUP BY series_id)")
assert _REAL_CTE != PVALUES_CTE


@register("selection_real_target", "V-2 V-3 V-7",
          with_ctes(_REAL_CTE, f"SELECT feature, kind, {r('statistic', 'statistic')}, {r('p_value', 'p_value')}, "
                               f"rank, {r('threshold', 'threshold')}, relevant FROM rel"))
def q_selection_real_target(spark, d):
    s = events_series(spark, d)
    return V.benjamini_yekutieli(V.feature_pvalues(comparable(_features(spark, d, s)), _feature_max(s)))


@register("selection_real_target_apply", "V-8",
          with_ctes(_REAL_CTE, f"SELECT series_id, feature, {r('value', 'value')} FROM imp "
                               "WHERE feature IN (SELECT feature FROM rel WHERE relevant)"))
def q_selection_real_target_apply(spark, d):
    s = events_series(spark, d)
    feats = _features(spark, d, s)
    return V.select_relevant(feats, V.benjamini_yekutieli(V.feature_pvalues(comparable(feats), _feature_max(s))))


@register("selection_fisher", "V-5", with_ctes(FEATURES_CTE + """,
bt AS (SELECT p.feature, p.value, p.value > min(p.value) OVER (PARTITION BY p.feature) AS hi, p.target = 0 AS one
       FROM pts p JOIN kinds k USING (feature) WHERE k.n_distinct = 2),
n AS (SELECT feature, count_if(hi AND one) AS a, count_if(hi AND NOT one) AS b, count_if(NOT hi AND one) AS c,
             count_if(NOT hi AND NOT one) AS d FROM bt GROUP BY 1),
t AS (SELECT *, unnest(range(greatest(0, b + a + a + c - (a + b + c + d) - b)::BIGINT, least(a + b, a + c)::BIGINT + 1)) AS k FROM n),
q AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS m FROM t),
l AS (SELECT *, m - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lk,
        m - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS la FROM q WHERE d - a + k >= 0)""",
                                              f"""SELECT feature, {r('any_value(CASE WHEN b * c <> 0 THEN a * d / CAST(b * c AS DOUBLE) END)', 'statistic')},
  {r('least(sum(CASE WHEN lk <= la + 1e-7 THEN exp(lk) ELSE 0 END), 1.0)', 'p_value')} FROM l GROUP BY feature"""))
def q_selection_fisher(spark, d):
    feats, targets = _features_targets(spark, d)
    feats = comparable(feats)
    binary = V.feature_kinds(feats).where("kind = 'binary'").select("feature")
    return V.fisher(feats.join(binary, "feature", "left_semi"),
                    targets.withColumn("target", (F.col("target") == 0).cast("int")))
