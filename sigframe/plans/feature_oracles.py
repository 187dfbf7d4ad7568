"""SQL oracles for the feature families (DuckDB dialect, plain windows)."""

from __future__ import annotations

from sigframe.operators.features.autocorr import AGG_MAXLAG, AGG_VAR_EPS, AUTOCORR_LAGS, VAR_EPS
from sigframe.operators.features.changes import C3_LAGS, CROSSING_M
from sigframe.operators.features.entropy import APPROXIMATE_R, SAMPLE_R
from sigframe.operators.features.distribution import LARGE_STD_R, VALUE_COUNT_VALUES
from sigframe.operators.features.naming import column_name as cn
from sigframe.plans.oracle import r

K = "series_id, channel"


def distribution_sql(src: str = "series") -> str:
    cols = [
        "count(x) AS length",
        r("sum(x)", "sum_values"), r("avg(x)", "mean"), r("min(x)", "minimum"), r("max(x)", "maximum"),
        r("var_pop(x)", "variance"), r("stddev_pop(x)", "standard_deviation"),
        r("CASE WHEN avg(x) <> 0 THEN stddev_pop(x) / avg(x) END", "variation_coefficient"),
        r("sqrt(avg(x * x))", "root_mean_square"), r("sum(x * x)", "abs_energy"),
        r("max(abs(x))", "absolute_maximum"),
        r("CASE WHEN count(x) >= 3 THEN CASE WHEN var_pop(x) = 0 THEN 0 ELSE skewness(x) END END", "skewness"),
        r("CASE WHEN count(x) >= 4 THEN CASE WHEN var_pop(x) = 0 THEN 0 ELSE kurtosis(x) END END", "kurtosis"),
        r("CAST(var_pop(x) > stddev_pop(x) AS DOUBLE)", "variance_larger_than_standard_deviation"),
        r("count_if(x > 0) / count(x)", "count_above__t_0"),
        r("count_if(x < 0) / count(x)", "count_below__t_0"),
        "CAST(count_if(x >= -1 AND x < 1) AS BIGINT) AS range_count__max_1__min_m1",
    ]
    cols += [f"CAST(count_if(x = {v}) AS BIGINT) AS {cn('value_count', value=v)}" for v in VALUE_COUNT_VALUES]
    cols += [r(f"CAST(stddev_pop(x) > {rr} * (max(x) - min(x)) AS DOUBLE)", cn("large_standard_deviation", r=rr))
             for rr in LARGE_STD_R]
    return f"SELECT {K},\n  " + ",\n  ".join(cols) + f"\nFROM {src} GROUP BY {K}"


def changes_sql(src: str = "series") -> str:
    halo = 2 * max(C3_LAGS)
    leads = ", ".join(f"lead(x, {k}) OVER w AS x{k}" for k in range(1, halo + 1))
    d = "(x1 - x)"
    cid = f"sqrt(coalesce(sum({d} * {d}), 0))"
    cols = [
        r(f"coalesce(sum(abs({d})), 0)", "absolute_sum_of_changes"),
        r(f"avg(abs({d}))", "mean_abs_change"),
        r(f"avg({d})", "mean_change"),
        r("avg((x2 - 2 * x1 + x) / 2)", "mean_second_derivative_central"),
        r(cid, "cid_ce__normalize_False"),
        r(f"CASE WHEN stddev_pop(x) <> 0 THEN {cid} / stddev_pop(x) ELSE 0 END", "cid_ce__normalize_True"),
    ]
    cols += [f"CAST(count_if(x1 IS NOT NULL AND ((x > {m}) <> (x1 > {m}))) AS BIGINT) AS {cn('number_crossing_m', m=m)}"
             for m in CROSSING_M]
    for lag in C3_LAGS:
        xl, x2l = f"x{lag}", f"x{2 * lag}"
        cols.append(r(f"coalesce(avg({x2l} * {xl} * x), 0)", cn("c3", lag=lag)))
        cols.append(r(f"coalesce(avg(CASE WHEN {x2l} IS NOT NULL THEN {x2l} * {x2l} * {xl} - {xl} * x * x END), 0)",
                      cn("time_reversal_asymmetry_statistic", lag=lag)))
    return (f"SELECT {K},\n  " + ",\n  ".join(cols) +
            f"\nFROM (SELECT series_id, channel, x, {leads} FROM {src} "
            f"WINDOW w AS (PARTITION BY series_id, channel ORDER BY t)) GROUP BY {K}")


def autocorrelation_sql(src: str = "series") -> str:
    maxlag = max(max(AUTOCORR_LAGS), AGG_MAXLAG)
    acf_cols = [r(f"max(CASE WHEN k = {k} THEN acf END)", cn("autocorrelation", lag=k)) for k in AUTOCORR_LAGS]
    return f"""
SELECT st.series_id, st.channel, {", ".join(acf_cols)},
  {r("CASE WHEN st.v < %g OR st.n = 1 THEN 0 ELSE avg(CASE WHEN k BETWEEN 1 AND %d THEN coalesce(acf, 0) END) END" % (AGG_VAR_EPS, AGG_MAXLAG), cn("agg_autocorrelation", f_agg="mean", maxlag=AGG_MAXLAG))},
  {r("CASE WHEN st.v < %g OR st.n = 1 THEN 0 ELSE median(CASE WHEN k BETWEEN 1 AND %d THEN coalesce(acf, 0) END) END" % (AGG_VAR_EPS, AGG_MAXLAG), cn("agg_autocorrelation", f_agg="median", maxlag=AGG_MAXLAG))},
  {r("CASE WHEN st.v < %g OR st.n = 1 THEN 0 ELSE var_pop(CASE WHEN k BETWEEN 1 AND %d THEN coalesce(acf, 0) END) END" % (AGG_VAR_EPS, AGG_MAXLAG), cn("agg_autocorrelation", f_agg="var", maxlag=AGG_MAXLAG))}
FROM (SELECT {K}, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM {src} GROUP BY {K}) st
LEFT JOIN (
  SELECT a.series_id, a.channel, l.k,
         CASE WHEN s.v >= {VAR_EPS} THEN sum((a.x - s.m) * (b.x - s.m)) / ((s.n - l.k) * s.v) END AS acf
  FROM {src} a
  CROSS JOIN range(0, {maxlag + 1}) l(k)
  JOIN {src} b ON b.series_id = a.series_id AND b.channel = a.channel AND b.t = a.t - l.k
  JOIN (SELECT {K}, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM {src} GROUP BY {K}) s
    ON s.series_id = a.series_id AND s.channel = a.channel
  GROUP BY a.series_id, a.channel, l.k, s.n, s.v
) p ON p.series_id = st.series_id AND p.channel = st.channel
GROUP BY st.series_id, st.channel, st.n, st.v"""


# ---------------------------------------------------------------- quantiles
from sigframe.operators.features.location import (  # noqa: E402
    BENFORD, BEYOND_SIGMA_R, ENERGY_SEGMENTS, ENTROPY_BINS)
from sigframe.operators.features.ordered import (  # noqa: E402
    MASS_QUANTILES, N_ABS_MAX, PEAK_SUPPORTS, PERMUTATION_DIMS)
from sigframe.operators.features.quantiles import QUANTILES, SYMMETRY_R  # noqa: E402


def quantiles_sql(src: str = "series") -> str:
    cols = [r("quantile_cont(x, 0.5)", "median")]
    cols += [r(f"quantile_cont(x, {q})", cn("quantile", q=q)) for q in QUANTILES]
    cols += [r(f"CAST(abs(avg(x) - quantile_cont(x, 0.5)) < {rr} * (max(x) - min(x)) AS DOUBLE)",
               cn("symmetry_looking", r=rr)) for rr in SYMMETRY_R]
    return f"SELECT {K},\n  " + ",\n  ".join(cols) + f"\nFROM {src} WHERE NOT isnan(x) GROUP BY {K}"


# ----------------------------------------------------------------- location
def _chunk_sql(t: str, n: str, segs: int) -> str:
    q = f"floor({n} / {segs})"
    rem = f"({n} - {q} * {segs})"
    big = f"({rem} * ({q} + 1))"
    return f"(CASE WHEN {t} < {big} THEN floor({t} / ({q} + 1)) ELSE {rem} + floor(({t} - {big}) / greatest({q}, 1)) END)"


def _bin_sql(x: str, mn: str, mx: str, bins: int) -> str:
    width = f"({mx} - {mn})"
    raw = f"floor(({x} - {mn}) * ({float(bins)} / {width}))"
    idx = f"least({raw}, {bins - 1})"
    edge = lambda i: f"({mn} + ({i}) * ({width} / {bins}))"
    idx = f"(CASE WHEN {x} < {edge(idx)} THEN {idx} - 1 ELSE {idx} END)"
    return f"(CASE WHEN {x} >= {edge(idx + ' + 1')} AND {idx} <> {bins - 1} THEN {idx} + 1 ELSE {idx} END)"


def _digit_sql(x: str) -> str:
    a = f"abs({x})"
    d = f"floor({a} / pow(10.0, floor(log10({a}))))"
    return f"(CASE WHEN {a} = 0 THEN 0 WHEN {d} >= 10 THEN 1 WHEN {d} < 1 THEN 9 ELSE {d} END)"


def location_sql(src: str = "series") -> str:
    st = (f"SELECT {K}, count(x) AS n, avg(x) AS m, stddev_pop(x) AS s, max(x) AS mx, min(x) AS mn, "
          f"sum(x * x) AS e FROM {src} GROUP BY {K}")
    j = (f"SELECT a.*, st.n, st.m, st.s, st.mx, st.mn, st.e, {_chunk_sql('a.t', 'st.n', ENERGY_SEGMENTS)} AS chunk, "
         f"{_digit_sql('a.x')} AS digit, CASE WHEN st.mx > st.mn THEN {_bin_sql('a.x', 'st.mn', 'st.mx', ENTROPY_BINS)} "
         f"ELSE 0 END AS bin FROM {src} a JOIN ({st}) st USING ({K})")
    cols = ["CAST(count_if(x > m) AS BIGINT) AS count_above_mean", "CAST(count_if(x < m) AS BIGINT) AS count_below_mean",
            r("min(CASE WHEN x = mx THEN t END) / any_value(n)", "first_location_of_maximum"),
            r("(max(CASE WHEN x = mx THEN t END) + 1) / any_value(n)", "last_location_of_maximum"),
            r("min(CASE WHEN x = mn THEN t END) / any_value(n)", "first_location_of_minimum"),
            r("(max(CASE WHEN x = mn THEN t END) + 1) / any_value(n)", "last_location_of_minimum")]
    cols += [r(f"count_if(abs(x - m) > {rr} * s) / any_value(n)", cn("ratio_beyond_r_sigma", r=rr))
             for rr in BEYOND_SIGMA_R]
    cols += [r(f"coalesce(sum(CASE WHEN chunk = {i} THEN x * x END), 0) / nullif(any_value(e), 0)",
               cn("energy_ratio_by_chunks", num_segments=ENERGY_SEGMENTS, segment_focus=i))
             for i in range(ENERGY_SEGMENTS)]
    cols += [f"count_if(digit = {d}) / any_value(n) AS p{d}" for d in range(1, 10)]
    p = [f"p{d}" for d in range(1, 10)]
    pbar = "((" + " + ".join(p) + ") / 9.0)"
    bbar = sum(BENFORD) / 9.0
    cov = " + ".join(f"({p[i]} - {pbar}) * {BENFORD[i] - bbar!r}" for i in range(9))
    vp = " + ".join(f"({p[i]} - {pbar}) * ({p[i]} - {pbar})" for i in range(9))
    vb = sum((b - bbar) ** 2 for b in BENFORD)
    ent = (f"SELECT {K}, -sum(c / n * ln(c / n)) AS h FROM (SELECT {K}, bin, count(*) AS c, any_value(n) AS n "
           f"FROM j GROUP BY {K}, bin) GROUP BY {K}")
    keep = [c.split(" AS ")[-1] for c in cols if not c.split(" AS ")[-1].startswith("p")]
    return f"""
WITH j AS ({j}),
base AS (SELECT {K}, {", ".join(cols)} FROM j GROUP BY {K})
SELECT base.series_id, base.channel, {", ".join("base." + c for c in keep)},
  {r(f"CASE WHEN ({vp}) > 0 THEN ({cov}) / sqrt(({vp}) * {vb!r}) END", "benford_correlation")},
  {r("ent.h", cn("binned_entropy", max_bins=ENTROPY_BINS))}
FROM base JOIN ({ent}) ent USING ({K})"""


# -------------------------------------------------------------- reoccurrence
def reoccurrence_sql(src: str = "series") -> str:
    return f"""
SELECT {K},
  CAST(count(*) < sum(c) AS DOUBLE) AS has_duplicate,
  CAST(arg_max(c, x) > 1 AS DOUBLE) AS has_duplicate_max,
  CAST(arg_min(c, x) > 1 AS DOUBLE) AS has_duplicate_min,
  {r("count_if(c > 1) / count(*)", "percentage_of_reoccurring_values_to_all_values")},
  {r("coalesce(sum(CASE WHEN c > 1 THEN c END), 0) / sum(c)", "percentage_of_reoccurring_datapoints_to_all_datapoints")},
  {r("coalesce(sum(CASE WHEN c > 1 THEN x END), 0)", "sum_of_reoccurring_values")},
  {r("coalesce(sum(CASE WHEN c > 1 THEN x * c END), 0)", "sum_of_reoccurring_data_points")},
  {r("count(*) / sum(c)", "ratio_value_number_to_time_series_length")}
FROM (SELECT {K}, x, count(*) AS c FROM {src} WHERE x IS NOT NULL GROUP BY {K}, x) GROUP BY {K}"""


# ------------------------------------------------------------------- ordered
def ordered_sql(src: str = "series") -> str:
    st = f"SELECT {K}, count(x) AS n, avg(x) AS m, sum(abs(x)) AS tot FROM {src} GROUP BY {K}"
    strikes = []
    for name, op in (("above", ">"), ("below", "<")):
        strikes.append(f"""s_{name} AS (
  SELECT {K}, max(len) AS longest FROM (
    SELECT {K}, g, count(*) AS len FROM (
      SELECT a.series_id, a.channel, a.t - row_number() OVER (PARTITION BY a.series_id, a.channel ORDER BY a.t) AS g
      FROM {src} a JOIN st USING ({K}) WHERE a.x {op} st.m) GROUP BY {K}, g) GROUP BY {K})""")
    h = max(PEAK_SUPPORTS)
    peak_cols = []
    for n in PEAK_SUPPORTS:
        lw = f"(PARTITION BY {K} ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        rw = f"(PARTITION BY {K} ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
        peak_cols.append(f"(count(x) OVER {lw} = {n} AND count(x) OVER {rw} = {n} AND x > max(x) OVER {lw} "
                         f"AND x > max(x) OVER {rw}) AS p{n}")
    peaks = (f"pk AS (SELECT {K}, " + ", ".join(f"CAST(count_if(p{n}) AS BIGINT) AS {cn('number_peaks', n=n)}" for n in PEAK_SUPPORTS)
             + f" FROM (SELECT {K}, " + ", ".join(peak_cols) + f" FROM {src}) GROUP BY {K})")
    mass = (f"ms AS (SELECT {K}, " + ", ".join(
        r(f"CASE WHEN any_value(tot) <> 0 THEN (min(CASE WHEN run / tot >= {q} THEN t END) + 1) / any_value(n) END",
          cn("index_mass_quantile", q=q)) for q in MASS_QUANTILES)
        + f" FROM (SELECT a.*, st.n, st.tot, sum(abs(a.x)) OVER (PARTITION BY a.series_id, a.channel ORDER BY a.t "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {src} a JOIN st USING ({K})) GROUP BY {K})")
    hd = max(PERMUTATION_DIMS) - 1
    leads = ", ".join(f"lead(x, {k}) OVER (PARTITION BY {K} ORDER BY t) AS x{k}" for k in range(1, hd + 1))
    pats = []
    for d in PERMUTATION_DIMS:
        vals = ["x"] + [f"x{k}" for k in range(1, d)]
        structs = ", ".join(f"{{'v': {v}, 'i': {i}}}" for i, v in enumerate(vals))
        pats.append(f"SELECT {K}, {d} AS d, array_to_string(list_transform(list_sort([{structs}]), lambda s: s.i), '') AS pat "
                    f"FROM lx WHERE x{d - 1} IS NOT NULL")
    perm = f"""lx AS (SELECT {K}, x, {leads} FROM {src}),
pc AS (SELECT {K}, d, pat, count(*) AS c FROM ({" UNION ALL ".join(pats)}) GROUP BY {K}, d, pat),
pe AS (SELECT {K}, d, -sum(c / tot * ln(c / tot)) AS h FROM (
         SELECT pc.*, sum(c) OVER (PARTITION BY {K}, d) AS tot FROM pc) GROUP BY {K}, d),
pw AS (SELECT k.series_id, k.channel, {", ".join(r(f"max(CASE WHEN d = {d} THEN h END)", cn("permutation_entropy", dimension=d, tau=1)) for d in PERMUTATION_DIMS)}
       FROM (SELECT DISTINCT {K} FROM {src}) k LEFT JOIN pe USING ({K}) GROUP BY k.series_id, k.channel)"""
    nmax = (f"nm AS (SELECT st.series_id, st.channel, "
            + r(f"CASE WHEN st.n > {N_ABS_MAX} THEN v END", cn("mean_n_absolute_max", number_of_maxima=N_ABS_MAX))
            + f" FROM st JOIN (SELECT {K}, avg(a) AS v FROM (SELECT {K}, abs(x) AS a, row_number() OVER "
              f"(PARTITION BY {K} ORDER BY abs(x) DESC, t) AS rk FROM {src}) WHERE rk <= {N_ABS_MAX} GROUP BY {K}) tk "
              f"USING ({K}))")
    ctes = ",\n".join([f"st AS ({st})", *strikes, peaks, mass, perm, nmax])
    return f"""
WITH {ctes}
SELECT st.series_id, st.channel,
  CAST(coalesce(s_above.longest, 0) AS BIGINT) AS longest_strike_above_mean,
  CAST(coalesce(s_below.longest, 0) AS BIGINT) AS longest_strike_below_mean,
  {", ".join("pk." + cn("number_peaks", n=n) for n in PEAK_SUPPORTS)},
  {", ".join("ms." + cn("index_mass_quantile", q=q) for q in MASS_QUANTILES)},
  {", ".join("pw." + cn("permutation_entropy", dimension=d, tau=1) for d in PERMUTATION_DIMS)},
  nm.{cn("mean_n_absolute_max", number_of_maxima=N_ABS_MAX)}
FROM st LEFT JOIN s_above USING ({K}) LEFT JOIN s_below USING ({K}) JOIN pk USING ({K}) JOIN ms USING ({K})
JOIN pw USING ({K}) JOIN nm USING ({K})"""


# --------------------------------------------------------------------- trend
import math  # noqa: E402

from sigframe.operators.features.spectral import CWT_COEFFS, CWT_WIDTHS, FFT_COEFFS  # noqa: E402
from sigframe.operators.features.trend import AGG_CHUNKS, AGG_FUNCS, CHANGE_Q  # noqa: E402
from sigframe.plans.oracle import normal_p_sql, rs  # noqa: E402


def _reg_sql(y: str, x: str, n: str) -> dict[str, str]:
    r_ = (f"(CASE WHEN var_pop({y}) > 0 AND var_pop({x}) > 0 THEN covar_pop({y}, {x}) / "
          f"sqrt(var_pop({y}) * var_pop({x})) END)")
    df = f"({n} - 2)"
    tstat = f"({r_} * sqrt({df} / ((1 - {r_}) * (1 + {r_}))))"
    return {
        "slope": f"regr_slope({y}, {x})", "intercept": f"regr_intercept({y}, {x})", "rvalue": r_,
        "stderr": f"(CASE WHEN {df} > 0 THEN sqrt(greatest(1 - {r_} * {r_}, 0.0) * var_pop({y}) / var_pop({x}) / {df}) END)",
        "pvalue": f"(CASE WHEN {df} > 0 THEN CASE WHEN abs({r_}) < 1 THEN {normal_p_sql(tstat)} ELSE 0.0 END END)",
    }


def trend_sql(src: str = "series") -> str:
    reg = _reg_sql("x", "CAST(t AS DOUBLE)", "count(x)")
    lt = f"lt AS (SELECT {K}, " + ", ".join(r(reg[a], cn("linear_trend", attr=a)) for a in
                                             ("pvalue", "rvalue", "intercept", "slope", "stderr")) + \
         f" FROM {src} GROUP BY {K})"
    alts, names = [], []
    for c in AGG_CHUNKS:
        cols = []
        for f in AGG_FUNCS:
            rg = _reg_sql(f'"{f}"', "CAST(ch AS DOUBLE)", "count(*)")
            for a in ("rvalue", "intercept", "slope", "stderr"):
                nm = cn("agg_linear_trend", attr=a, chunk_len=c, f_agg=f)
                names.append(f"a{c}.{nm}")
                cols.append(r(f"CASE WHEN count(*) > 1 THEN {rg[a]} END", nm))
        alts.append(f"a{c} AS (SELECT {K}, {', '.join(cols)} FROM (SELECT {K}, floor(t / {c}) AS ch, max(x) AS \"max\", "
                    f"min(x) AS \"min\", avg(x) AS \"mean\", var_pop(x) AS \"var\" FROM {src} GROUP BY {K}, ch) "
                    f"GROUP BY {K})")
    d, l_ = "(x - l)", "l"
    sxx, syy, sxy = f"regr_sxx({d}, {l_})", f"regr_syy({d}, {l_})", f"regr_sxy({d}, {l_})"
    resid = f"(({syy} - {sxy} * {sxy} / {sxx}) / (count(*) - 2))"
    stat = (f"CASE WHEN count(*) > 2 AND {sxx} > 0 AND {resid} > 0 THEN ({sxy} / {sxx}) / sqrt({resid} / {sxx}) END")
    dfq = (f"dfu AS (SELECT {K}, {r(stat, 'augmented_dickey_fuller__attr_teststat')} FROM (SELECT {K}, x, "
           f"lag(x) OVER (PARTITION BY {K} ORDER BY t) AS l FROM {src}) WHERE l IS NOT NULL GROUP BY {K})")
    lt_names = [f"lt.{cn('linear_trend', attr=a)}" for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")]
    joins = " ".join(f"JOIN a{c} USING ({K})" for c in AGG_CHUNKS)
    return (f"WITH {lt}, {', '.join(alts)}, {dfq}\nSELECT lt.series_id, lt.channel, {', '.join(lt_names + names)}, "
            f"dfu.augmented_dickey_fuller__attr_teststat FROM lt {joins} LEFT JOIN dfu USING ({K})")


def change_quantiles_sql(src: str = "series") -> str:
    qcols = ", ".join(f"quantile_cont(x, {q}) AS q{i}" for i, q in enumerate(CHANGE_Q))
    cols = []
    for i, ql in enumerate(CHANGE_Q):
        for k, qh in enumerate(CHANGE_Q):
            if ql >= qh:
                continue
            inside = f"(q{i} < q{k} AND x >= q{i} AND x <= q{k} AND x1 >= q{i} AND x1 <= q{k})"
            for isabs in (False, True):
                d = "abs(x1 - x)" if isabs else "(x1 - x)"
                for f in ("mean", "var"):
                    fn = "avg" if f == "mean" else "var_pop"
                    cols.append(r(f"coalesce({fn}(CASE WHEN {inside} THEN {d} END), 0)",
                                  cn("change_quantiles", f_agg=f, isabs=isabs, qh=qh, ql=ql)))
    names = [c.split(" AS ")[-1] for c in cols]
    return f"""
WITH ed AS (SELECT {K}, {qcols} FROM {src} WHERE NOT isnan(x) GROUP BY {K}),
cq AS (SELECT {K}, {", ".join(cols)} FROM (
  SELECT a.*, ed.* EXCLUDE (series_id, channel), lead(a.x) OVER (PARTITION BY a.series_id, a.channel ORDER BY a.t) AS x1
  FROM {src} a LEFT JOIN ed USING ({K})) WHERE x1 IS NOT NULL GROUP BY {K})
SELECT k.series_id, k.channel, {", ".join(f"coalesce(cq.{n}, 0.0) AS {n}" for n in names)}
FROM (SELECT DISTINCT {K} FROM {src}) k LEFT JOIN cq USING ({K})"""


def fft_sql(src: str = "series") -> str:
    two_pi = repr(2 * math.pi)
    arg = f"({two_pi} * ((k.coeff * a.t) % nn.n) / nn.n)"
    return f"""
SELECT series_id, channel, coeff, {r('re', 'real')}, {r('im', 'imag')}, {r('sqrt(re * re + im * im)', 'abs')},
  {r(f"degrees(atan2({rs('im')}, {rs('re')}))", 'angle')}
FROM (SELECT a.series_id, a.channel, k.coeff, sum(a.x * cos({arg})) AS re, -sum(a.x * sin({arg})) AS im
      FROM {src} a JOIN (SELECT {K}, count(x) AS n FROM {src} GROUP BY {K}) nn USING ({K})
      CROSS JOIN range(0, {FFT_COEFFS}) k(coeff)
      WHERE k.coeff <= floor(nn.n / 2) GROUP BY a.series_id, a.channel, k.coeff)"""


def cwt_sql(src: str = "series") -> str:
    widths = ", ".join(f"({w})" for w in CWT_WIDTHS)
    a = "CAST(w AS DOUBLE)"
    amp = f"(2.0 / (sqrt({a} * 3.0) * {math.pi ** 0.25!r}))"
    v = "(m - (L - 1) / 2.0)"
    ricker = f"({amp} * (1 - {v} * {v} / ({a} * {a})) * exp(-{v} * {v} / (2 * {a} * {a})))"
    return f"""
SELECT series_id, channel, w, coeff, {r(f'sum(x * {ricker})', 'value')}
FROM (SELECT b.*, c.coeff, c.coeff + h - b.t AS m FROM (
        SELECT a.series_id, a.channel, a.t, a.x, nn.n, CAST(ww.w AS BIGINT) AS w, least(ww.w * 10, nn.n) AS L,
               floor((least(ww.w * 10, nn.n) - 1) / 2) AS h
        FROM {src} a JOIN (SELECT {K}, count(x) AS n FROM {src} GROUP BY {K}) nn USING ({K})
        CROSS JOIN (VALUES {widths}) ww(w)) b
      CROSS JOIN range(0, {CWT_COEFFS}) c(coeff)
      WHERE coeff < n AND coeff + h - t >= 0 AND coeff + h - t < L)
GROUP BY series_id, channel, w, coeff"""


def welch_sql(src: str = "series") -> str:
    from sigframe.operators.features.spectral import WELCH_COEFFS, WELCH_MAX_SEGMENT

    two_pi = repr(2 * math.pi)
    lg = f"least(nn.n, {WELCH_MAX_SEGMENT})"
    coeffs = ", ".join(f"({c})" for c in WELCH_COEFFS)
    cols = ", ".join(r(f"max(CASE WHEN coeff = {c} THEN v END)", cn("spkt_welch_density", coeff=c)) for c in WELCH_COEFFS)
    return f"""
WITH wj AS (SELECT a.*, {lg} AS L, {lg} - floor({lg} / 2) AS step,
                   floor((nn.n - floor({lg} / 2)) / ({lg} - floor({lg} / 2))) AS S
            FROM {src} a JOIN (SELECT {K}, count(x) AS n FROM {src} GROUP BY {K}) nn USING ({K})),
wsg AS (SELECT wj.*, u.seg FROM wj, unnest([floor(t / step) - 1, floor(t / step)]) AS u(seg)
        WHERE u.seg >= 0 AND u.seg < S AND t - u.seg * step < L),
wr AS (SELECT wsg.*, t - seg * step AS jj, c.coeff FROM wsg CROSS JOIN (VALUES {coeffs}) c(coeff)),
wv AS (SELECT *, 0.5 - 0.5 * cos({two_pi} * jj / L) AS w, {two_pi} * ((jj * coeff) % L) / L AS arg FROM wr),
wp AS (SELECT {K}, seg, coeff, sum(x * w * cos(arg)) AS xc, sum(x * w * sin(arg)) AS xs, sum(x) AS sx,
              sum(w * cos(arg)) AS wc, sum(w * sin(arg)) AS ws, sum(w * w) AS w2, any_value(L) AS L
       FROM wv GROUP BY {K}, seg, coeff),
wd AS (SELECT {K}, coeff, avg(CASE WHEN w2 > 0 AND coeff <= floor(L / 2) THEN
          ((xc - sx / L * wc) * (xc - sx / L * wc) + (xs - sx / L * ws) * (xs - sx / L * ws)) / w2
          * CASE WHEN coeff = 0 OR (L % 2 = 0 AND coeff = floor(L / 2)) THEN 1.0 ELSE 2.0 END END) AS v
       FROM wp GROUP BY {K}, coeff)
SELECT {K}, {cols} FROM wd GROUP BY {K}"""


def pacf_sql(src: str = "series") -> str:
    """Durbin–Levinson as a recursive CTE over the adjusted autocorrelations."""
    from sigframe.operators.features.autocorr import AR_ORDER, PACF_LAGS

    kmax = max(max(PACF_LAGS), AR_ORDER)
    rho = "[" + ", ".join(f"max(CASE WHEN k = {k} THEN acf END)" for k in range(1, kmax + 1)) + "]"
    kk = ("(rh.rho[d.k + 1] - list_sum(list_transform(range(1, d.k + 1), lambda j: d.phi[j] * rh.rho[d.k + 1 - j])))"
          " / (1 - list_sum(list_transform(range(1, d.k + 1), lambda j: d.phi[j] * rh.rho[j])))")
    pacf_cols = [r("1.0", cn("partial_autocorrelation", lag=0))]
    pacf_cols += [r(f"pacf[{k}]", cn("partial_autocorrelation", lag=k)) for k in range(1, max(PACF_LAGS) + 1)]
    ar_cols = [r("m * (1 - list_sum(phi))", cn("ar_coefficient", coeff=0, k=AR_ORDER))]
    ar_cols += [r(f"phi[{c}]", cn("ar_coefficient", coeff=c, k=AR_ORDER)) for c in range(1, AR_ORDER + 1)]
    return f"""
WITH RECURSIVE st AS (SELECT {K}, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM {src} GROUP BY {K}),
ac AS (SELECT a.series_id, a.channel, l.k,
              CASE WHEN s.v >= {VAR_EPS} AND s.n > l.k THEN sum((a.x - s.m) * (b.x - s.m)) / ((s.n - l.k) * s.v) END AS acf
       FROM {src} a CROSS JOIN range(1, {kmax + 1}) l(k)
       JOIN {src} b ON b.series_id = a.series_id AND b.channel = a.channel AND b.t = a.t - l.k
       JOIN st s ON s.series_id = a.series_id AND s.channel = a.channel
       GROUP BY a.series_id, a.channel, l.k, s.n, s.v),
rh AS (SELECT st.series_id, st.channel, st.m, CAST({rho} AS DOUBLE[]) AS rho
       FROM st LEFT JOIN ac USING ({K}) GROUP BY st.series_id, st.channel, st.m),
dl(series_id, channel, k, phi, pacf) AS (
  SELECT series_id, channel, 1, CAST([rho[1]] AS DOUBLE[]), CAST([rho[1]] AS DOUBLE[]) FROM rh
  UNION ALL
  SELECT d.series_id, d.channel, d.k + 1,
         list_concat(list_transform(range(1, d.k + 1), lambda j: d.phi[j] - {kk} * d.phi[d.k + 1 - j]), [{kk}]),
         list_concat(d.pacf, [{kk}])
  FROM dl d JOIN rh ON rh.series_id = d.series_id AND rh.channel = d.channel WHERE d.k < {kmax})
SELECT dl.series_id, dl.channel, {", ".join(pacf_cols)}, {", ".join(ar_cols)}
FROM dl JOIN rh USING ({K}) WHERE dl.k = {kmax}"""


def fft_aggregated_sql(src: str = "series") -> str:
    two_pi = repr(2 * math.pi)
    arg = f"({two_pi} * ((k.coeff * a.t) % nn.n) / nn.n)"
    cols = [r("m1", cn("fft_aggregated", aggtype="centroid")), r("var", cn("fft_aggregated", aggtype="variance")),
            r("CASE WHEN var >= 0.5 THEN (m3 - 3 * m1 * var - m1 * m1 * m1) / pow(var, 1.5) END", cn("fft_aggregated", aggtype="skew")),
            r("CASE WHEN var >= 0.5 THEN (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * pow(m1, 4)) / (var * var) END",
              cn("fft_aggregated", aggtype="kurtosis"))]
    moments = ", ".join(f"CASE WHEN sum(w) > 0 THEN sum(w * pow(coeff, {p})) / sum(w) END AS m{p}" for p in (1, 2, 3, 4))
    return f"""
SELECT {K}, {", ".join(cols)}
FROM (SELECT *, m2 - m1 * m1 AS var FROM (SELECT {K}, {moments} FROM
  (SELECT series_id, channel, coeff, sqrt(re * re + im * im) AS w FROM
    (SELECT a.series_id, a.channel, k.coeff, sum(a.x * cos({arg})) AS re, -sum(a.x * sin({arg})) AS im
     FROM {src} a JOIN (SELECT {K}, count(x) AS n FROM {src} GROUP BY {K}) nn USING ({K})
     JOIN range(0, (SELECT max(n) FROM (SELECT count(*) AS n FROM {src} GROUP BY {K}))) k(coeff) ON k.coeff <= floor(nn.n / 2)
     GROUP BY a.series_id, a.channel, k.coeff)) GROUP BY {K}))"""


def entropy_sql(src: str = "series") -> str:
    rs_ = ", ".join(f"({v})" for v in (SAMPLE_R, *APPROXIMATE_R))
    cols = [r(f"CASE WHEN len <= 3 THEN 0 ELSE max(CASE WHEN r = {v} THEN abs(l2 / n2 - ln(n2) - l3 / n3 + ln(n3)) END) END",
              cn("approximate_entropy", m=2, r=v)) for v in APPROXIMATE_R]
    cols.append(r(f"max(CASE WHEN r = {SAMPLE_R} AND s3 > n3 AND s2 > n2 THEN -ln((s3 - n3) / (s2 - n2)) END)", "sample_entropy"))
    return f"""WITH sd AS (SELECT {K}, stddev_pop(x) AS sdev, CAST(count(*) AS DOUBLE) AS len FROM {src} GROUP BY {K}),
tpl AS (SELECT {K}, t, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c FROM {src}
        WINDOW w AS (PARTITION BY {K} ORDER BY t)),
mat AS (SELECT p.series_id, p.channel, p.t, rr.r, any_value(p.c) AS c, CAST(count(*) AS DOUBLE) AS c2,
          CAST(count_if(abs(p.c - q.c) <= rr.r * sdev) AS DOUBLE) AS c3
        FROM tpl p JOIN tpl q ON p.series_id = q.series_id AND p.channel = q.channel
        JOIN sd ON sd.series_id = p.series_id AND sd.channel = p.channel CROSS JOIN (VALUES {rs_}) rr(r)
        WHERE p.b IS NOT NULL AND q.b IS NOT NULL AND abs(p.a - q.a) <= rr.r * sdev AND abs(p.b - q.b) <= rr.r * sdev
        GROUP BY p.series_id, p.channel, p.t, rr.r),
per AS (SELECT {K}, r, CAST(count(*) AS DOUBLE) AS n2, sum(ln(c2)) AS l2, sum(c2) AS s2, CAST(count(c) AS DOUBLE) AS n3,
          sum(CASE WHEN c IS NOT NULL THEN ln(c3) END) AS l3, sum(CASE WHEN c IS NOT NULL THEN c3 END) AS s3 FROM mat GROUP BY {K}, r)
SELECT sd.series_id, sd.channel, {", ".join(cols)}
FROM sd LEFT JOIN per ON per.series_id = sd.series_id AND per.channel = sd.channel GROUP BY sd.series_id, sd.channel, len"""
