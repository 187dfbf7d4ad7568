"""Registered queries: series numbering, run concatenation, smoothing,
reshape, key-value export and table profiles."""

from __future__ import annotations

from sigframe.operators import series as S
from sigframe.operators.series import savgol_weights
from sigframe.plans.oracle import EVENTS_CTE, SERIES_CTE, r, with_ctes
from sigframe.plans.q_series import events_series
from sigframe.plans.registry import register
from sigframe.sources.standins import series_from_events
from sigframe.sources.tables import kv_rows, load, profile, shape

SAVGOL_WINDOW, SAVGOL_POLY = 5, 2
MEDIAN_KERNEL = 3
KV_CELL_POINTS = 4096


@register("series_numbered", "W-3 A-6 J-7",
          with_ctes(SERIES_CTE, "SELECT subject, target, dense_rank() OVER (ORDER BY subject, target) - 1 AS series_no "
                                "FROM (SELECT DISTINCT subject, target FROM series)"))
def q_series_numbered(spark, d):
    return S.number_series(events_series(spark, d))


@register("series_runs_concatenated", "W-5 U-1",
          with_ctes(EVENTS_CTE + """,
idx AS (SELECT *, row_number() OVER (PARTITION BY subject, target
          ORDER BY CASE WHEN run = 'LR' THEN 0 ELSE 1 END, ts, event_id) - 1 AS t FROM ev)""",
                    f"""SELECT CAST(subject AS BIGINT) * 100 + target AS series_id, subject, target, 'x_0' AS channel, t,
  {r('x_0', 'x')} FROM idx UNION ALL
SELECT CAST(subject AS BIGINT) * 100 + target, subject, target, 'x_1', t, {r('x_1', 'x')} FROM idx"""))
def q_series_runs(spark, d):
    return series_from_events(load(spark, d, "events"), runs_concatenated=True)


@register("series_median_smoothed", "W-6",
          with_ctes(SERIES_CTE, f"""SELECT series_id, subject, target, channel, t,
  {r(f"list_sort(list_concat(list(x) OVER w, list_resize([]::DOUBLE[], {MEDIAN_KERNEL} - count(*) OVER w, 0.0)))"
     f"[{MEDIAN_KERNEL // 2 + 1}]", 'x')}
FROM series WINDOW w AS (PARTITION BY series_id, channel ORDER BY t
  ROWS BETWEEN {MEDIAN_KERNEL // 2} PRECEDING AND {MEDIAN_KERNEL // 2} FOLLOWING)"""))
def q_series_median(spark, d):
    return S.median_smooth(events_series(spark, d), MEDIAN_KERNEL)


def _savgol_sql() -> str:
    w, h = SAVGOL_WINDOW, SAVGOL_WINDOW // 2
    wts = savgol_weights(w, SAVGOL_POLY)
    at = {0: "x"}
    for j in range(1, w):
        at[j] = f"lead(x, {j}) OVER o"
        at[-j] = f"lag(x, {j}) OVER o"

    def comb(row: int, anchor: int) -> str:
        # output row ``row`` of a window starting ``anchor`` points before t
        terms = [f"{float(wts[row][k])!r} * {at[k - anchor]}" for k in range(w)]
        return "(" + " + ".join(terms) + ")"
    expr = comb(h, h)
    for i in range(h):
        expr = f"CASE WHEN t = {i} THEN {comb(i, i)} ELSE {expr} END"
    for i in range(h):
        rr = w - 1 - i
        expr = f"CASE WHEN t = n - 1 - {i} THEN {comb(rr, rr)} ELSE {expr} END"
    return with_ctes(SERIES_CTE, f"""SELECT series_id, subject, target, channel, t,
  {r(f"CASE WHEN n >= {w} THEN {expr} ELSE x END", 'x')}
FROM (SELECT *, count(*) OVER (PARTITION BY series_id, channel) AS n FROM series)
WINDOW o AS (PARTITION BY series_id, channel ORDER BY t)""")


@register("series_savgol_smoothed", "W-7", _savgol_sql())
def q_series_savgol(spark, d):
    return S.savgol_smooth(events_series(spark, d), SAVGOL_WINDOW, SAVGOL_POLY)


@register("series_wide", "P-15",
          with_ctes(SERIES_CTE, f"""SELECT series_id, subject, target, t,
  {r("max(CASE WHEN channel = 'x_0' THEN x END)", 'x_0')}, {r("max(CASE WHEN channel = 'x_1' THEN x END)", 'x_1')}
FROM series GROUP BY series_id, subject, target, t"""))
def q_series_wide(spark, d):
    return S.to_wide(events_series(spark, d), ["x_0", "x_1"])


@register("series_kv_export", "S-9",
          with_ctes(SERIES_CTE, f"""SELECT 'HCP_' || CAST(subject AS VARCHAR) || '_' || CAST(target AS VARCHAR) AS rowkey,
  q0.qualifier, CASE q0.qualifier WHEN 'data:person' THEN CAST(s.subject AS VARCHAR)
                WHEN 'data:dataset' THEN 'HCP' ELSE 'events' END AS value
FROM (SELECT DISTINCT subject, target FROM series) s
CROSS JOIN (VALUES ('data:person'), ('data:dataset'), ('data:atlas')) q0(qualifier)
UNION ALL
SELECT 'HCP_' || CAST(subject AS VARCHAR) || '_' || CAST(target AS VARCHAR),
       'data:roi:' || channel || ':' || CAST(blk AS VARCHAR),
       '{{' || string_agg('"' || CAST(t AS VARCHAR) || '":' || CAST(x AS VARCHAR), ',' ORDER BY t) || '}}'
FROM (SELECT *, CAST(floor(t / {KV_CELL_POINTS}) AS BIGINT) AS blk FROM series) GROUP BY subject, target, channel, blk"""))
def q_series_kv(spark, d):
    return kv_rows(events_series(spark, d), dataset="HCP", atlas="events", cell_points=KV_CELL_POINTS)


_EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register("table_profile", "S-10",
          " UNION ALL ".join(
              f"SELECT (SELECT count(*) FROM events) AS n_rows, '{c}' AS column_name, count({c}) AS non_null, "
              f"count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, "
              f"CAST(max({c}) AS VARCHAR) AS max_value FROM events" for c in _EVENT_COLS))
def q_table_profile(spark, d):
    return profile(load(spark, d, "events"), _EVENT_COLS)


@register("table_shapes", "S-10 S-1",
          "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM events")
def q_table_shapes(spark, d):
    return shape(load(spark, d, "events"))
