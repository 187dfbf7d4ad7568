"""Independent SQL (DuckDB dialect) for the registered queries.

Each oracle recomputes its result from the raw tables with plain SQL:
window functions instead of the engine's block decomposition, built-in
quantiles instead of the distributed rank join, and so on.  Floating results
are rounded to ``DIGITS`` on both sides.
"""

from __future__ import annotations

DIGITS = 8

CLASSES_CTE = """cls AS (
  SELECT event_type, upper(event_type) AS task,
         CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS target
  FROM (SELECT DISTINCT event_type FROM events))"""

EVENTS_CTE = CLASSES_CTE + """,
ev AS (
  SELECT e.user_id AS subject, c.target, c.task, e.event_id, e.ts,
         CASE WHEN e.event_id % 2 = 0 THEN 'LR' ELSE 'RL' END AS run,
         e.value AS x_0, CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS x_1
  FROM events e JOIN cls c USING (event_type))"""

SERIES_CTE = EVENTS_CTE + """,
idx AS (
  SELECT *, row_number() OVER (PARTITION BY subject, target ORDER BY ts, event_id) - 1 AS t FROM ev),
series AS (
  SELECT CAST(subject AS BIGINT) * 100 + target AS series_id, subject, target, 'x_0' AS channel, t, x_0 AS x FROM idx
  UNION ALL
  SELECT CAST(subject AS BIGINT) * 100 + target AS series_id, subject, target, 'x_1' AS channel, t, x_1 AS x FROM idx)"""

EQUALISED_CTE = SERIES_CTE + """,
counts AS (SELECT series_id, count(CASE WHEN NOT isnan(x) THEN x END) AS n_points
           FROM series WHERE channel = 'x_0' GROUP BY series_id),
eq AS (SELECT * FROM series WHERE t < (SELECT min(n_points) FROM counts))"""


def rs(expr: str) -> str:
    """SQL twin of ``functions.columns.round_sig`` (same IEEE steps)."""
    x = f"CAST({expr} AS DOUBLE)"
    p = f"pow(10.0, CAST(greatest(floor(log10(abs({x}))), 0) AS DOUBLE))"
    scale = f"{float(10 ** DIGITS)!r}"
    t = f"({x} / {p} * {scale})"
    return (f"(CASE WHEN abs({x}) < 1e-9 THEN 0.0 "
            f"ELSE sign({t}) * floor(abs({t}) + 0.5001) / {scale} * {p} END)")


def r(expr: str, alias: str) -> str:
    """Rounded double column."""
    return f"{rs(expr)} AS \"{alias}\""


def with_ctes(ctes: str, body: str) -> str:
    """Prefix ``body`` with the CTE list; a body with its own WITH is merged."""
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def normal_p_sql(z: str) -> str:
    """SQL twin of ``functions.columns.normal_two_sided_p`` (A&S 7.1.26)."""
    from sigframe.functions.columns import AS_A, AS_P

    x = f"(abs({z}) / {2.0 ** 0.5!r})"
    t = f"(1.0 / (1.0 + {AS_P!r} * {x}))"
    poly = "0.0"
    for a in reversed(AS_A):
        poly = f"(({poly} + {a!r}) * {t})"
    return f"({poly} * exp(-{x} * {x}))"
