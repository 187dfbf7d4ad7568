"""Registered queries: region reduction over lineitem (voxels) x part (atlas)."""

from __future__ import annotations

from sigframe.operators import regions as R
from sigframe.plans.oracle import r, with_ctes
from sigframe.plans.registry import register
from sigframe.sources.standins import atlas_from_part, voxels_from_lineitem
from sigframe.sources.tables import load

REGIONS_CTE = """vox AS (
  SELECT l_suppkey AS scan_id, l_partkey AS voxel,
         CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, l_extendedprice AS x
  FROM lineitem),
atl AS (SELECT p_partkey AS voxel, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS label FROM part),
reg AS (SELECT scan_id, label, t, avg(x) AS x FROM vox JOIN atl USING (voxel) WHERE label <> 0
        GROUP BY scan_id, label, t)"""


def _regions(spark, d):
    return R.region_series(voxels_from_lineitem(load(spark, d, "lineitem")), atlas_from_part(load(spark, d, "part")))


@register("regions_series", "J-3 A-3 R-1 R-2", with_ctes(REGIONS_CTE, f"SELECT scan_id, label, t, {r('x', 'x')} FROM reg"))
def q_regions_series(spark, d):
    return _regions(spark, d)


@register("regions_standardised", "R-3",
          with_ctes(REGIONS_CTE, f"""SELECT reg.scan_id, reg.label, reg.t,
  {r('CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END', 'x')}
FROM reg JOIN (SELECT scan_id, label, avg(x) AS m, stddev_pop(x) AS s FROM reg GROUP BY 1, 2) st
  USING (scan_id, label)"""))
def q_regions_standardised(spark, d):
    return R.standardise_regions(_regions(spark, d))


@register("regions_cleaned", "R-5 R-7",
          with_ctes(REGIONS_CTE + """,
gs AS (SELECT scan_id, t, avg(x) AS g FROM reg GROUP BY 1, 2),
j AS (SELECT reg.*, gs.g FROM reg JOIN gs USING (scan_id, t)),
fit AS (SELECT scan_id, label, regr_slope(x, g) AS b, regr_intercept(x, g) AS a, avg(x) AS m FROM j GROUP BY 1, 2)""",
                    f"""SELECT j.scan_id, j.label, j.t,
  {r('j.x - CASE WHEN fit.b IS NULL THEN fit.m ELSE fit.a END - coalesce(fit.b, 0) * j.g', 'x')}
FROM j JOIN fit USING (scan_id, label)"""))
def q_regions_cleaned(spark, d):
    return R.remove_confounds(_regions(spark, d))
