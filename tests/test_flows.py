"""End-to-end plans on sf0.001 stand-ins."""

from pyspark.sql import functions as F

from conftest import SF
from sigframe.plans import flows
from sigframe.sources.standins import atlas_from_part, series_from_events, voxels_from_lineitem
from sigframe.sources.tables import Catalog, load


def test_region_features_models_end_to_end(spark, tmp_path):
    li, part = load(spark, SF, "lineitem"), load(spark, SF, "part")
    subjects = li.select(F.col("l_suppkey").alias("scan_id")).distinct().select(
        "scan_id", F.col("scan_id").alias("subject"), (F.col("scan_id") % 3).cast("int").alias("target"))
    cat = Catalog(spark, str(tmp_path / "db"))
    series = flows.extract_regions(voxels_from_lineitem(li), atlas_from_part(part), subjects, cat, "regions")
    lengths = series.groupBy("series_id", "channel").count().select("count").distinct().collect()
    assert len(lengths) == 1  # equalised
    feats = flows.extract_features(series_from_events(load(spark, SF, "events")), ("distribution",), select=False)
    matrix = flows.feature_matrix(feats)
    scores = flows.build_models(matrix, "events", ("GaussianNB", "KNeighborsClassifier"), catalog=cat)
    got = scores.collect()
    assert {r["classifier"] for r in got} == {"GaussianNB", "KNeighborsClassifier"}
    assert all(0 <= r["accuracy"] <= 1 and r["accuracy"] == r["f1"] for r in got)
    assert cat.read_table("events_model").count() == 2


def test_resting_regions_written_per_run(spark, tmp_path):
    li, part = load(spark, SF, "lineitem"), load(spark, SF, "part")
    runs = li.select(F.col("l_suppkey").alias("scan_id")).distinct().select(
        "scan_id", F.col("scan_id").alias("subject"),
        F.when(F.col("scan_id") % 2 == 0, "REST1").otherwise("REST2").alias("run"))
    cat = Catalog(spark, str(tmp_path / "rest"))
    out = flows.resting_regions(voxels_from_lineitem(li), atlas_from_part(part), runs, cat, "cleaned")
    back = cat.read_table("cleaned")
    assert back.count() == out.count() > 0
    assert {r["run"] for r in back.select("run").distinct().collect()} <= {"REST1", "REST2"}


def test_runs_of_a_subject_follow_each_other_and_keys_do_not_collide(spark):
    regions = spark.createDataFrame([(s, 1, t, float(100 * s + t)) for s in (1, 2) for t in range(3)] + [(3, 1, 0, 5.0), (4, 1, 0, 6.0)],
                                    "scan_id long, label int, t long, x double")
    subjects = spark.createDataFrame([(1, 9, 0, "RL"), (2, 9, 0, "LR"), (3, 7, 100, "LR"), (4, 8, 0, "LR")],
                                     "scan_id long, subject long, target int, run string")
    out = flows.regions_as_series(regions, subjects).orderBy("series_id", "t").collect()
    assert [r["x"] for r in out if r["subject"] == 9] == [200.0, 201.0, 202.0, 100.0, 101.0, 102.0]
    assert len({r["series_id"] for r in out}) == 3 and [r["t"] for r in out if r["subject"] == 9] == list(range(6))
