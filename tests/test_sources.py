"""Sources and sinks: catalogue round trip, archive listing, model persistence."""

import zipfile

from pyspark.sql import functions as F

from sigframe.operators import models as M
from sigframe.sources import archives as Z
from sigframe.sources.tables import Catalog, profile, shape


def test_catalog_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, name string, v double")
    for fmt in ("parquet", "csv"):
        cat = Catalog(spark, str(tmp_path / fmt), fmt)
        cat.write_table("t", df)
        back = cat.read_table("t", schema=df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert tuple(shape(df).collect()[0]) == (2, 3)
    prof = {r["column_name"]: r for r in profile(df).collect()}
    assert prof["v"]["non_null"] == 1 and prof["name"]["n_distinct"] == 2


def test_archive_listing_and_members(spark, tmp_path):
    for name, members in {
        "100307_3T_tfMRI_EMOTION_preproc.zip": ["100307/MNINonLinear/Results/tfMRI_EMOTION_LR/tfMRI_EMOTION_LR.nii.gz",
                                                 "100307/MNINonLinear/Results/tfMRI_EMOTION_RL/tfMRI_EMOTION_RL.nii.gz",
                                                 "100307/notes.txt"],
        "100408_3T_rfMRI_REST1_preproc.zip": ["100408/MNINonLinear/Results/rfMRI_REST1_LR/rfMRI_REST1_LR.nii.gz"],
    }.items():
        with zipfile.ZipFile(tmp_path / name, "w") as zf:
            for m in members:
                zf.writestr(m, b"x" * 10)
    (tmp_path / "readme.txt").write_text("no archive")
    listed = Z.list_archives(spark, str(tmp_path))
    assert listed.count() == 2
    rest = Z.list_archives(spark, str(tmp_path), ["*REST1_preproc.zip", "*REST2_preproc.zip"])
    assert rest.count() == 1
    members = Z.list_members(spark, str(tmp_path))
    assert members.count() == 4
    task = Z.task_members(members).collect()
    assert {r["folder"] for r in task} == {"100307_EMOTION"} and len(task) == 2


def test_model_save_load_predict(spark, tmp_path):
    data = [(i, i % 2, [float(i % 2) + 0.01 * i, 1.0 - (i % 2)]) for i in range(40)]
    m = spark.createDataFrame(data, "id long, target int, features array<double>")
    model = M.fit_pipeline(m, "RandomForestClassifier", numTrees=10, maxDepth=5)
    path = str(tmp_path / "rf")
    from sigframe.sources.tables import load_model, save_model

    save_model(model, path)
    again = load_model(path)
    a = M.predict(model, m).orderBy("id").collect()
    b = M.predict(again, m).orderBy("id").collect()
    assert a == b
    assert sum(r["prediction"] == t for r, (_, t, _) in zip(a, data)) >= 36
    assert F is not None


def test_kv_rows_manifest_and_atlas_lookup(spark):
    import json

    import pytest

    from sigframe.operators import regions as R
    from sigframe.sources.tables import kv_rows, manifest

    series = spark.createDataFrame([(7, 1, "x_0", t, float(t) / 2) for t in range(5)],
                                   "subject long, target int, channel string, t long, x double")
    rows = {(r["rowkey"], r["qualifier"]): r["value"] for r in kv_rows(series, "HCP", "brand", cell_points=3).collect()}
    assert rows[("HCP_7_1", "data:person")] == "7" and rows[("HCP_7_1", "data:atlas")] == "brand"
    assert json.loads(rows[("HCP_7_1", "data:roi:x_0:0")]) == {"0": 0.0, "1": 0.5, "2": 1.0}
    assert json.loads(rows[("HCP_7_1", "data:roi:x_0:1")]) == {"3": 1.5, "4": 2.0}
    files = spark.createDataFrame([("a", "/a/2"), ("a", "/a/1"), ("b", "/b/9")], "archive string, path string")
    assert sorted(tuple(r) for r in manifest(files).collect()) == [("a", "/a/1", 0), ("a", "/a/2", 1), ("b", "/b/9", 0)]
    cat = R.atlas_catalog(spark)
    ok = R.lookup_atlases(spark.createDataFrame([("atlas_aal",)], "atlas string"), cat).collect()
    assert ok[0]["output_table"] == "atlas_aal_standardize"
    lenient = R.lookup_atlases(spark.createDataFrame([("nope",)], "atlas string"), cat, strict=False)
    assert lenient.count() == 0
    with pytest.raises(Exception):
        R.lookup_atlases(spark.createDataFrame([("nope",)], "atlas string"), cat).collect()


def test_runs_are_one_file_a_folder(spark, tmp_path):
    from sigframe.sources.tables import Catalog, write_runs

    df = spark.range(400).selectExpr("id % 5 as subject", "if(id % 2 = 0, 'LR', 'RL') as run", "id as t", "id * 1.0D as x")
    cat = Catalog(spark, str(tmp_path))
    write_runs(cat, "runs", df.repartition(8))
    folders = list((tmp_path / "runs").glob("subject=*/run=*"))
    assert len(folders) == 10 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert cat.read_table("runs").count() == 400


def test_many_runs_are_read_by_few_tasks(spark, tmp_path):
    from sigframe.sources.tables import Catalog, read_runs, write_runs

    cat = Catalog(spark, str(tmp_path))
    df = spark.createDataFrame([(i // 3, "LR" if i % 2 else "RL", i % 3, float(i)) for i in range(240)],
                               "subject long, run string, t long, x double")
    write_runs(cat, "runs", df)
    assert len(list(tmp_path.glob("runs/subject=*/run=*/*.parquet"))) == df.select("subject", "run").distinct().count()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task a file
    try:
        back = read_runs(cat, "runs")
        assert back.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted((r["subject"], r["run"], r["t"], r["x"]) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
