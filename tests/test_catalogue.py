"""Scan catalogue on hand-made paths (good pair, missing run, three files,
unknown task, no six digits, digits inside a longer number)."""

from sigframe.operators import catalogue as C

PATHS = [
    "/d/100307_EMOTION/100307_3T_tfMRI_EMOTION_LR.nii.gz",
    "/d/100307_EMOTION/100307_3T_tfMRI_EMOTION_RL.nii.gz",
    "/d/100408_MOTOR/100408_3T_tfMRI_MOTOR_LR.nii.gz",
    "/d/101915_WM/101915_3T_tfMRI_WM_LR.nii.gz",
    "/d/101915_WM/101915_3T_tfMRI_WM_RL.nii.gz",
    "/d/101915_WM/101915_3T_tfMRI_WM_RL_copy.nii.gz",
    "/d/102311_DANCE/102311_3T_tfMRI_DANCE_LR.nii.gz",
    "/d/noid/x_RL.nii.gz",
]


def _paths(spark, paths=PATHS):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_subject_and_task(spark):
    got = {r["path"]: (r["subject"], r["task"]) for r in C.with_subject_task(_paths(spark)).collect()}
    assert got[PATHS[0]] == (100307, "EMOTION")
    assert got[PATHS[-1]] == (None, None)
    sub = {r["path"]: r["subject"] for r in C.with_subject(_paths(spark, ["/a/12345678/x.zip", "/a/b.zip"])).collect()}
    assert sub["/a/12345678/x.zip"] == "123456" and sub["/a/b.zip"] is None


def test_class_map_and_rejects(spark):
    df = C.with_subject_task(_paths(spark))
    matched, unknown = C.with_class(df.filter("task is not null"), C.task_dimension(spark))
    assert {r["task"] for r in unknown.collect()} == {"DANCE"}
    assert {(r["task"], r["target"]) for r in matched.collect()} == {("EMOTION", 0), ("MOTOR", 3), ("WM", 5)}


def test_pairs_keep_only_two_image_folders(spark):
    pairs, dropped = C.run_pairs(_paths(spark))
    good, rejects = C.split_mismatched(pairs)
    assert [r["folder"] for r in good.collect()] == ["/d/100307_EMOTION"]
    assert sorted(r["folder"] for r in dropped.collect()) == ["/d/100408_MOTOR", "/d/101915_WM", "/d/102311_DANCE",
                                                              "/d/noid"]
    assert rejects.count() == 0


def test_mismatched_subjects_are_rejected(spark):
    pairs = spark.createDataFrame([("/f", "/f/100307_EMOTION_LR.nii.gz", "/f/100308_EMOTION_RL.nii.gz")],
                                  "folder string, lr_path string, rl_path string")
    good, rejects = C.split_mismatched(pairs)
    assert good.count() == 0 and rejects.count() == 1


def test_first_subjects_and_caps(spark):
    arch = _paths(spark, [f"/s/{s}_3T_tfMRI_{t}_preproc.zip" for s in (300001, 100001, 200001) for t in ("WM", "MOTOR")])
    assert [r["subject"] for r in C.first_subjects(arch, 2).orderBy("subject").collect()] == ["100001", "200001"]
    assert C.cut_files(arch, 2).count() == 4
    capped = C.archives_per_subject(arch, 1)
    assert capped.count() == 3 and all(r["rank"] == 1 for r in capped.collect())


def test_resting_members(spark):
    m = spark.createDataFrame([
        ("/z/100307_3T_rfMRI_REST1_preproc.zip", "100307/MNINonLinear/Results/rfMRI_REST1_LR/rfMRI_REST1_LR.nii.gz"),
        ("/z/100307_3T_rfMRI_REST1_preproc.zip", "100307/MNINonLinear/Results/rfMRI_REST1_RL/rfMRI_REST1_RL.nii.gz"),
        ("/z/100307_3T_rfMRI_REST1_preproc.zip", "100307/MNINonLinear/Results/rfMRI_REST2_LR/rfMRI_REST2_LR.nii.gz"),
        ("/z/100307_3T_rfMRI_REST1_preproc.zip", "100307/release-notes/notes.txt"),
    ], "archive string, member string")
    got = C.resting_members(m).collect()
    assert len(got) == 2 and {r["run"] for r in got} == {"REST1"} and {r["subject"] for r in got} == {100307}
