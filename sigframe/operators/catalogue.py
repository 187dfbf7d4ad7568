"""Scan catalogue: subject/task/run parsing of file paths (P-1…P-5, P-14),
run pairing (A-5, J-1), mismatch rejects (J-5), subject caps (W-4, L-1, J-4),
pair / archive caps (L-2…L-4) and resting-archive member selection (S-6).

Paths are plain string columns; every step is a column expression, a
grouped aggregate or a semi/anti join — no driver-side loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.ordering import top_k_per_group

# The task words of the recording protocol and their class codes.
TASK_CLASSES = {"EMOTION": 0, "GAMBLING": 1, "LANGUAGE": 2, "MOTOR": 3, "RELATIONAL": 4, "WM": 5, "SOCIAL": 6}
# Path patterns of the source layout.
SUBJECT_RE = r"\d{6}"
SUBJECT_TASK_RE = r"\d{6}_\w{2,10}"
LR_RE = "LR.nii.gz"
RL_RE = "RL.nii.gz"
RESTING_MEMBER = "{0}/MNINonLinear/Results/rfMRI_{1}_{2}/rfMRI_{1}_{2}.nii.gz"


def task_dimension(spark, classes: dict[str, int] = TASK_CLASSES) -> DataFrame:
    """Class map as a tiny dimension table ``(task, target)``."""
    return spark.createDataFrame(sorted(classes.items(), key=lambda kv: kv[1]), "task string, target int")


def with_subject(paths: DataFrame, col: str = "path") -> DataFrame:
    """P-1: first six-digit run anywhere in the path (NULL when there is none)."""
    return paths.withColumn("subject", F.nullif(F.regexp_extract(col, SUBJECT_RE, 0), F.lit("")))


def with_subject_task(paths: DataFrame, col: str = "path") -> DataFrame:
    """P-2: ``\\d{6}_\\w{2,10}`` split on ``_``: subject (int) and task."""
    m = F.nullif(F.regexp_extract(col, SUBJECT_TASK_RE, 0), F.lit(""))
    parts = F.split(m, "_")
    return paths.withColumn("subject", parts.getItem(0).cast("int")).withColumn("task", parts.getItem(1))


def with_class(df: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-3: attach class codes; returns (matched, unknown-task rejects)."""
    dim = F.broadcast(classes.select("task", "target"))  # bounded: one row per class
    return df.join(dim, "task"), df.join(dim, "task", "left_anti")


def with_run_side(paths: DataFrame, col: str = "path") -> DataFrame:
    """P-4: independent LR / RL tests (a path may hit both), then the side."""
    is_lr, is_rl = F.col(col).rlike(LR_RE), F.col(col).rlike(RL_RE)
    return (paths.withColumn("is_lr", is_lr).withColumn("is_rl", is_rl)
            .withColumn("side", F.when(is_lr, "LR").when(is_rl, "RL")))


def with_folder(paths: DataFrame, col: str = "path") -> DataFrame:
    return paths.withColumn("folder", F.regexp_extract(col, r"^(.*)/[^/]*$", 1))


def folder_images(paths: DataFrame, col: str = "path") -> DataFrame:
    """A-5: per folder the image count and its LR / RL members."""
    imgs = with_run_side(with_folder(paths.filter(F.col(col).rlike(r"\.nii\.gz$")), col), col)
    return imgs.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.min(F.when(F.col("is_lr"), F.col(col))).alias("lr_path"),
        F.min(F.when(F.col("is_rl"), F.col(col))).alias("rl_path"))


def run_pairs(paths: DataFrame, col: str = "path") -> tuple[DataFrame, DataFrame]:
    """A-5 + J-1: keyed LR/RL pairs of folders with exactly two images.

    One grouped aggregate (no self-join).  Returns (pairs, dropped folders).
    """
    folders = folder_images(paths, col)
    keep = (F.col("n_images") == 2) & F.col("lr_path").isNotNull() & F.col("rl_path").isNotNull()
    return folders.filter(keep), folders.filter(~keep)


def pair_subjects(pairs: DataFrame) -> DataFrame:
    """P-2 on both sides of a pair."""
    m = lambda c: F.split(F.regexp_extract(c, SUBJECT_TASK_RE, 0), "_")
    return pairs.select(
        "folder", "lr_path", "rl_path",
        m("lr_path").getItem(0).cast("int").alias("lr_subject"), m("lr_path").getItem(1).alias("task"),
        m("rl_path").getItem(0).cast("int").alias("rl_subject"), m("rl_path").getItem(1).alias("rl_task"))


def split_mismatched(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-5 / J-5: pairs whose two subject ids (or tasks) agree, and the rejects."""
    p = pair_subjects(pairs)
    same = (F.col("lr_subject") == F.col("rl_subject")) & (F.col("task") == F.col("rl_task"))
    good = p.filter(same).select("folder", F.col("lr_subject").alias("subject"), "task", "lr_path", "rl_path")
    return good, p.filter(~same | same.isNull())


def first_subjects(paths: DataFrame, n: int, col: str = "path") -> DataFrame:
    """W-4 / L-1: the ``n`` smallest subject ids (compared as text)."""
    subj = with_subject(paths, col).filter(F.col("subject").isNotNull()).select("subject").distinct()
    return subj.orderBy("subject").limit(n)


def cut_files(paths: DataFrame, n: int, col: str = "path") -> DataFrame:
    """J-4: archives of the first ``n`` subjects (semi-join on the extracted id)."""
    chosen = first_subjects(paths, n, col)
    return with_subject(paths, col).join(chosen, "subject", "left_semi")


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """L-2: first ``n`` pairs in a total (subject, task, folder) order."""
    return pairs.orderBy("subject", "task", "folder").limit(n)


def first_archive(paths: DataFrame, col: str = "path") -> DataFrame:
    """L-3: the first archive by path (explicit sample parameter of one)."""
    return paths.orderBy(col).limit(1)


def archives_per_subject(paths: DataFrame, k: int, col: str = "path") -> DataFrame:
    """L-4: at most ``k`` archives per subject (by path), salted two-level top-k."""
    with_s = with_basename_subject(paths, col)
    return top_k_per_group(with_s, ["subject"], [col], k).select(col, "subject", "rank")


def with_basename_subject(paths: DataFrame, col: str = "path") -> DataFrame:
    """P-14: text of the base name before its first ``_``."""
    base = F.element_at(F.split(F.col(col), "/"), -1)
    return paths.withColumn("subject", F.substring_index(base, "_", 1))


def resting_members(members: DataFrame) -> DataFrame:
    """S-6: members of resting archives that belong to the archive's subject/run.

    ``members(archive, member)``; subject = piece 0 and run = piece 3 of the
    archive base name split on ``_``; a member is kept when it starts with the
    LR or RL result path of that subject and run.
    """
    base = F.element_at(F.split("archive", "/"), -1)
    parts = F.split(base, "_")
    subject, run = parts.getItem(0).cast("int"), parts.getItem(3)
    pref = lambda side: F.format_string(
        "%d/MNINonLinear/Results/rfMRI_%s_%s/rfMRI_%s_%s.nii.gz", subject, run, F.lit(side), run, F.lit(side))
    keep = F.col("member").startswith(pref("LR")) | F.col("member").startswith(pref("RL"))
    return members.select("archive", "member", subject.alias("subject"), run.alias("run")).filter(keep)
