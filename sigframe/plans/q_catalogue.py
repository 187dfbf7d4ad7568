"""Registered queries: scan catalogue over paths derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.operators import catalogue as C
from sigframe.plans.oracle import EVENTS_CTE, with_ctes
from sigframe.plans.registry import register
from sigframe.sources.standins import archive_paths, event_classes, scan_paths
from sigframe.sources.tables import load, manifest

# The source workload's caps (subjects, pairs, archives per subject).
SUBJECT_CAP = 200
PAIR_CAP = 200
ARCHIVES_PER_SUBJECT = 2

S6 = "printf('%06d', subject + 100000)"
PATHS_CTE = EVENTS_CTE + f""",
scan AS (SELECT DISTINCT '/data/' || {S6} || '_' || task || '/' || {S6} || '_3T_tfMRI_' || task || '_' || run
                || '.nii.gz' AS path FROM ev),
arch AS (SELECT DISTINCT '/source/' || {S6} || '_3T_tfMRI_' || task || '_preproc.zip' AS path FROM ev),
imgs AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder,
                regexp_matches(path, 'LR.nii.gz') AS is_lr, regexp_matches(path, 'RL.nii.gz') AS is_rl
         FROM scan WHERE regexp_matches(path, '\\.nii\\.gz$')),
folders AS (SELECT folder, count(*) AS n_images, min(CASE WHEN is_lr THEN path END) AS lr_path,
                   min(CASE WHEN is_rl THEN path END) AS rl_path FROM imgs GROUP BY folder),
pairs AS (SELECT * FROM folders WHERE n_images = 2 AND lr_path IS NOT NULL AND rl_path IS NOT NULL),
psub AS (SELECT folder, lr_path, rl_path,
           CAST(split_part(regexp_extract(lr_path, '\\d{{6}}_\\w{{2,10}}', 0), '_', 1) AS INTEGER) AS lr_subject,
           split_part(regexp_extract(lr_path, '\\d{{6}}_\\w{{2,10}}', 0), '_', 2) AS task,
           CAST(split_part(regexp_extract(rl_path, '\\d{{6}}_\\w{{2,10}}', 0), '_', 1) AS INTEGER) AS rl_subject,
           split_part(regexp_extract(rl_path, '\\d{{6}}_\\w{{2,10}}', 0), '_', 2) AS rl_task FROM pairs),
good AS (SELECT folder, lr_subject AS subject, task, lr_path, rl_path FROM psub
         WHERE lr_subject = rl_subject AND task = rl_task)"""


def _ev(spark, d):
    return load(spark, d, "events")


@register("catalogue_archives", "S-3 P-1",
          with_ctes(PATHS_CTE, """SELECT path, regexp_extract(path, '\\d{6}', 0) AS subject FROM arch a
WHERE EXISTS (SELECT 1 FROM cls WHERE contains(regexp_extract(a.path, '[^/]*$', 0), cls.task))
  AND a.path LIKE '%.zip'"""))
def q_catalogue_archives(spark, d):
    ev = _ev(spark, d)
    paths = archive_paths(ev)
    name = F.element_at(F.split("path", "/"), -1)
    tasks = F.broadcast(event_classes(ev).select("task"))  # bounded: one row per class
    listed = paths.join(tasks, name.contains(F.col("task")), "left_semi").filter(name.endswith(".zip"))
    return C.with_subject(listed)


@register("catalogue_first_subjects", "W-4 L-1 J-4 A-6",
          with_ctes(PATHS_CTE, f"""SELECT path, regexp_extract(path, '\\d{{6}}', 0) AS subject FROM arch
WHERE regexp_extract(path, '\\d{{6}}', 0) IN (
  SELECT s FROM (SELECT DISTINCT regexp_extract(path, '\\d{{6}}', 0) AS s FROM arch) ORDER BY s LIMIT {SUBJECT_CAP})"""))
def q_catalogue_first_subjects(spark, d):
    return C.cut_files(archive_paths(_ev(spark, d)), SUBJECT_CAP).select("path", "subject")


@register("catalogue_runs", "P-2 P-3 P-4",
          with_ctes(PATHS_CTE, """SELECT s.path, s.subject, s.task, c.target, s.is_lr, s.is_rl,
  CASE WHEN s.is_lr THEN 'LR' WHEN s.is_rl THEN 'RL' END AS side
FROM (SELECT path,
        CAST(split_part(regexp_extract(path, '\\d{6}_\\w{2,10}', 0), '_', 1) AS INTEGER) AS subject,
        split_part(regexp_extract(path, '\\d{6}_\\w{2,10}', 0), '_', 2) AS task,
        regexp_matches(path, 'LR.nii.gz') AS is_lr, regexp_matches(path, 'RL.nii.gz') AS is_rl FROM scan) s
JOIN cls c ON c.task = s.task"""))
def q_catalogue_runs(spark, d):
    ev = _ev(spark, d)
    parsed = C.with_run_side(C.with_subject_task(scan_paths(ev)))
    matched, _unknown = C.with_class(parsed, event_classes(ev))
    return matched.select("path", "subject", "task", "target", "is_lr", "is_rl", "side")


@register("catalogue_pairs", "A-5 J-1 P-5",
          with_ctes(PATHS_CTE, "SELECT * FROM good"))
def q_catalogue_pairs(spark, d):
    pairs, _dropped = C.run_pairs(scan_paths(_ev(spark, d)))
    good, _rejects = C.split_mismatched(pairs)
    return good


@register("catalogue_dropped_folders", "A-5",
          with_ctes(PATHS_CTE, "SELECT folder, n_images FROM folders "
                               "WHERE NOT (n_images = 2 AND lr_path IS NOT NULL AND rl_path IS NOT NULL)"))
def q_catalogue_dropped(spark, d):
    _pairs, dropped = C.run_pairs(scan_paths(_ev(spark, d)))
    return dropped.select("folder", "n_images")


@register("catalogue_pair_rejects", "J-5",
          with_ctes(PATHS_CTE, "SELECT * FROM psub WHERE NOT (lr_subject = rl_subject AND task = rl_task) "
                               "OR lr_subject IS NULL OR rl_subject IS NULL"))
def q_catalogue_rejects(spark, d):
    pairs, _dropped = C.run_pairs(scan_paths(_ev(spark, d)))
    _good, rejects = C.split_mismatched(pairs)
    return rejects


@register("catalogue_first_pairs", "L-2",
          with_ctes(PATHS_CTE, f"SELECT * FROM good ORDER BY subject, task, folder LIMIT {PAIR_CAP}"))
def q_catalogue_first_pairs(spark, d):
    pairs, _dropped = C.run_pairs(scan_paths(_ev(spark, d)))
    good, _rejects = C.split_mismatched(pairs)
    return C.first_pairs(good, PAIR_CAP)


@register("catalogue_first_archive", "L-3",
          with_ctes(PATHS_CTE, "SELECT path FROM arch ORDER BY path LIMIT 1"))
def q_catalogue_first_archive(spark, d):
    return C.first_archive(archive_paths(_ev(spark, d)))


@register("catalogue_archive_cap", "L-4 P-14",
          with_ctes(PATHS_CTE, f"""SELECT path, subject, rank FROM (
  SELECT path, split_part(regexp_extract(path, '[^/]*$', 0), '_', 1) AS subject,
         CAST(row_number() OVER (PARTITION BY split_part(regexp_extract(path, '[^/]*$', 0), '_', 1) ORDER BY path)
              AS INTEGER) AS rank
  FROM scan) WHERE rank <= {ARCHIVES_PER_SUBJECT}"""))
def q_catalogue_archive_cap(spark, d):
    return C.archives_per_subject(scan_paths(_ev(spark, d)), ARCHIVES_PER_SUBJECT)


@register("catalogue_manifest", "S-7",
          with_ctes(PATHS_CTE, """SELECT folder AS archive, path,
  row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS pos FROM imgs"""))
def q_catalogue_manifest(spark, d):
    files = C.with_folder(scan_paths(_ev(spark, d))).withColumnRenamed("folder", "archive")
    return manifest(files)
