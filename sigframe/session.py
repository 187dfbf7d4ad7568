"""Session construction and lineage cutting.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  Local sessions (tests, bench) get their own
scratch checkpoint folder, and only when the setting is unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "sigframe") -> SparkSession:
    """A local session tuned for the test/bench machine (UI off, AQE on, UTC)."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(2 * int(cpus), 2))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIGFRAME_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    A cluster must name a shared folder in ``spark.checkpoint.dir``; a
    machine-local scratch folder is only created for ``local[...]`` masters.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="sigframe-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (reliable, not local).

    The frame is persisted first so the checkpoint write reads the cached
    partitions instead of recomputing the plan a second time; the cache is
    released once the checkpoint files exist.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where rows carry whole texts or sets of their shingles.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Rows go to Python workers ``TEXT_ROWS`` at a time from here on, unless the
    session names a number.  Spark's own is 10,000, and the JVM and the worker each
    hold a batch several times over, as buffers, objects and results."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(TEXT_ROWS))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so
    that Python workers can import them wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sigframe-ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
