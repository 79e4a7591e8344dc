"""Session settings and reliable checkpoints."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "leafsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Join by hash instead of sorting where every partition of one side is known to be small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Whole pages travel in Arrow batches: few rows each, and no more than 64 MB.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        # Block features collect a tag set per block; the default of 128 groups
        # sends nearly every task to the sort-based fallback.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        # Checkpoints of frames no longer in use are removed.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver was started from.

    Functions that run in Arrow maps are sent by name, so every worker must be able to import it.
    """
    context = spark.sparkContext
    if getattr(context, "_leafsift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = _own_folder("leafsift-package-")
    archive = f"{folder}/leafsift.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    context._leafsift_shipped = True


def _own_folder(prefix: str) -> str:
    """A folder of this driver process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose tasks run in
    the driver itself (``local[n]``, not ``local-cluster``) may leave it unset; it
    gets a folder that is removed at the end.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        root = _own_folder("leafsift-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint root.

    All folders of an application lie in one, ``leafsift-<application id>``, which may be removed when it is over.
    """
    return f"{checkpoint_root(spark)}/leafsift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table under the shared checkpoint root and read again: computed once, compressed, with its lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of ``stored`` frames whose last reader has stored its own result."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for df in frames[:1]:
        tidy(df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over.

    They go when the driver collects the garbage that refers to them, which a driver with much memory does rarely; so it is asked to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
