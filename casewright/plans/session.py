"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "casewright", partitions: int = 8, **conf) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` overrides any setting (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return show_package(SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate())


def show_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (local mode, or a folder that all machines share);
    elsewhere it is shipped with ``--py-files``. Returns the session."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one of ``spark.checkpoint.dir``. Only where none is set and the master is
    local a temporary one is made; on a cluster without the setting this raises, for no other machine could read it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="casewright-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; a lost executor then costs no recomputation of the past.

    The rows are written as they are in memory; for wide rows with texts see ``stored``. Where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set the files go once nothing refers to them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a compressed columnar table and read again, so that each reader takes only
    its columns. The table goes when the driver's JVM ends."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
