"""Session helpers.

Library code never creates a global session: every job takes the caller's
``SparkSession``. ``local_session`` is for tests, the bench and the driver
smoke check; on a cluster the platform's session is used as is.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "editlens") -> SparkSession:
    """A local session configured like the cluster one (AQE, UTC, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) a fresh scratch folder is set.
    """
    try:
        sc = spark.sparkContext
    except Exception:                       # Spark Connect: the server's setting applies
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return path
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master.split("[")[0] != "local":      # executors would not see a folder of the driver
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="editlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session: functions that run in Python workers import
    it by name, wherever the driver was started and whether or not it is installed there."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:                       # Spark Connect
        app = spark.session_id
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="editlens-package-")       # read by the driver's file server only
    path = os.path.join(folder, "editlens_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    try:
        spark.sparkContext.addPyFile(path)
    except Exception:                       # Spark Connect
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
