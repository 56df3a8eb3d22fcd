"""Session defaults and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every tablescope session relies on: statistics are computed on naive
# UTC timestamps, AQE re-plans shuffles at runtime, the web UI stays off.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tablescope",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with tablescope's defaults.

    ``master`` is only set for local runs and tests; on a cluster the launcher
    decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "12g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is used as is. Only where nothing is configured on a local master
    (tests) a private folder is created; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = os.path.join(tempfile.gettempdir(), f"tablescope-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: What a split's cells take in a hash aggregate is many times their bytes in a file.
SCAN_BYTES = 16 << 20


def small_splits(spark: SparkSession) -> None:
    """Hold the splits of file scans at ``SCAN_BYTES``, so that a task's memory does not follow the size of a table.
    A session that has smaller ones keeps them."""
    name = "spark.sql.files.maxPartitionBytes"
    given = spark.range(0)._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    if given > SCAN_BYTES:
        spark.conf.set(name, str(SCAN_BYTES))


#: What a reduce task of an aggregate reads: in its hash table that is several times as much.
REDUCE_BYTES = 8 << 20
#: Up to so many partitions a map task writes straight into files; beyond, Spark's writer holds the task's whole output.
MOST_PARTITIONS = 200


def small_reduces(spark: SparkSession, size: int) -> None:
    """Hold what adaptive execution puts together for a reduce task at ``REDUCE_BYTES``, and let a table of
    ``size`` bytes be shuffled into partitions that are about as small. A session that has smaller or more ones keeps them."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > REDUCE_BYTES:
        spark.conf.set(name, str(REDUCE_BYTES))
    wanted = min(MOST_PARTITIONS, -(-size // (REDUCE_BYTES // 4)))  # an aggregate's cells take up to some four times the file
    if wanted > spark.range(0)._jdf.sparkSession().sessionState().conf().numShufflePartitions():
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablescope`` importable in Python workers (``mapInPandas``,
    ``applyInPandasWithState``): the package is zipped once per application
    and added with ``SparkContext.addPyFile``, which distributes it to every
    executor. A no-op when already shipped."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="tablescope-pkg-"), "tablescope.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)
