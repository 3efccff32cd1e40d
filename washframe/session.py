"""Session helpers: building a local session and finding shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark import SparkConf, SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "washframe",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for local runs; on a cluster the submitter's confs win.

    AQE stays on so shuffle partitions are coalesced / skew-split at runtime;
    the UI stays off (no server, no port).
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = {
        "spark.master": master or f"local[{cpus}]",
        "spark.app.name": app,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("WASHFRAME_DRIVER_MEMORY", "16g"),
    }
    if "PYSPARK_GATEWAY_PORT" in os.environ:     # under spark-submit the settings are in the JVM
        SparkContext._ensure_initialized()
    given = SparkConf()
    builder = SparkSession.builder
    for key, value in wanted.items():
        asked = (key == "spark.master" and master) or (key == "spark.sql.shuffle.partitions" and shuffle_partitions)
        if asked or not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none and runs in local mode (tests) is a private
    folder under the system temp dir created and registered; a cluster session
    without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return _shared(spark, current)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # A machine-local folder would not survive the loss of an executor.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder "
                               "(HDFS / object store) for cluster runs")
        configured = tempfile.mkdtemp(prefix="washframe-ckpt-")
    sc.setCheckpointDir(_shared(spark, configured))
    return sc.getCheckpointDir()


def _shared(spark: SparkSession, path: str) -> str:
    """``path``, or an error if a cluster session would write to machine-local disks: a
    ``file:`` folder (a mounted one, say) counts as shared once all rows that tasks wrote
    to it are read again. One small job per application and folder."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or os.environ.get("WASHFRAME_SHARED_FILES"):
        return path
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    tried = getattr(sc, "_washframe_shared", set())
    if hpath.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme() == "file" and path not in tried:
        tasks = max(2, 2 * sc.defaultParallelism)
        try:
            seen = _rows_seen(spark, path, tasks)
        except (PySparkException, Py4JJavaError) as e:
            raise RuntimeError(f"spark.checkpoint.dir must be shared by all machines; a trial in {path} failed") from e
        if seen != tasks:
            raise RuntimeError(f"spark.checkpoint.dir must be shared by all machines: of {tasks} rows "
                               f"written to {path}, {seen} are seen")
        sc._washframe_shared = tried | {path}
    return path


def _rows_seen(spark: SparkSession, path: str, tasks: int) -> int:
    """How many of the rows that so many tasks write below ``path``, one each, are read again."""
    trial = f"{path.rstrip('/')}/washframe-trial-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(trial)
        return spark.read.schema("id long").parquet(trial).count()
    finally:
        drop_scratch(spark, trial)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder name inside the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/washframe-{label}-{uuid.uuid4().hex}"


def materialize(df, label: str, path: str | None = None):
    """Cut lineage with a parquet table in the shared checkpoint folder.

    One job computes and writes the rows (a reliable RDD checkpoint computes
    them twice unless cached); reads are columnar, so later passes read only
    the columns they use. Columns are stored under positional names, so any
    original name survives the round trip.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    names = df.columns
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    return spark.read.parquet(path).toDF(*names)


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Delete a scratch table written by ``materialize`` (recursive, through the
    Hadoop FileSystem of the path, so it works for HDFS and object stores)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a folder has exactly this path, asked through its Hadoop FileSystem."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory())


def ship_code(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_washframe_code", None) == sc.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="washframe-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._washframe_code = sc.applicationId
