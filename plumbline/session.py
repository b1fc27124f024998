"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings. Skewed joins are split by AQE even when that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Settings fixed once a session exists. Extraction builds large expressions, and recording a
# call site for every column call would take longer than planning the query.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def builder(master: str, app: str = "plumbline") -> SparkSession.Builder:
    """A session builder with all settings applied."""
    b = SparkSession.builder.master(master).appName(app)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF}.items():
        b = b.config(key, value)
    return b


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Workers import it when a task's function lives in it, and they need not share the driver's
    working directory or import path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="plumbline-ship-"), "plumbline")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and ship the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the shared folder the cluster names in ``spark.checkpoint.dir``.

    It is removed when the application ends.

    Only a local master may fall back to a temporary folder of its own: on a cluster a
    machine-local folder would vanish with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    path = f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(_clear, spark, app)
    _scratch[app].append(path)
    return path


_scratch: dict[str, list[str]] = {}


def _clear(spark: SparkSession, app: str) -> None:
    """Remove an application's stages when it ends: results may read them until then."""
    jvm = spark.sparkContext._jvm
    for path in _scratch.pop(app, []):
        if jvm is None:  # the session ended first
            return
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - nothing is left to do about it at exit
            return


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stage_once(df: DataFrame, path: str) -> DataFrame:
    """Like ``materialise``, but a stage that an earlier run wrote whole is read, not made again."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a stage once and go on from the written table (lineage ends there)."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out evenly before heavy column work.

    Splits say little about rows: a file's row groups, not its bytes, decide which tasks get any, and texts differ much in
    length. So there are a few tasks per core, or as many as splits if these are more. The exchange of the texts costs a
    small part of the work on them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(3 * cores, df.rdd.getNumPartitions()))
