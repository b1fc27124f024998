"""Helpers the operators share: session settings, landed stages, row readers."""

from __future__ import annotations

import atexit
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir, tune

# Limits of an Arrow batch: whole texts cross to Python, and a few of them are very long.
BATCH_ROWS = 4096
BATCH_BYTES = 2 * 1024 * 1024

_landed: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings for operators that hand whole texts to Python."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: what follows neither recomputes the stage nor
    depends on the executors that made it. Also the path, for callers that remove it early; all
    that is left goes when the application ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _landed:
        _landed[app] = []
        atexit.register(_clear, spark, app)
    _landed[app].append(path)
    # Spark deletes shuffle files when the driver's JVM finds their stage unused: let it look now, before the next stage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def land(df: DataFrame) -> DataFrame:
    return stage(df)[0]


def _clear(spark: SparkSession, app: str) -> None:
    for path in _landed.pop(app, []):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: str, folds: int, fold: int):
    """True for rows whose crc32 of the id as text falls into the given fold; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: dict[int, int]
) -> DataFrame:
    """(label, text) of at most ``per_class[c]`` labelled documents of each class c outside the fold.

    Which rows are taken depends on a hash of their id only. The labels alone are ordered to
    choose them, so the sample that is joined to the texts is bounded by ``per_class``. An id
    labelled twice counts as its larger label, one with several texts as the one that hashes least.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = None
    for value, n in per_class.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    least = F.struct(F.col("text").isNull(), F.xxhash64("text"))
    return found.groupBy("doc_id", "label").agg(F.min_by("text", least).alias("text"))
