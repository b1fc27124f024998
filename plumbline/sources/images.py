"""Image files as bytes. Decoding is left to the predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import image_list, is_remote, join_path


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files under a folder; the path carries no scheme."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")


def image_references(tasks: DataFrame, image_dir: str = "", image: str = "image", sep: str = ",") -> DataFrame:
    """One row per image of a task: all columns, its place ``image_no``, ``path`` and ``remote``."""
    listed = tasks.select("*", F.posexplode(image_list(image, sep)).alias("image_no", "_name"))
    path = F.when(is_remote("_name"), F.col("_name")).otherwise(join_path(image_dir, "_name") if image_dir else F.col("_name"))
    return listed.withColumns({"path": path, "remote": is_remote("_name")}).drop("_name")


def attach_images(tasks: DataFrame, images: DataFrame, image_dir: str = "", image: str = "image", sep: str = ",") -> DataFrame:
    """Tasks with ``contents``, the bytes of their images in order (NULL where there is no file).

    Contents are looked up once for each distinct image list, so tasks may repeat, and need no key.
    Bytes are duplicated for every task that shows an image; passing the path column on to the
    predictor moves less and is the better choice when the executors can open it.
    """
    lists = tasks.select(F.col(image).alias("_image")).where("_image IS NOT NULL").distinct()
    found = image_references(lists, image_dir, "_image", sep).join(images, "path", "left")
    contents = found.groupBy("_image").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("image_no", "content"))), lambda x: x["content"]).alias("contents")
    )
    return tasks.join(contents, F.col(image) == F.col("_image"), "left").drop("_image")
