"""COCO-style annotation files.

Such a file is one object with an array for each table. Its text is landed in chunks once; many tasks cut the
chunks into objects (``jsonarrays``), so no row holds an array. Several files are read as one: ``ord`` goes on
from file to file, by file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialise
from plumbline.sources.jsonarrays import elements, land_chunks

_IMAGE = "id bigint, file_name string"
_INSTANCE = "id bigint, image_id bigint, category_id int, bbox array<double>, area double"
_CATEGORY = "id int, name string"
_CAPTION = "id bigint, image_id bigint, caption string"

# Places a file may hold before the next one's begin.
_FILE_STRIDE = 1 << 40


def _rows(chunks: DataFrame, field: str, schema: str) -> DataFrame:
    """The objects of a field's array with their place (``ord``) in all files."""
    found = elements(chunks, field)
    # a row an annotation file; written, since a window over all rows has one partition, which a join would bring all elements to
    names = materialise(found.select("file").distinct().withColumn("_file", F.row_number().over(Window.orderBy("file")) - 1))
    place = F.col("_file") * _FILE_STRIDE + F.col("position")
    parsed = F.from_json("json", schema, {"mode": "FAILFAST"})
    return found.join(names, "file").select(place.cast("long").alias("ord"), parsed.alias("x")).select("ord", "x.*")


def read_instances(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``images``, ``instances`` and ``categories`` of instance files, in file order (``ord``)."""
    chunks = land_chunks(spark, path)
    return {
        "images": _rows(chunks, "images", _IMAGE).select(F.col("id").alias("image_id"), "file_name", "ord"),
        "instances": _rows(chunks, "annotations", _INSTANCE).select("image_id", "category_id", "bbox", "area", "ord"),
        "categories": _rows(chunks, "categories", _CATEGORY).select(F.col("id").alias("category_id"), "name").distinct(),
    }


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """``captions`` of caption files, in file order."""
    return _rows(land_chunks(spark, path), "annotations", _CAPTION).select("image_id", "caption", "ord")


def image_ids(images: DataFrame) -> DataFrame:
    """All image ids with their place in the file."""
    return images.select("image_id", "ord")


def land(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write tables as Parquet under ``path`` and return them read back.

    The landed size is what lets Catalyst decide on broadcasting the category table.
    """
    landed = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        landed[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    return landed
