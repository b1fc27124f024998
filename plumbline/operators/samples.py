"""Ground-truth samples from annotation tables.

    images(image_id, file_name, ord)   instances(image_id, category_id, bbox, area, ord)
    captions(image_id, caption, ord)   categories(category_id, name)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.nesting import PART_ROWS, nest_ordered
from plumbline.session import materialise

INSTANCE = "struct<category:string,bbox:array<double>,pixel_area:double>"
_ANNOTATION_ORDER = ["is_caption", "ord"]


def named_instances(instances: DataFrame, categories: DataFrame) -> DataFrame:
    """Instances with their category name (NULL where the id is unknown).

    No join hint: a category table below the broadcast threshold is broadcast by its size,
    a larger one is shuffled, and AQE splits the popular categories.
    """
    return instances.join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left")


def unknown_categories(instances: DataFrame, categories: DataFrame) -> DataFrame:
    """Quality check: category ids without a name, with the number of instances."""
    return (
        instances.groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("instances"))
        .join(categories.select("category_id"), "category_id", "left_anti")
    )


def first_images(images: DataFrame, n: int = 30) -> DataFrame:
    """The first n images in file order, for a smoke run."""
    return images.orderBy("ord").limit(n)


def assemble_samples(
    images: DataFrame,
    instances: DataFrame,
    captions: DataFrame,
    categories: DataFrame,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per image: file name, instances and captions in annotation order.

    Every image stays, with empty lists where it has no annotations. Both kinds of annotation
    are nested together. An image with more than ``part_rows`` annotations yields several rows,
    told apart by ``part``.
    """
    instance = F.struct(
        "category", F.col("bbox").cast("array<double>").alias("bbox"), F.col("area").cast("double").alias("pixel_area")
    )
    boxes = named_instances(instances, categories).select(
        "image_id", F.lit(False).alias("is_caption"), F.col("ord").cast("long").alias("ord"),
        instance.alias("instance"), F.lit(None).cast("string").alias("caption"),
    )
    texts = captions.select(
        "image_id", F.lit(True).alias("is_caption"), F.col("ord").cast("long").alias("ord"),
        F.lit(None).cast(INSTANCE).alias("instance"), "caption",
    )
    annotations = nest_ordered(
        boxes.unionByName(texts),
        ["image_id"],
        _ANNOTATION_ORDER,
        F.struct("is_caption", "instance", "caption"),
        "annotations",
        part_rows,
    )

    def of_kind(is_caption: bool, field: str) -> Column:
        wanted = F.filter("annotations", lambda a: a["is_caption"] == F.lit(is_caption))
        return F.transform(wanted, lambda a: a[field])

    return images.join(annotations, "image_id", "left").select(
        "image_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "file_name",
        F.coalesce(of_kind(False, "instance"), F.array().cast(f"array<{INSTANCE}>")).alias("instances"),
        F.coalesce(of_kind(True, "caption"), F.array().cast("array<string>")).alias("captions"),
    )


def debug_samples(
    images: DataFrame, instances: DataFrame, captions: DataFrame, categories: DataFrame, n: int = 30, part_rows: int = PART_ROWS
) -> DataFrame:
    """Samples of the first n images; the annotations of all others leave before any shuffle."""
    few = materialise(first_images(images, n))
    ids = F.broadcast(few.select("image_id"))  # n rows
    kept = [df.join(ids, "image_id", "left_semi") for df in (instances, captions)]
    return assemble_samples(few, *kept, categories, part_rows)


def caption_lists(images: DataFrame, captions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(image_id, part, captions): the captions of every image in order, without its instances."""
    nested = nest_ordered(captions, ["image_id"], ["ord"], F.col("caption"), "captions", part_rows)
    return images.select("image_id").join(nested, "image_id", "left").select(
        "image_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("captions", F.array().cast("array<string>")).alias("captions")
    )


def load_sample(
    image_id: int, images: DataFrame, instances: DataFrame, captions: DataFrame, categories: DataFrame
) -> DataFrame:
    """The sample of one image; the id reaches all three scans as a filter."""
    one = F.col("image_id") == image_id
    return assemble_samples(images.where(one), instances.where(one), captions.where(one), categories)


def sample_stats(images: DataFrame, instances: DataFrame, captions: DataFrame) -> DataFrame:
    """Per image the number of instances and captions and the total instance area.

    Areas are added as decimals, so the total does not depend on how the rows were split.
    """
    exact = "decimal(28,10)"
    counted = instances.select(
        "image_id", F.col("area").cast(exact).alias("area"), F.lit(1).alias("i"), F.lit(0).alias("c")
    ).unionByName(
        captions.select("image_id", F.lit(0).cast(exact).alias("area"), F.lit(0).alias("i"), F.lit(1).alias("c"))
    )
    totals = counted.groupBy("image_id").agg(
        F.sum("i").alias("n_instances"), F.sum("c").alias("n_captions"), F.sum("area").cast("double").alias("total_area")
    )
    return images.join(totals, "image_id", "left").select(
        "image_id",
        "file_name",
        F.coalesce("n_instances", F.lit(0)).alias("n_instances"),
        F.coalesce("n_captions", F.lit(0)).alias("n_captions"),
        F.coalesce("total_area", F.lit(0.0)).alias("total_area"),
    )


def caption_text(captions: Column | str = "captions") -> Column:
    """All captions of a sample as one text, one space between."""
    return F.array_join(captions, " ")
