"""Yes/no probes (object probing in the manner of Li et al. 2023): sets of questions, and their scores.

A set asks of every image for objects that it shows and for as many that it doesn't, chosen in one of three ways:
any, the most popular ones, or those that most often appear beside what the image shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise


def yes_no(answer: Column | str) -> Column:
    """Read a free answer: the words "no" and "not" in its first sentence mean no, all else yes."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    sentence = F.lower(F.substring_index(answer, ".", 1))
    return F.when(sentence.rlike(r"(^|[^a-z])(no|not)($|[^a-z])"), F.lit("no")).otherwise(F.lit("yes"))


def score_probes(
    probes: DataFrame, by: list[str], *, label: str = "label", prediction: Column | None = None, output: str = "output"
) -> DataFrame:
    """Confusion counts and rates per group; a rate with an empty denominator is NULL.

    ``label`` and the prediction hold "yes" or "no"; by default the prediction is read from ``output``.
    """
    predicted = (yes_no(output) if prediction is None else prediction) == "yes"
    actual = F.col(label) == "yes"

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    totals = probes.groupBy(*by).agg(
        count(predicted & actual).alias("tp"),
        count(predicted & ~actual).alias("fp"),
        count(~predicted & ~actual).alias("tn"),
        count(~predicted & actual).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return totals.select(
        *by, "tp", "fp", "tn", "fn",
        F.try_divide(tp + tn, n).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp + fp, n).alias("yes_ratio"),
    )


RANDOM, POPULAR, ADVERSARIAL = "random", "popular", "adversarial"


def probe_sets(
    shown: DataFrame, image: str, name: str, *, per_image: int = 3, pool: int | None = None, start: Column | None = None,
    question: str = "Is there a {} in the image?",
) -> DataFrame:
    """(image, probe_set, place, object, label, question): the probes of every image, from what is shown in it.

    ``shown`` has a row for each object in an image; repeated rows, and null images or names, don't count. Objects are ranked by
    the number of images that show them, ties by name. An image is asked for the first ``per_image`` of its own
    objects (label yes), and in each set for as many others (label no):

    * random: going round the ranks from a place that depends on the image alone (``start``, a number from 0;
      by default a hash of the image),
    * popular: the first ranks,
    * adversarial: by the number of images that show it together with one of the image's objects, for the one
      with most; ties by rank. Chosen from all ranks, or from the first ``pool`` if the caller wants that.

    An image that leaves fewer objects over gets fewer. Absent ranks are found within the row, as whole numbers that
    aren't in the image's list, so images never meet the table of objects; the number of objects must fit an array.

    What is read several times is written once: the ranks and what is beside an object (a row for each object), and each image's
    ranks. A window over all rows has one partition, which a join with it would bring all other rows to; written, it hasn't.
    """
    own = shown.select(F.col(image).alias("image"), F.col(name).alias("object")).where("image IS NOT NULL AND object IS NOT NULL")
    own = materialise(own.distinct())
    counts = own.groupBy("object").agg(F.count(F.lit(1)).alias("n"))
    # ranks of all objects: a window over a table that has a row for each
    ranks = materialise(counts.select("object", F.row_number().over(Window.orderBy(F.desc("n"), "object")).alias("rank")))
    objects = ranks.count()
    placed = own.join(ranks, "object").select("image", "rank")
    images = materialise(placed.groupBy("image").agg(F.sort_array(F.collect_list("rank")).alias("own")))
    size = F.size("own")
    first = F.pmod(F.xxhash64("image") if start is None else start, F.lit(max(objects, 1)))

    def absent(numbers: Column) -> Column:
        return F.slice(F.array_except(numbers, F.col("own")), 1, per_image)

    last = F.least(F.lit(objects), size + per_image)
    around = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.pmod(first + i, F.lit(objects)).cast("int") + 1)
    chosen = images.select(
        "image", "own", F.slice("own", 1, per_image).alias("yes"),
        absent(around).alias(RANDOM), absent(F.sequence(F.lit(1), last)).alias(POPULAR),
    )

    # neighbours: objects beside an object, most frequent first. An image has all but one of its own objects in such a list at
    # most, so behind as many entries and ``per_image`` more nothing can be chosen, and no list is longer than the largest image needs
    known = F.col("own") if pool is None else F.filter("own", lambda x: x <= pool)
    beside = images.select(F.explode("own").alias("rank"), known.alias("known")).select("rank", F.explode("known").alias("other")).where("rank <> other")
    pairs = beside.groupBy("rank", "other").agg(F.count(F.lit(1)).alias("n"))
    most = (images.agg(F.max(size)).first()[0] or 0) - 1 + per_image
    by_frequency = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "other"))
    foremost = pairs.withColumn("at", by_frequency).where(F.col("at") <= most)
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "other")))
    neighbours = materialise(foremost.groupBy("rank").agg(order.alias("near")))
    # of each list, what the image lacks: the first ``per_image`` of them hold all that can be chosen
    lists = chosen.select("image", "own", F.explode("own").alias("rank")).join(neighbours, "rank")
    needed = F.slice("near", F.lit(1), size - 1 + per_image)
    lacking = F.slice(F.filter(needed, lambda x: ~F.array_contains(F.col("own"), x["other"])), 1, per_image)
    offered = lists.select("image", F.explode(lacking).alias("x")).groupBy("image", F.col("x.other").alias("other")).agg(F.min("x.n").alias("n"))
    by_count = F.row_number().over(Window.partitionBy("image").orderBy("n", "other"))
    adversarial = offered.withColumn("place", by_count - 1).where(F.col("place") < per_image)

    def asked(kind: str, label: str, column: str) -> DataFrame:
        return chosen.select("image", F.lit(kind).alias("probe_set"), F.lit(label).alias("label"), F.posexplode(column).alias("place", "rank"))

    probes = None
    for kind in (RANDOM, POPULAR, ADVERSARIAL):
        no = adversarial.select("image", F.lit(kind).alias("probe_set"), F.lit("no").alias("label"), "place", F.col("other").alias("rank"))
        part = asked(kind, "yes", "yes").unionByName(no if kind == ADVERSARIAL else asked(kind, "no", kind))
        probes = part if probes is None else probes.unionByName(part)
    text = F.concat(*[F.lit(t) if n % 2 == 0 else F.col("object") for n, t in enumerate(_around(question))])
    return probes.join(ranks, "rank").select(F.col("image").alias(image), "probe_set", "place", "object", "label", text.alias("question"))


def _around(question: str) -> list[str]:
    before, after = question.split("{}")
    return [before, "", after]
