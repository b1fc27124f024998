"""Which span covers a position, over tables.

The counterpart of the look-up that extraction does within a row, for tokens and spans that are rows: documents too
long for one row, or spans from another source. Positions and spans meet by hash, never as all pairs of a document:
a span covers whole bins of ``BIN`` positions, which it is listed for bin by bin, and at its two ends single positions. Of
spans that cover the same bin or position only the first one is kept, before any position is joined, so spans that
overlap, however many, don't multiply rows. A long document is many bins, that is, many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 64


def _range(first: Column, end: Column) -> Column:
    """first, ..., end - 1"""
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def locate(
    rows: DataFrame, spans: DataFrame, keys: list[str], position: str, out: str, *,
    number: str = "entity_id", start: str = "start", end: str = "end", bin_size: int = BIN,
) -> DataFrame:
    """``rows`` with ``out``: the least number of the spans [start, end) of the same keys that cover the position.

    Null where there is none. Empty and reversed spans cover nothing; a null key or position is covered by nothing.
    """
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    held = spans.where(b > a).select(
        *keys, F.col(number).alias("_n"), a.alias("_a"), b.alias("_b"),
        F.ceil(a / bin_size).cast("long").alias("_first"), F.floor(b / bin_size).cast("long").alias("_end"),
    )
    first, stop = F.col("_first"), F.col("_end")
    bins = held.select(*keys, "_n", F.explode(_range(first, stop)).alias("_bin"))
    bins = bins.groupBy(*keys, "_bin").agg(F.min("_n").alias("_by_bin"))
    # without a whole bin in between, the ends are all of the span
    edges = F.when(
        stop > first, F.concat(_range(F.col("_a"), first * bin_size), _range(stop * bin_size, F.col("_b")))
    ).otherwise(_range(F.col("_a"), F.col("_b")))
    places = held.select(*keys, "_n", F.explode(edges).alias("_place"))
    places = places.groupBy(*keys, "_place").agg(F.min("_n").alias("_by_place"))
    asked = rows.withColumn("_place", F.col(position).cast("long")).withColumn("_bin", F.floor(F.col("_place") / bin_size).cast("long"))
    found = asked.join(places, [*keys, "_place"], "left").join(bins, [*keys, "_bin"], "left")
    return found.select(*rows.columns, F.least("_by_place", "_by_bin").alias(out))


def locate_relations(relations: DataFrame, spans: DataFrame, keys: list[str], **names) -> DataFrame:
    """Relations between token positions -> relations between spans; one without a span at either end goes."""
    subjects = locate(relations, spans, keys, "subject", "_subject", **names)
    both = locate(subjects, spans, keys, "object", "_object", **names)
    kept = both.where(F.col("_subject").isNotNull() & F.col("_object").isNotNull())
    return kept.withColumns({"subject": F.col("_subject"), "object": F.col("_object")}).drop("_subject", "_object")
