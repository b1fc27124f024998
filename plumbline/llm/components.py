"""Connected components of a links table, by alternating large and small stars.

Every round is two joins and two combined aggregations over the links; nothing is collected per
node, so a hub with very many links is an ordinary (splittable) join key. Each round is written to
the shared folder, and the one before the last is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import remove, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of every node to its smallest neighbour."""
    if large:
        pairs = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = pairs.join(least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link; links are columns ``a`` and ``b`` of longs.

    The component is its smallest node. Loops and repeated links do no harm; links with a null end
    are left out; no links, no rows.
    """
    state, path = stage(links.select("a", "b").where("a != b").distinct())
    mark = None
    while True:
        following, written = stage(_star(_star(state, True), False))
        found = tuple(
            following.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)
            ).first()
        )
        remove(links.sparkSession, path)
        state, path = following, written
        if found == mark:
            break
        mark = found
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
