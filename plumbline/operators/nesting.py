"""Ordered lists per key that survive a hot key.

Keys are counted first: rows and bytes, an aggregation that is combined before its shuffle. A key whose list a task can
hold (``LIST_ROWS`` or ``part_rows`` items, ``part_bytes`` of them) is nested by one shuffle on the key, and its list cut
into parts of ``part_rows`` within the row. Rows of the others are sorted by key and order into ranges, so a key is spread over as many tasks as it is
large, and written with their place in the range. Rows per range and key, added up over the ranges before, turn that
into the place in the whole list by addition. Rows then meet by key and part: nothing ever holds a key, or a range.

Part n of a list holds its positions n * part_rows to (n + 1) * part_rows - 1. If those are over ``part_bytes`` they
are cut again by running bytes and parts are numbered on; an item larger than that is a part by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

# Longest list in one row, in items and in bytes: layout parameters, the same for all keys.
PART_ROWS = 10_000
PART_BYTES = 64 << 20
# Longest list that is nested whole before it is cut into parts.
LIST_ROWS = 10_000
# Rows and bytes of a range of split keys.
RANGE_ROWS = 200_000
RANGE_BYTES = 128 << 20


def item_bytes(c: Column, kind: T.DataType) -> Column:
    """Size of a value: its text and bytes, 8 for everything else."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, (item_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda n, x: n + item_bytes(x, kind.elementType)), F.lit(8).cast("long"))
        return F.coalesce(F.size(c), F.lit(0)) * F.lit(8).cast("long") + 8
    if isinstance(kind, T.MapType):
        return item_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + item_bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def _join(df: DataFrame, facts: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join that takes null keys for equal and keeps one copy of them."""
    names = {c: f"_f{n}" for n, c in enumerate(columns)}
    renamed = facts.select(*[F.col(c).alias(names.get(c, c)) for c in facts.columns])
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()))
    return df.join(renamed, same, how).drop(*names.values())


def nest_ordered(
    df: DataFrame, keys: list[str], order: list[str], item: Column, out: str,
    part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(keys, part, first_position, out): ``out`` lists the items of the key in the given order.

    A key whose list fits is one row with part 0. ``first_position`` is the place of the part's first item in the
    whole list. Rows equal in keys and order are sorted by their items; null keys are a key.
    """
    rows = df.select(*keys, *order, item.alias("_item"))
    size = item_bytes(F.col("_item"), rows.schema["_item"].dataType)
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    n, b, held_rows = F.col("_n"), F.col("_b"), max(part_rows, min(range_rows, LIST_ROWS))
    large = (n > held_rows) | (b > part_bytes) | ((n > part_rows) & (b >= part_bytes))
    longest, n_rows, n_bytes = sized.agg(F.max(n), F.sum(F.when(large, n)), F.sum(F.when(large, b))).first()

    def nested(some: DataFrame) -> DataFrame:
        whole = _whole(some, keys, order, out)
        return whole if (longest or 0) <= part_rows else _cut(whole, keys, out, part_rows)

    if n_rows is None:
        return nested(rows)
    # at most one key for each part_rows rows or part_bytes of the table
    large_keys = materialise(sized.where(large).select(*keys))
    ranges = max(-(-n_rows // range_rows), -(-n_bytes // RANGE_BYTES))
    split = _join(rows, large_keys, keys, "left_semi")
    return nested(_join(rows, large_keys, keys, "left_anti")).unionByName(_split(split, keys, order, size, out, part_rows, part_bytes, ranges))


def _cut(lists: DataFrame, keys: list[str], out: str, part_rows: int) -> DataFrame:
    """Lists in parts of ``part_rows``; none is empty."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(out) - 1) / part_rows).cast("int")), lambda n: F.slice(out, n * part_rows + 1, part_rows))
    cut = lists.select(*keys, F.posexplode_outer(parts).alias("part", "_items"))
    return cut.select(*keys, F.coalesce("part", F.lit(0)).alias("part"), (F.col("part").cast("long") * part_rows).alias("first_position"), F.col("_items").alias(out))


def _whole(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(*order, "_item")))
    lists = rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["_item"]).alias(out))
    return lists.select(*keys, F.lit(0).alias("part"), F.lit(0).cast("long").alias("first_position"), out)


def _split(
    rows: DataFrame, keys: list[str], order: list[str], size: Column, out: str, part_rows: int, part_bytes: int, ranges: int
) -> DataFrame:
    by = [*keys, *order, "_item"]
    ranged = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in a range, rows are numbered in order
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_row", row))

    # as many rows as keys and ranges together: a range holds parts of two keys at most that others hold too
    runs = ranged.groupBy(*keys, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    bases = runs.select(*keys, "_range", (before - F.col("_first")).alias("_base"))
    placed = _join(ranged, bases, [*keys, "_range"]).withColumn("_at", F.col("_base") + F.col("_row"))
    placed = placed.withColumn("_part", F.floor(F.col("_at") / part_rows))

    earlier = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sliced = placed.withColumn("_slice", F.floor(F.coalesce(F.sum(size).over(earlier), F.lit(0)) / part_bytes))
    lists = materialise(
        sliced.groupBy(*keys, "_part", "_slice")
        .agg(F.min("_at").alias("first_position"), F.sort_array(F.collect_list(F.struct("_at", "_item"))).alias("_list"))
        .select(*keys, "_part", "_slice", "first_position", F.transform("_list", lambda x: x["_item"]).alias(out))
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_slice")) - 1
    numbers = lists.select(*keys, "_part", "_slice", number.alias("part"))
    return _join(lists, numbers, [*keys, "_part", "_slice"]).select(*keys, "part", "first_position", out)
