"""Array helpers that keep per-document work linear and inside one row.

A document's tokens sit in one array, so a look-up "all entries with key k" must not scan the
array for every k. ``keyed`` sorts the entries by key and notes where each key starts; from
then on a look-up is two ``get`` calls and a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Spark copies what a lambda returns, so this is for small results; see ``computed``.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain ``withColumn`` may be repeated by the optimizer wherever the column is used - a
    filter above, say, is pushed down with the whole expression in place of the column, and in
    a chain of array columns that multiplies. Nothing is pushed or merged through a generator,
    and the generator here makes one row of one: no shuffle, no extra rows.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode_outer(F.array(packed)).alias("_computed")).select(
        *kept, *[F.col(f"_computed.{name}").alias(name) for name in columns]
    )


def listed(df: DataFrame, keys: Sequence[str], array: Column | str, position: str) -> DataFrame:
    """One row per element of an array of structs: keys, its position, its fields.

    The outer form with the test behind it keeps Catalyst from adding a "not empty" filter
    below the generator, which would compute the array a second time.
    """
    return (
        df.select(*keys, F.posexplode_outer(array).alias(position, "_x"))
        .where(F.col(position).isNotNull())
        .select(*keys, position, "_x.*")
    )


def indices(array: Column) -> Column:
    """0-based positions of an array (empty for an empty array)."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def keyed(entries: Column) -> Column:
    """array<struct<k,...>> -> struct<entries, starts>: the entries sorted, and per key from 0
    to one past the last the place where its entries start. Keys are non-negative ints.
    """
    return let(F.sort_array(entries), index_of)


def index_of(e: Column) -> Column:
    """What ``keyed`` gives, of a column of entries that are sorted already."""
    firsts = F.filter(indices(e), lambda j: F.coalesce(F.get(e, j)["k"] != F.get(e, j - 1)["k"], F.lit(True)))
    # the first entry of a key opens every key above its predecessor's up to its own
    opened = F.transform(firsts, lambda j: F.array_repeat(j, F.get(e, j)["k"] - F.coalesce(F.get(e, j - 1)["k"], F.lit(-1))))
    return F.struct(e.alias("entries"), F.concat(F.flatten(opened), F.array(F.size(e))).alias("starts"))


def _bounds(index: Column, key: Column) -> tuple[Column, Column]:
    begin = F.coalesce(F.get(index["starts"], key), F.size(index["entries"]))
    return begin, F.coalesce(F.get(index["starts"], key + 1), begin)


def entries_of(index: Column, key: Column) -> Column:
    """All entries of a key, in order. Most look-ups find none, so that is decided first."""
    begin, end = F.get(index["starts"], key), F.get(index["starts"], key + 1)
    return F.when(end > begin, F.slice(index["entries"], begin + 1, end - begin)).otherwise(F.slice(index["entries"], 1, 0))


def first_of(index: Column, key: Column) -> Column:
    begin, end = _bounds(index, key)
    return F.when(end > begin, F.get(index["entries"], begin))


def last_of(index: Column, key: Column) -> Column:
    begin, end = _bounds(index, key)
    return F.when(end > begin, F.get(index["entries"], end - 1))


def last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)
