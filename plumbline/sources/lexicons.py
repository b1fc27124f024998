"""Word lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.arrays import listed
from plumbline.functions.text import last_word, strip
from plumbline.session import materialise, spread

# A word list up to this size is compiled into the expressions as a hash set; longer ones are joined.
MAX_INLINE_ENTRIES = 50_000


def lexicon_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped lines without the empty ones, each once."""
    return lines.select(strip(column).alias("entry")).where(F.length("entry") > 0).distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A word list from text files, one entry per line."""
    return lexicon_entries(spark.read.text(path))


def lexicon_values(lexicon: DataFrame | Iterable[str], most: int | None = None) -> list[str] | None:
    """Entries of a word list for use inside expressions, or None if they are more than ``most``.

    A longer list is a table: ``document_hits`` and ``flag_members`` join it.
    """
    most = MAX_INLINE_ENTRIES if most is None else most
    if isinstance(lexicon, DataFrame):
        rows = lexicon.limit(most + 1).collect()
        values = [r[0] for r in rows]
    else:
        values = list(lexicon)
    return sorted(set(values)) if len(values) <= most else None


def lexicon_table(spark: SparkSession, lexicon: DataFrame | Iterable[str]) -> DataFrame:
    """A word list as a table with the one column ``entry``."""
    if isinstance(lexicon, DataFrame):
        return lexicon.select(F.col(lexicon.columns[0]).alias("entry"))
    return spark.createDataFrame([(x,) for x in lexicon], "entry string")


def document_hits(
    df: DataFrame, phrases: dict[str, tuple[Column, DataFrame]], parse: Callable[[DataFrame], DataFrame] | None = None,
    even: bool = False,
) -> DataFrame:
    """Add, under each name, which of a row's phrases its word list holds, for lists of any size.

    ``phrases`` gives by name an array of phrases and the list as a table. The rows are written once with a number;
    each phrase of a row goes out once and meets the lists by hash, and only hits come back. A phrase that is in
    many rows is a hot key of a join that AQE splits. With ``parse`` the phrases are columns of ``parse(df)``, which keeps
    all columns: the rows are written and meet the hits as they are before it. ``even`` deals the written rows out evenly
    before costly column work.
    """
    held = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    held = spread(held) if even else held
    asking = held if parse is None else parse(held)

    def of_list(n: int, phrase: Column) -> Column:
        return F.transform(F.array_distinct(phrase), lambda x: F.struct(F.lit(n).alias("list"), x.alias("entry")))

    # a null array would make the whole concatenation null
    nothing = F.array().cast("array<struct<list:int,entry:string>>")
    asked = F.concat(*[F.coalesce(of_list(n, phrase), nothing) for n, (phrase, _) in enumerate(phrases.values())])
    offered = listed(asking, ["_row"], asked, "_at").drop("_at")
    entries = None
    for n, (_, lexicon) in enumerate(phrases.values()):
        part = lexicon.select(F.lit(n).alias("list"), F.col(lexicon.columns[0]).alias("entry"))
        entries = part if entries is None else entries.unionByName(part)
    hits = offered.join(entries, ["list", "entry"], "left_semi")
    found = hits.groupBy("_row").agg(
        *[F.collect_list(F.when(F.col("list") == n, F.col("entry"))).alias(f"_hits{n}") for n in range(len(phrases))]
    )
    none = F.array().cast("array<string>")
    named = [F.coalesce(f"_hits{n}", none).alias(name) for n, name in enumerate(phrases)]
    return held.join(found, "_row", "left").select(*df.columns, *named)


def flag_members(df: DataFrame, phrase: str, lexicon: DataFrame, out: str, *, or_last_word: bool = False) -> DataFrame:
    """Flag rows whose phrase (or its last word) is listed, for word lists of any size.

    The join has no hint: Catalyst broadcasts the list while its size allows that and
    shuffles both sides beyond, where AQE splits phrases that are hot.
    """
    entries = lexicon.select(F.col(lexicon.columns[0]).alias("_entry")).distinct()

    def flagged(rows: DataFrame, key: Column, flag: str) -> DataFrame:
        hits = entries.withColumn(flag, F.lit(True))
        return (
            rows.join(hits, key == F.col("_entry"), "left")
            .drop("_entry")
            .withColumn(flag, F.coalesce(flag, F.lit(False)))
        )

    rows = flagged(df, F.col(phrase), out)
    if or_last_word:
        rows = flagged(rows, last_word(phrase), "_by_last_word")
        rows = rows.withColumn(out, F.col(out) | F.col("_by_last_word")).drop("_by_last_word")
    return rows
