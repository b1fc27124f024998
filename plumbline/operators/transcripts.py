"""Multi-turn transcripts: long form ``(key, turn, role, content)``, nested form at the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import listed
from plumbline.operators.nesting import PART_ROWS, nest_ordered

EVALUATOR, EVALUATEE = "evaluator", "evaluatee"
END_MARKER = "END"
# Columns that say where a row's list lies in the whole one.
LAYOUT = ("part", "first_position")
TRANSCRIPT = "array<struct<role:string,content:string>>"


def truncate_at_marker(
    turns: DataFrame,
    key: str,
    *,
    marker: str = END_MARKER,
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    evaluator: str = EVALUATOR,
) -> DataFrame:
    """Keep turns up to and including the first evaluator turn whose text contains the marker.

    The first such turn is a minimum, combined before its shuffle to one row per transcript;
    unlike a window this never sorts a transcript inside one task, and AQE splits the join
    for a transcript of any length.
    """
    ends = (
        turns.where((F.col(role) == evaluator) & F.col(content).contains(marker))
        .groupBy(key)
        .agg(F.min(turn).alias("_end"))
    )
    return (
        turns.join(ends, key, "left")
        .where(F.col("_end").isNull() | (F.col(turn) <= F.col("_end")))
        .select(*turns.columns)
    )


def evaluatee_turns(turns: DataFrame, *, role: str = "role", evaluatee: str = EVALUATEE) -> DataFrame:
    """Only what the evaluated model said."""
    return turns.where(F.col(role) == evaluatee)


def nest_transcripts(
    turns: DataFrame,
    key: str,
    *,
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    out: str = "conversation",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Turns -> (key, part, first_position, out): an ordered list per transcript, in parts if oversized."""
    item = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    return nest_ordered(turns, [key], [turn], item, out, part_rows)


def explode_transcripts(samples: DataFrame, conversation: str = "conversation") -> DataFrame:
    """Nested transcripts -> turns, every other column kept but those of the layout; no shuffle.

    ``turn`` is the place in the whole transcript, also where it came in several parts.
    """
    rest = [c for c in samples.columns if c not in (conversation, *LAYOUT)]
    first = "first_position" if "first_position" in samples.columns else None
    turns = listed(samples, [*rest, *([first] if first else [])], conversation, "turn")
    turn = (F.col("turn") + F.coalesce(first, F.lit(0))).cast("int") if first else F.col("turn")
    return turns.select(*rest, turn.alias("turn"), "role", "content")
