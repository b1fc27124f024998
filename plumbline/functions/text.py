"""Text clean-up and path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes, as Java patterns.
_EDGE_SPACE = r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of every kind from both ends (``F.trim`` removes blanks only)."""
    return F.regexp_replace(_col(c), _EDGE_SPACE, "")


def normalise_answer(c: Column | str) -> Column:
    """Strip, then delete every full stop, then lower-case - in that order."""
    return F.lower(F.replace(strip(c), F.lit("."), F.lit("")))


def join_path(directory: Column | str, name: Column | str) -> Column:
    """``directory/name``; an absolute ``name`` stands alone. ``directory`` may be a plain string."""
    base = F.lit(directory) if isinstance(directory, str) else directory
    name = _col(name)
    return (
        F.when(name.startswith("/") | (base == ""), name)
        .when(base.endswith("/"), F.concat(base, name))
        .otherwise(F.concat(base, F.lit("/"), name))
    )


def cut_at(c: Column | str, marker: str = "</s>") -> Column:
    """Text before the first end-of-sequence marker."""
    return F.substring_index(_col(c), marker, 1)


def after_prompt(ids: Column | str, prompt_length: Column | int) -> Column:
    """Generated ids that follow the prompt's ids."""
    ids = _col(ids)
    n = F.lit(prompt_length) if isinstance(prompt_length, int) else prompt_length
    return F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))


def last_word(c: Column | str) -> Column:
    return F.substring_index(_col(c), " ", -1)


def image_list(c: Column | str, sep: str = ",") -> Column:
    """Several images may share one field; the pieces are not trimmed."""
    # \Q..\E keeps the separator literal
    return F.split(_col(c), "\\Q" + sep + "\\E")


def is_remote(c: Column | str) -> Column:
    """http and https locations are fetched, everything else is opened as a file."""
    return _col(c).startswith("http")


def square_edge(width: Column | str, height: Column | str) -> Column:
    return F.greatest(_col(width), _col(height))
