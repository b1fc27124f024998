"""Reading graders' replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import _col

GRADING = "struct<sentence:string,result_type:int,reason:string>"
GRADINGS = f"array<{GRADING}>"

_FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
# The code is read as text first: an int field turns a quoted "0" into NULL.
_RAW = "array<struct<sentence:string,result_type:string,reason:string>>"


def fenced_body(c: Column | str) -> Column:
    """Body of the first triple-backtick fence, or the whole text when there is none."""
    c = _col(c)
    return F.coalesce(F.nullif(F.regexp_extract(c, _FENCE, 1), F.lit("")), c)


def parse_gradings(c: Column | str) -> Column:
    """Reply text -> list of sentence gradings, NULL unless the reply is acceptable.

    Acceptable is a JSON list of objects, or one object, and nothing around it but a fence; each has a
    sentence. A code that isn't a whole number is NULL and costs the other sentences nothing; ``grade_samples``
    counts such codes. The retry test of graders follows the same rule.
    """
    body = F.trim(fenced_body(c))
    rows = F.transform(
        F.from_json(body, _RAW, {"allowSingleQuotes": "false"}),
        lambda x: F.struct(
            x["sentence"].alias("sentence"),
            x["result_type"].try_cast("int").alias("result_type"),
            x["reason"].alias("reason"),
        ),
    )
    whole = body.rlike(r"(?s)^\s*(\[.*\]|\{.*\})\s*$")
    usable = F.forall(rows, lambda x: x["sentence"].isNotNull())
    return F.when(whole & usable, rows)
