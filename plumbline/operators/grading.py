"""Grading every answer of the evaluated model, sentence by sentence, with a chat model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import listed
from plumbline.functions.prompts import as_json, fill_template, opening_messages
from plumbline.functions.replies import GRADINGS, parse_gradings
from plumbline.operators.inference import ChatClient, chat_complete, is_grading
from plumbline.operators.nesting import PART_ROWS, nest_ordered
from plumbline.operators.transcripts import LAYOUT, evaluatee_turns, explode_transcripts
from plumbline.session import materialise

SYSTEM = "You judge whether statements about an image are supported by its description."
TEMPLATE = (
    "Description of the image:\n{}\n\nText to judge:\n{}\n\n"
    "Judge each sentence. Answer with a JSON list only, one object per sentence: "
    '[{{"sentence": "...", "result_type": 0, "reason": "..."}}] where result_type is '
    "0 for a contradiction, 1 for a supported and 2 for an unverifiable sentence."
)


def grader_messages(
    samples: DataFrame,
    *,
    conversation: str = "conversation",
    hide: tuple[str, ...] = (),
    system: str = SYSTEM,
    template: str = TEMPLATE,
) -> DataFrame:
    """One row per answer to be graded, with the ``messages`` to send.

    The transcript is not part of the description: the prompt is made from the sample's other
    columns and the one answer.
    """
    columns = [c for c in samples.columns if c not in (conversation, *LAYOUT)]
    return evaluatee_turns(explode_transcripts(samples, conversation)).withColumn(
        "messages",
        opening_messages(system, fill_template(template, as_json(columns, hide), F.col("content"))),
    )


def concat_gradings(gradings: DataFrame, keys: list[str], *, turn: str = "turn", results: str = "gradings", part_rows: int = PART_ROWS) -> DataFrame:
    """All result lists of a sample joined in turn order (unparsed replies add nothing).

    A sample of more than ``part_rows`` answers comes in parts, which count answers.
    """
    lists = F.coalesce(F.col(results), F.array().cast(GRADINGS))
    return nest_ordered(gradings, keys, [turn], lists, "grading_results", part_rows).withColumn(
        "grading_results", F.flatten("grading_results")
    )


def grading_table(gradings: DataFrame, *keys: str, results: str = "gradings") -> DataFrame:
    """One row per graded sentence."""
    return listed(gradings, keys, results, "ord")


def grade_samples(
    samples: DataFrame,
    make_client: Callable[[], ChatClient],
    *,
    conversation: str = "conversation",
    hide: tuple[str, ...] = (),
    system: str = SYSTEM,
    template: str = TEMPLATE,
    work_dir: str | None = None,
    **chat_options,
) -> DataFrame:
    """Samples with ``grading_results``, ``ungraded`` (answers without an acceptable reply) and ``uncoded``
    (sentences whose code could not be read).

    Every row is graded by itself, whatever its columns hold: it gets an id of its own, which is written
    before the calls. The replies are written before they are used, so joining them back costs no
    second call. A row's answers came out of its one list, so its gradings fit into one.
    """
    held = materialise(samples.withColumn("_sample", F.expr("uuid()")), work_dir and f"{work_dir}/samples")
    asked = chat_complete(
        grader_messages(held, conversation=conversation, hide=(*hide, "_sample"), system=system, template=template).select(
            "_sample", "turn", "messages"
        ),
        "messages",
        make_client,
        check=is_grading,
        **chat_options,
    ).select("_sample", "turn", F.when(F.col("reply_error").isNull(), parse_gradings("reply")).alias("gradings"))
    graded = materialise(asked, work_dir and f"{work_dir}/graded")

    lists = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("gradings", F.array().cast(GRADINGS)).alias("g")))), lambda x: x["g"]
    )
    done = graded.groupBy("_sample").agg(
        F.flatten(lists).alias("grading_results"), F.count_if(F.col("gradings").isNull()).alias("ungraded")
    )
    return held.join(done, "_sample", "left").select(
        *samples.columns,
        F.coalesce("grading_results", F.array().cast(GRADINGS)).alias("grading_results"),
        F.coalesce("ungraded", F.lit(0)).alias("ungraded"),
        F.coalesce(F.size(F.filter("grading_results", lambda g: g["result_type"].isNull())), F.lit(0)).alias("uncoded"),
    )
