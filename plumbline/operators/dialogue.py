"""Dialogues between an evaluator (chat model) and the evaluated model.

All dialogues advance in step: a round is one chat stage over the active dialogues and one
inference stage over those that go on. Each stage writes what was said in it, and nothing else; a
dialogue's history is put together from these by its id when it is needed. A run that died goes on,
given the same ``work_dir``, after the last stage that was written whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.prompts import MESSAGES, as_json, fill_template, message, opening_messages
from plumbline.functions.text import join_path
from plumbline.operators.inference import ChatClient, Predictor, batch_infer, chat_complete
from plumbline.operators.transcripts import END_MARKER, EVALUATEE, EVALUATOR, TRANSCRIPT
from plumbline.session import shared_dir, stage_once

SYSTEM = "You talk with a vision-language model about an image in order to test it."
TEMPLATE = (
    "Talk with the model about the image described below, one message at a time, and ask about "
    "everything the description covers. Answer " + END_MARKER + " when you are done.\n{}"
)


def run_dialogues(
    samples: DataFrame,
    make_evaluator: Callable[[], ChatClient],
    make_model: Callable[[], Predictor],
    *,
    image: str = "file_name",
    image_dir: str = "",
    hide: tuple[str, ...] = (),
    system: str = SYSTEM,
    template: str = TEMPLATE,
    marker: str = END_MARKER,
    max_turns: int,
    work_dir: str | None = None,
    out: str = "conversation",
    partitions: int | None = None,
    **chat_options,
) -> DataFrame:
    """Add the ``out`` transcript and a ``status`` to every sample row.

    The evaluator sees the sample (as JSON, without the ``hide`` columns) and the history; the
    model sees the current message only. ``status`` is ``ended`` (the marker was said),
    ``failed`` (the evaluator gave no reply) or ``max_turns``. Every row is a dialogue of its own.
    """
    spark = samples.sparkSession
    work = work_dir or shared_dir(spark)
    columns = samples.columns
    held = stage_once(samples.withColumn("_dialogue", F.expr("uuid()")), f"{work}/samples")
    opening = opening_messages(system, fill_template(template, as_json(columns, hide))).cast(MESSAGES)

    said: list[DataFrame] = []  # (_dialogue, at, role, content): what each stage added
    ended: list[DataFrame] = []  # (_dialogue, status)
    active = held.select("_dialogue")
    for turn in range(max_turns):
        asking = held.join(active, "_dialogue").select(*columns, "_dialogue", opening.alias("_messages"))
        if said:
            asking = asking.join(_histories(said), "_dialogue").withColumn(
                "_messages", F.concat("_messages", F.transform("_history", _as_sent).cast(MESSAGES))
            )
        asked = chat_complete(
            asking.select("_dialogue", "_messages"), "_messages", make_evaluator, out="_reply", partitions=partitions, **chat_options
        ).select(
            "_dialogue",
            F.when(F.col("_reply_error").isNull(), F.col("_reply")).alias("content"),
            F.when(F.col("_reply_error").isNotNull(), F.lit("failed"))
            .when(F.col("_reply").contains(marker), F.lit("ended"))
            .alias("status"),
        )
        asked = stage_once(asked, f"{work}/asked-{turn}")
        said.append(_turns(asked.where("content IS NOT NULL"), 2 * turn, EVALUATOR))
        ended.append(asked.where("status IS NOT NULL").select("_dialogue", "status"))

        path = join_path(image_dir, F.col(image)) if image_dir else F.col(image)
        going = asked.where("status IS NULL").select("_dialogue", F.col("content").alias("_question"))
        shown = held.select("_dialogue", path.alias("_path")).join(going, "_dialogue")
        answered = batch_infer(shown, make_model, image="_path", question="_question", out="content", partitions=partitions)
        answered = stage_once(answered.select("_dialogue", "content"), f"{work}/answered-{turn}")
        said.append(_turns(answered, 2 * turn + 1, EVALUATEE))
        active = answered.select("_dialogue")
        if active.isEmpty():
            break

    statuses = ended[0]
    for more in ended[1:]:
        statuses = statuses.union(more)
    whole = F.transform("_history", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return (
        held.join(_histories(said), "_dialogue", "left")
        .join(statuses, "_dialogue", "left")
        .select(
            *columns,
            F.coalesce(whole.cast(TRANSCRIPT), F.array().cast(TRANSCRIPT)).alias(out),
            F.coalesce("status", F.lit("max_turns")).alias("status"),
        )
    )


def _turns(stage: DataFrame, at: int, role: str) -> DataFrame:
    return stage.select("_dialogue", F.lit(at).alias("at"), F.lit(role).alias("role"), "content")


def _histories(said: list[DataFrame]) -> DataFrame:
    """What was said in each dialogue, in order: at most two messages a round."""
    turns = said[0]
    for more in said[1:]:
        turns = turns.union(more)
    return turns.groupBy("_dialogue").agg(F.sort_array(F.collect_list(F.struct("at", "role", "content"))).alias("_history"))


def _as_sent(m):
    """A turn as the evaluator's chat sees it: its own words are the assistant's."""
    return F.when(m["role"] == EVALUATOR, message("assistant", m["content"])).otherwise(message("user", m["content"]))
