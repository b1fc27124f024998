"""The jobs from input files to output files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.prompts import decoding_options
from plumbline.functions.text import join_path
from plumbline.operators import dialogue, grading, inference, samples, scenegraph, scoring
from plumbline.sources import annotations, tasks


def answer_questions(
    spark: SparkSession,
    infile: str,
    outfile: str,
    make_predictor: Callable[[], inference.Predictor],
    *,
    image_dir: str = "",
    format: str = "json",
    out_format: str = "parquet",
    schema=None,
    partitions: int | None = None,
    model: str | None = None,
) -> None:
    """Question rows -> the same rows with a normalised ``output``. The image column stays as read.

    ``model`` names a family whose generation settings the predictor is made with.
    """
    rows = tasks.read_tasks(spark, infile, format, schema)
    path = join_path(image_dir, F.col("image")) if image_dir else F.col("image")
    answered = inference.batch_infer(
        rows.withColumn("_path", path), make_predictor, image="_path", partitions=partitions,
        options=decoding_options(model) if model else None,
    )
    tasks.write_rows(answered.drop("_path"), outfile, out_format)


def hold_dialogues(
    rows: DataFrame,
    outfile: str,
    make_evaluator: Callable[[], inference.ChatClient],
    make_model: Callable[[], inference.Predictor],
    **options,
) -> None:
    """Samples -> samples with ``conversation`` and ``status``; options as for ``run_dialogues``."""
    tasks.write_conversations(dialogue.run_dialogues(rows, make_evaluator, make_model, **options), outfile)


def grade_conversations(
    spark: SparkSession,
    infile: str,
    outfile: str,
    make_client: Callable[[], inference.ChatClient],
    *,
    schema=None,
    **options,
) -> None:
    """Conversations -> the same samples with ``grading_results``; options as for ``grade_samples``."""
    held = tasks.read_conversations(spark, infile, schema=schema)
    tasks.write_gradings(grading.grade_samples(held, make_client, **options), outfile)


def assemble_files(spark: SparkSession, instances: str, captions: str, outfile: str, *, debug: int | None = None) -> None:
    """Annotation files -> samples; with ``debug`` those of the first so many images only."""
    tables = annotations.read_instances(spark, instances)
    tables["captions"] = annotations.read_captions(spark, captions)
    made = samples.assemble_samples(**tables) if debug is None else samples.debug_samples(**tables, n=debug)
    tasks.write_rows(made, outfile)


def judge_samples(
    truth: DataFrame, answers: DataFrame, make_annotator: Callable[[], inference.Annotator], *, case: str = "file_name", **options
) -> DataFrame:
    """Hallucination counts of answers (case, text) against the joined captions of samples."""
    texts = truth.select(case, samples.caption_text().alias("text"))
    return judge_texts(texts, answers.select(case, "text"), make_annotator, case=case, **options)


def judge_texts(
    ground_truth: DataFrame,
    answers: DataFrame,
    make_annotator: Callable[[], inference.Annotator],
    *,
    case: str = "case_id",
    text: str = "text",
    phrasal_verbs: DataFrame | Iterable[str] = (),
    phrasal_preps: DataFrame | Iterable[str] = (),
    scene_nouns: DataFrame | Iterable[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Hallucination counts per case from ground-truth texts and model texts, any number of either.

    One pass: both sides are parsed and reduced to facts together.
    """
    sides = [
        df.select(case, text, F.lit(side).alias("side"))
        for df, side in ((ground_truth, scoring.TRUTH), (answers, scoring.MODEL))
    ]
    parsed = inference.annotate(sides[0].unionByName(sides[1]), text, make_annotator, partitions=partitions)
    graphs = scenegraph.extract_scene_graph(
        parsed.drop(text),
        phrasal_verbs=phrasal_verbs,
        phrasal_preps=phrasal_preps,
        scene_nouns=scene_nouns,
        keep_tokens=False,
    )
    return scoring.score_facts(scoring.graph_facts(graphs, case, "side"), case)
