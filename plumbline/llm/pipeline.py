"""The stages of the corpus pipeline; see ``corpus_pipeline.py`` at the top of the repository."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import linededup, nearcopies, packing, secrets, toxicity
from plumbline.llm.common import prepare, read
from plumbline.llm.queries import TOXIC_FOLDS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, doesn't reject.

    Null and empty texts have the score of the bias alone; without labelled rows every score is 0.5 and goes, as toxic
    as not. Equal texts, and rows that are repeated, are all kept or all rejected. An empty table stays empty.
    """
    prepare(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), "toxic", *TOXIC_FOLDS)
    return docs.select(*COLUMNS).where(toxicity.score("text", model) < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that only repeats earlier lines goes."""
    prepare(spark)
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    words_left = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0
    return _documents(kept.where((F.col("n_equal") + F.col("n_near") == 0) | words_left))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, see ``nearcopies``: that of the smallest id, null ids stay.

    Null texts and texts without words are copies of each other. An empty table stays empty.
    """
    prepare(spark)
    return nearcopies.drop_near_copies(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked. Null texts stay null; rows stay as many as they are, equal ones equal."""
    prepare(spark)
    return _documents(docs.withColumn("text", secrets.redacted("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. Null and empty texts are the closing id alone; repeated rows are packed each."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]
