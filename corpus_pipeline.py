"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the documents of the next.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.llm.common import land, read  # noqa: E402
from plumbline.llm.pipeline import STAGES  # noqa: E402

# Classifier, fingerprints and tokenizer have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = land(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
