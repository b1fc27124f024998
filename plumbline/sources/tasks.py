"""Question rows, results and transcripts on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.transcripts import explode_transcripts
from plumbline.sources.jsonarrays import read_json_array, write_json_array


def read_rows(spark: SparkSession, path: str, format: str = "json", schema: StructType | str | None = None) -> DataFrame:
    """Rows from ``json`` (files holding an array each, read by many tasks), ``jsonl`` or ``parquet``.

    Keys beyond the required ones are kept as columns. Give a schema for large inputs: without
    one the JSON text is read once more to find it.
    """
    if format == "json":
        return read_json_array(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if format == "jsonl":
        return reader.json(path)
    if format == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {format!r}")


def read_tasks(spark: SparkSession, path: str, format: str = "json", schema: StructType | str | None = None) -> DataFrame:
    """Question rows: ``image`` and ``question`` at least."""
    tasks = read_rows(spark, path, format, schema)
    missing = {"image", "question"} - set(tasks.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return tasks


def write_rows(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a directory of part files; every task writes its own rows, so a crash loses one task.

    ``array`` writes one file that holds one JSON array, for readers that expect that; its rows have no fixed order.
    """
    if format == "array":
        return write_json_array(df, path)
    if format not in ("parquet", "json"):
        raise ValueError(f"unknown format {format!r}")
    df.write.mode("overwrite").format(format).save(path)


def write_conversations(samples: DataFrame, path: str, format: str = "json") -> None:
    """Samples with their nested ``conversation``."""
    write_rows(samples, path, format)


def read_conversations(spark: SparkSession, path: str, format: str = "jsonl", schema: StructType | str | None = None) -> DataFrame:
    """Samples with ``conversation``, as written above or as one JSON array."""
    return read_rows(spark, path, format, schema)


def read_turns(spark: SparkSession, path: str, format: str = "jsonl", schema: StructType | str | None = None) -> DataFrame:
    """The same, one row per turn."""
    return explode_transcripts(read_conversations(spark, path, format, schema))


def write_gradings(samples: DataFrame, path: str, format: str = "json") -> None:
    """Samples with ``grading_results`` and ``conversation``."""
    last = ["grading_results", "conversation"]
    write_rows(samples.select(*[c for c in samples.columns if c not in last], *[F.col(c) for c in last]), path, format)
