"""Stages that call something outside Spark: a vision-language model, a chat model, a parser.

The callee is the caller's: each operator takes a factory that runs once per Python task and
returns the callable. Only the columns the callee needs cross to Python, in Arrow batches; the
others stay in the JVM. The functions are declared non-deterministic so that Catalyst never
evaluates one twice for a row. Still, a stage is only safe from being paid for twice once its
result is written: see ``materialise``.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalise_answer
from plumbline.operators.scenegraph import CHUNKS, TOKENS
from plumbline.session import materialise as materialise
from plumbline.session import exists, ship_package

# (images, questions) -> answers, for one batch of rows
Predictor = Callable[[list, list[str]], list[str]]
# (messages, model name) -> reply text
ChatClient = Callable[[list[dict], str], str]
# text -> (tokens, noun chunks), as dicts with the fields of TOKENS and CHUNKS
Annotator = Callable[[str], tuple[list[dict], list[dict]]]

REPLY = "struct<reply:string,error:string,attempts:int>"
PARSE = f"struct<tokens:{TOKENS},chunks:{CHUNKS}>"

# Rows that are put in order of their size before they are cut into batches.
WINDOW_ROWS = 4096


def row_size(image, question: str | None) -> int:
    """Words of the question, and bytes of the image where it comes as bytes."""
    return len((question or "").split()) + (len(image) if isinstance(image, (bytes, bytearray)) else 0)


def sized_batches(sizes: list[int], budget: int, most: int | None = None) -> list[list[int]]:
    """Places of rows in batches of alike sizes: the number of rows times the largest size stays within the budget.

    Largest first, rows of equal size in their order; a row beyond the budget is a batch by itself.
    """
    batches: list[list[int]] = []
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held = batches[-1] if batches else None
        if held and (len(held) + 1) * max(sizes[held[0]], 1) <= budget and (most is None or len(held) < most):
            held.append(place)
        else:
            batches.append([place])
    return batches


def batch_infer(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    *,
    image: str = "image",
    question: str = "question",
    out: str = "output",
    normalise: bool = True,
    partitions: int | None = None,
    batch_size: int | None = None,
    batch_budget: int | None = None,
    size: Callable[[object, str], int] = row_size,
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """Answer every (image, question) row; all columns are kept and ``out`` is added.

    ``options`` (see ``prompts.decoding_options``) are handed to ``make_predictor`` by name.

    ``partitions`` spreads the rows evenly over that many model instances first. The predictor gets
    ``batch_size`` rows at a time (default: an Arrow batch); give one where images come as bytes.

    With ``batch_budget``, rows of alike ``size`` go together, so little is padded: a task orders up to ``WINDOW_ROWS``
    rows by size and cuts them into batches whose padded size (rows times the largest) is within the budget.
    Answers come out in the order of the rows.
    """

    @F.pandas_udf("string")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make_predictor(**(options or {}))
        if batch_budget is not None:
            yield from by_size(predict, batches)
            return
        for images, questions in batches:
            step = batch_size or max(len(images), 1)
            for at in range(0, len(images), step):
                part = predict(images[at : at + step].tolist(), questions[at : at + step].tolist())
                yield pd.Series(part, dtype="object")

    def by_size(predict: Predictor, batches) -> Iterator[pd.Series]:
        images, questions = [], []
        for more_images, more_questions in (*batches, (None, None)):
            if more_images is not None:
                images += more_images.tolist()
                questions += more_questions.tolist()
                if len(images) < WINDOW_ROWS:
                    continue
            answers: list = [None] * len(images)
            for places in sized_batches([size(i, q) for i, q in zip(images, questions)], batch_budget, batch_size):
                for place, said in zip(places, predict([images[p] for p in places], [questions[p] for p in places])):
                    answers[place] = said
            if answers:
                yield pd.Series(answers, dtype="object")
            images, questions = [], []

    ship_package(df.sparkSession)
    rows = df if partitions is None else df.repartition(partitions)
    answered = rows.withColumn(out, answer.asNondeterministic()(image, question))
    return answered.withColumn(out, normalise_answer(out)) if normalise else answered


def chat_complete(
    df: DataFrame,
    messages: str,
    make_client: Callable[[], ChatClient],
    *,
    out: str = "reply",
    model: str = "gpt-4o",
    max_retries: int,
    backoff: float = 1.0,
    check: Callable[[str], bool] | None = None,
    concurrency: int = 1,
    partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Send each row's chat messages; adds ``out`` and ``<out>_error``.

    A call that fails, or whose reply ``check`` refuses, is repeated after a pause, at most
    ``max_retries`` times; then the error column says why and the last reply, if any, is kept.

    ``store`` names a folder of replies by hash of model and messages. What it holds a good one for is not
    asked again, and equal requests are asked once. Each task adds its replies when it ends, whatever becomes of the
    job: a run that dies leaves what its finished tasks were told, and the next one asks for the rest.
    """
    if store is not None:
        return _stored(
            df, messages, out, model, store,
            lambda todo: chat_complete(
                todo, messages, make_client, out=out, model=model, max_retries=max_retries, backoff=backoff,
                check=check, concurrency=concurrency, partitions=partitions,
            ),
        )

    def one(client: ChatClient, text: str) -> tuple[str | None, str | None, int]:
        reply, error = None, None
        for attempt in range(1, max_retries + 2):
            try:
                reply = client(json.loads(text), model)
                if check is None or check(reply):
                    return reply, None, attempt
                error = "reply refused by check"
            except Exception as failure:  # the client's failures are data here
                error = f"{type(failure).__name__}: {failure}"
            if attempt <= max_retries and backoff:
                time.sleep(backoff)
        return reply, error, max_retries + 1

    @F.pandas_udf(REPLY)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(concurrency) as pool:
            for texts in batches:
                results = pool.map(lambda text: one(client, text), texts)
                yield pd.DataFrame(list(results), columns=["reply", "error", "attempts"]).astype(
                    {"reply": "object", "error": "object", "attempts": "int32"}
                )

    ship_package(df.sparkSession)
    rows = df if partitions is None else df.repartition(partitions)
    return (
        rows.withColumn("_chat", call.asNondeterministic()(F.to_json(messages)))
        .withColumn(out, F.col("_chat.reply"))
        .withColumn(f"{out}_error", F.col("_chat.error"))
        .drop("_chat")
    )


def _stored(df: DataFrame, messages: str, out: str, model: str, store: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = df.sparkSession
    error = f"{out}_error"
    keyed = df.withColumn("_request", F.sha2(F.concat(F.lit(model), F.lit("\n"), F.to_json(messages)), 256))
    schema = f"_request string, `{out}` string, `{error}` string, run string"
    known = spark.read.schema(schema).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)
    good = known.where(F.col(error).isNull()).select("_request")
    todo = keyed.select("_request", messages).dropDuplicates(["_request"]).join(good, "_request", "left_anti")
    run = uuid.uuid4().hex
    # the second algorithm moves a task's files into the folder when the task commits, not when the job does
    asked = ask(todo).select("_request", out, error, F.lit(run).alias("run"))
    asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
    # failures count for the run that met them; of several answers to a request a good one is taken
    usable = spark.read.schema(schema).parquet(store).where(F.col(error).isNull() | (F.col("run") == run))
    one = F.min_by(F.struct(out, error), F.struct(F.col(error).isNotNull(), F.xxhash64(out))).alias("_one")
    held = usable.groupBy("_request").agg(one).select("_request", "_one.*")
    return keyed.join(held, "_request", "left").drop("_request")


def annotate(
    df: DataFrame,
    text: Column | str,
    make_annotator: Callable[[], Annotator],
    *,
    partitions: int | None = None,
    slice_tokens: int = 50_000,
) -> DataFrame:
    """Parse a text column into ``tokens`` and ``chunks``.

    Parses leave a task in slices of about ``slice_tokens`` tokens, so a batch of long texts is never
    held as parses all at once.
    """

    def slices(texts: Iterator, annotator: Annotator) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for text in texts:
            parsed = ([], []) if text is None else annotator(text)
            held.append(parsed)
            size += len(parsed[0])
            if size >= slice_tokens:
                yield pd.DataFrame(held, columns=["tokens", "chunks"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["tokens", "chunks"])

    @F.pandas_udf(PARSE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        annotator = make_annotator()
        for texts in batches:
            yield from slices(texts, annotator)

    ship_package(df.sparkSession)
    rows = df if partitions is None else df.repartition(partitions)
    return (
        rows.withColumn("_parse", parse.asNondeterministic()(text))
        .withColumn("tokens", F.col("_parse.tokens"))
        .withColumn("chunks", F.col("_parse.chunks"))
        .drop("_parse")
    )


def spacy_annotator(nlp: Callable) -> Annotator:
    """Annotator around a loaded spaCy pipeline."""

    def parse(text: str) -> tuple[list[dict], list[dict]]:
        doc = nlp(text)
        tokens = [
            dict(i=t.i, text=t.text, lemma=t.lemma_, pos=t.pos_, dep=t.dep_, head_i=t.head.i, ws=bool(t.whitespace_))
            for t in doc
        ]
        chunks = [
            dict(chunk_id=n, start=c.start, end=c.end, root_i=c.root.i, text=c.text, lemma=c.lemma_)
            for n, c in enumerate(doc.noun_chunks)
        ]
        return tokens, chunks

    return parse


def is_grading(reply: str) -> bool:
    """Retry test for graders, by the same rule as ``replies.parse_gradings``."""
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", reply, re.DOTALL)
    try:
        body = json.loads(fence.group(1) if fence and fence.group(1) else reply)
    except ValueError:
        return False
    rows = body if isinstance(body, list) else [body]
    return all(isinstance(r, dict) and isinstance(r.get("sentence"), str) for r in rows)
