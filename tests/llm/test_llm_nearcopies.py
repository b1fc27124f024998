"""Near copies of the pipeline, against exact similarities of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import nearcopies
from plumbline.llm.common import prepare
from plumbline.llm.pipeline import COLUMNS, STAGES

STAGE = dict(STAGES)["simhash near-dedup"]
WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re") for b in ("st", "n", "rd", "") for c in ("a", "el", "o", "um")]


def runs_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, words, n):
    words = words[:]
    for _ in range(n):
        at, what = rng.randrange(len(words)), rng.random()
        words[at : at + 1] = [] if what < 0.2 else [rng.choice(WORDS) + "x"] if what < 0.8 else [words[at], rng.choice(WORDS)]
    return words


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_recall_of_edited_texts(spark):
    """Texts of 60 to 1,000 words and a copy of each with some words edited: nine in ten of those at 0.8 or more are found."""
    rng = random.Random(12)
    rows, similar = [], {}
    for i in range(900):
        words = rng.choices(WORDS, k=rng.randrange(60, 1000))
        copy = edited(rng, words, rng.randrange(1, max(2, len(words) // 40)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        similar[i] = jaccard(runs_of(rows[-2][1]), runs_of(rows[-1][1]))
    kept = {r["doc_id"] for r in STAGE(spark, table(spark, rows), "").collect()}
    assert kept >= {2 * i for i in range(900)}  # no original goes
    for low, high, least in ((0.95, 1.1, 0.99), (0.87, 0.95, 0.98), (0.8, 0.87, 0.9), (0.8, 1.1, 0.95)):
        found = [2 * i + 1 not in kept for i, j in similar.items() if low <= j < high]
        assert len(found) > 60 and np.mean(found) >= least, (low, len(found), np.mean(found))
    assert np.mean([2 * i + 1 not in kept for i, j in similar.items() if j < 0.6] or [0]) < 0.05


def test_fingerprints_differ_as_similarities_say():
    rng = random.Random(3)
    words = rng.choices(WORDS, k=3000)
    one = nearcopies.runs_of(" ".join(words), nearcopies._Words())
    for n in (5, 30, 80):
        other = nearcopies.runs_of(" ".join(edited(rng, words, n)), nearcopies._Words())
        j = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
        a, b = (int.from_bytes(nearcopies.fingerprint(x), "big") for x in (one, other))
        assert abs((a ^ b).bit_count() / nearcopies.BITS - np.arccos(2 * j / (1 + j)) / np.pi) < 0.05


def test_large_shards_lose_no_link(spark, monkeypatch):
    """A group of many near copies of one text, in pieces; and exact copies of all."""
    monkeypatch.setattr(nearcopies, "SHARD_ROWS", 16)
    rng = random.Random(5)
    base = rng.choices(WORDS, k=400)
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(1, 150)] + [(0, " ".join(base))]
    rows += [(1000 + i, t) for i, t in rows] + [(5000 + i, " ".join(rng.choices(WORDS, k=200))) for i in range(40)]
    prepare(spark)
    kept = {r["doc_id"] for r in nearcopies.drop_near_copies(table(spark, rows).repartition(5)).collect()}
    assert kept == {0} | {5000 + i for i in range(40)}


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(4, None), (3, ""), (5, " \t"), (1, "one two"), (2, "ONE  two"), (7, "one three"), (8, long), (9, long + "x"), (9, long + "x"), (None, long), (None, None), (6, "É é"), (10, "é é")]
    docs = table(spark, rows)
    out = STAGE(spark, docs, "")
    assert tuple(out.columns) == COLUMNS
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(3, ""), (1, "one two"), (7, "one three"), (8, long), (9, long + "x"), (None, long), (None, None), (6, "É é"), (10, "é é")], key=str)
    assert STAGE(spark, docs.limit(0), "").collect() == []
    prepare(spark)
    clash = docs.select("doc_id", "text", F.lit(1).alias("node"), F.lit("p").alias("print"), F.lit(0).alias("text_key"), F.lit(2).alias("component"))
    assert sorted(r["doc_id"] for r in nearcopies.drop_near_copies(clash).collect() if r["doc_id"] is not None) == [1, 3, 6, 7, 8, 9, 10]


def test_a_repeated_id_loses_no_group(spark):
    prepare(spark)
    a, b = "one two three four five six seven", "red green blue black white brown grey"
    for one, two in ((a, b), (b, a)):
        rows = [(1, one), (1, one), (1, two), (2, one), (3, two), (None, one)]
        got = sorted((str(r["doc_id"]), r["text"]) for r in nearcopies.drop_near_copies(table(spark, rows)).collect())
        assert got == sorted([("1", one), ("1", two), ("None", one)])


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_kinds_of_ids(spark, kind):
    prepare(spark)
    docs = table(spark, [(1, "a b c"), (2, "a b c"), (3, "d")]).withColumn("doc_id", F.col("doc_id").cast(kind))
    assert sorted(str(r["doc_id"]) for r in nearcopies.drop_near_copies(docs).collect()) == ["1", "3"]
