"""Collocations, against counts by plain Python over all texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, oracle_connection

from plumbline.llm import phrases
from plumbline.llm.common import prepare
from plumbline.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs):
    """{lang: Counter of phrases}, {lang: words}"""
    counts, sizes = {}, Counter()
    for text, lang in docs:
        found = counts.setdefault(lang or "und", Counter()) if lang != "" else counts.setdefault("", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes["und" if lang is None else lang] += len(words)
            for size in range(1, 6):
                found.update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, sizes


def brute(docs, support, top, percent=100):
    counts, sizes = brute_counts(docs)
    rows = set()
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= support and " " in p}
        scored = []
        for p, a in frequent.items():
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= percent * a for q, b in frequent.items()):
                continue
            words, n = p.split(" "), sizes[lang]
            cuts = []
            for k in range(1, len(words)):
                left, right = found[" ".join(words[:k])], found[" ".join(words[k:])]
                cuts.append((1000 * a * n // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.add((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return rows


def run(spark, docs, parts=5, **options):
    table = spark.createDataFrame([(t, lang, "x", 1, 2, 3) for t, lang in docs], "text string, lang string, phrase string, n int, h long, words int")
    return {tuple(r) for r in phrases.collocations(table.repartition(parts), **options).collect()}


def corpus(seed, n=120, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "É", "X"]
    shared = [" ".join(rng.choices(words, k=9)) for _ in range(4)]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "\x85 "]) for _ in range(rng.randrange(60)))
        docs.append((text + rng.choice(shared) + rng.choice(["", ";", " "]) + rng.choice(shared), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return docs


@pytest.mark.parametrize("shard_bytes", [200, 2000, 1 << 20])
@pytest.mark.parametrize("support", [3, 11])
def test_collocations_equal_brute_force(spark, shard_bytes, support):
    """Shards from one text to all of them."""
    prepare(spark)
    docs = corpus(support)
    want = brute(docs, support, 40)
    assert len(want) > 40
    assert run(spark, docs, support=support, top=40, shard_bytes=shard_bytes, filter_bits=12) == want


def test_full_filters_change_nothing(spark):
    """Filters of 64 bits let nearly everything through."""
    prepare(spark)
    docs = corpus(9)
    assert run(spark, docs, support=4, top=500, filter_bits=6, shard_bytes=1000) == brute(docs, 4, 500)


def test_other_shards_in_another_round(spark, monkeypatch):
    """If rounds had not the same shards, all is counted anew."""
    prepare(spark)
    docs = corpus(5)
    asked = []
    monkeypatch.setattr(phrases, "_same_shards", lambda a, b: asked.append(1))
    assert run(spark, docs, support=4, top=30, shard_bytes=500) == brute(docs, 4, 30) and asked


def test_shards_hold_one_language(spark, monkeypatch):
    """Texts of all languages in every partition: as many shards as their bytes need, not one of each language a partition."""
    prepare(spark)
    docs = [(t, lang) for t, _ in corpus(6, 400) for lang in ("en", "de", "fr", "es")]
    seen = []
    same = phrases._same_shards
    monkeypatch.setattr(phrases, "_same_shards", lambda a, b: seen.append(b.where("words = 0").groupBy("lang").agg({"n": "sum"}).collect()) or same(a, b))
    most = sum(len(t.encode()) for t, _ in docs) // 4
    assert run(spark, docs, parts=16, support=30, top=20, shard_bytes=most) == brute(docs, 30, 20)
    shards = {r[0]: r[1] for r in seen[0]}
    assert len(shards) == 4 and sum(shards.values()) <= 16, shards


def test_shards_of_any_turns(spark, monkeypatch):
    """Phrases counted a few at a time, and texts coded a few at a time, are counted alike."""
    texts = [t.encode() for t, _ in corpus(8, 60)]

    def mined():
        shard = phrases.Shard(texts, "en")
        return {(size, p, n) for size, at, counts in shard.mine(2, 5, {}) for p, n in zip(shard.phrases_at(at, size).to_pylist(), counts.tolist())}

    want = mined()
    monkeypatch.setattr(phrases, "_COUNTED", 7)
    monkeypatch.setattr(phrases, "_CHUNK_BYTES", 50)
    assert mined() == want and len(want) > 100


def test_shards_are_compared(spark):
    prepare(spark)
    rows = [("en", 0, 5, 2, 3), ("en", 0, 6, 1, 1), ("de", 0, 5, 1, 1), ("en", 2, 9, 50, 3)]
    table = lambda rows: spark.createDataFrame(rows, "lang string, words int, h long, n long, slack long")
    assert phrases._same_shards(table(rows), table(rows[2::-1]))
    for other in (rows[:2], [*rows[:3], ("fr", 0, 1, 1, 0)], [("en", 0, 5, 2, 4), *rows[1:]], [("en", 0, 5, 1, 3), *rows[1:]]):
        assert not phrases._same_shards(table(rows), table(other)) and not phrases._same_shards(table(other), table(rows))


def test_partly_subsumed_phrases(spark):
    prepare(spark)
    docs = corpus(4)
    assert run(spark, docs, support=5, top=100, subsumed_percent=50) == brute(docs, 5, 100, 50)


def test_odd_rows(spark):
    prepare(spark)
    long = "A b " * 60_000 + "c"
    docs = [(None, "en"), ("", "en"), (None, None), ("...", "de"), (" \t ", "fr"), (long, None), (long, None), ("a a a a a", "en"), ("a a a a a", "en"), ("x\x0by\x0cz", "en")]
    want = brute(docs, 2, 10)
    assert run(spark, docs, support=2, top=10) == want and any(r[0] == "und" for r in want)
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    assert run(spark, [(None, None)]) == set()


def test_scores_past_64_bits(spark):
    """1000 a n and l r both pass 64 bits: counts as large as they may get, by hand-made tables."""
    prepare(spark)
    a, l, r, n = 3_000_000_000, 4_000_000_000, 5_000_000_000, 70_000_000_000_000
    rows = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, words int, phrase string, n long")
    kept = phrases.phrase_counts
    phrases.phrase_counts = lambda docs, **_: (rows, spark.createDataFrame([("en", n)], "lang string, n long"))
    try:
        (got,) = phrases.collocations(None).collect()
    finally:
        phrases.phrase_counts = kept
    assert got["score"] == 1000 * a * n // (l * r) and 1000 * a * n > 1 << 64 < l * r


def test_share_of_support_misses_nothing():
    """What stays below its share in every shard stays below the support in all."""
    rng = random.Random(0)
    for _ in range(300):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))]
        support = rng.randrange(1, 120)
        assert sum(phrases._share(support, s, sum(sizes)) - 1 for s in sizes) < support


def test_shard_hashes_are_of_the_phrase():
    """The same phrase has the same hash in any shard of a language."""
    a, b = phrases.Shard([b"one two three"], "en"), phrases.Shard([b"zero", b"ONE two three four"], "en")
    assert (a.hash_at(np.array([0]), 3) == b.hash_at(np.array([1]), 3)).all()
    assert (a.hash_at(np.array([0]), 3) != phrases.Shard([b"one two three"], "de").hash_at(np.array([0]), 3)).all()


def test_query_equals_sql(spark, sf_dir):
    same, message = compare(QUERIES["op13_phrases"](spark, sf_dir), oracle_connection(sf_dir), ORACLES["op13_phrases"])
    assert same, message
