"""Interval look-ups over tables, word lists of any size, and probe sets, against plain Python."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from plumbline.operators import locate, probes, scenegraph
from plumbline.plans.tokens import hashed_tokens
from plumbline.sources import lexicons


@pytest.mark.parametrize("bin_size", [1, 4, 64])
def test_locate(spark, bin_size):
    rng = random.Random(bin_size)
    spans, want = [], {}
    for doc in range(12):
        chosen = [(n, a := rng.randrange(0, 200), a + rng.choice([-2, 0, 1, 3, 9, 70, 150])) for n in range(rng.randrange(30))]
        spans += [(doc, "x", *s) for s in chosen]
        for i in range(-3, 400):
            want[doc, i] = min((n for n, a, b in chosen if a <= i < b), default=None)
    rows = [(d, "x", i, "p") for d, i in want] + [(None, "x", 3, "p"), (1, "x", None, "p"), (1, "other", 5, "p")]
    spans += [(None, "x", 0, 0, 9), (1, "x", 0, None, 9)]
    asked = spark.createDataFrame(rows, "doc int, kind string, i int, start string")
    table = spark.createDataFrame(spans, "doc int, kind string, entity_id int, start int, end int")
    got = locate.locate(asked, table, ["doc", "kind"], "i", "found", bin_size=bin_size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.found == (want.get((r.doc, r.i)) if r.kind == "x" else None) and r.start == "p"


def test_locate_has_no_cross_join(spark):
    rows = spark.range(10).selectExpr("id AS doc", "id AS i")
    spans = spark.range(10).selectExpr("id AS doc", "id AS entity_id", "0 AS start", "9 AS end")
    plan = locate.locate(rows, spans, ["doc"], "i", "found")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_overlapping_spans_do_not_multiply(spark):
    rows = spark.range(300).selectExpr("1 AS doc", "id AS i")
    spans = spark.range(3000).selectExpr("1 AS doc", "id AS entity_id", "id % 100 AS start", "300 AS end")
    got = {r.i: r.found for r in locate.locate(rows, spans, ["doc"], "i", "found").collect()}
    assert got == {i: 0 for i in range(300)}


def test_long_word_lists_are_joined(spark):
    """200,000 entries and more: the same graphs as with short lists inside the expressions."""
    texts = [(i, " ".join(random.Random(i).choices(["the", "of", "red", "in", "ring", "sea", "go", "on", "and", "to"], k=60))) for i in range(60)]
    parsed = hashed_tokens(spark.createDataFrame([*texts, (97, ""), (98, None)], "doc_id int, text string"), "text", "doc_id").repartition(5)
    pairs = [f"{a} {b}" for a in ("the", "of", "go", "red") for b in ("on", "in", "to", "the")]
    short = {"phrasal_verbs": pairs, "phrasal_preps": [*pairs, "in", "of", "the"], "scene_nouns": ["sea", "ring", "red sea"]}
    long = {k: spark.range(200_000).selectExpr("concat('entry ', id) AS e").union(spark.createDataFrame([(x,) for x in v], "e string")) for k, v in short.items()}
    for want in (("entities", "relations"), ("relations",), ("entities",)):
        a = scenegraph.extract_scene_graph(parsed, **short, want=want, keep_tokens=False)
        b = scenegraph.extract_scene_graph(parsed, **long, want=want, keep_tokens=False)
        assert a.columns == b.columns
        rows = [{r.doc_id: r for r in df.collect()} for df in (a, b)]
        assert rows[0] == rows[1]
    fake = [r for r in rows[0].values() if r.entities and any(e.type == "scene" for e in r.entities)]
    assert fake
    plain = scenegraph.extract_scene_graph(parsed, keep_tokens=False).collect()
    assert {r.doc_id: r for r in plain} != rows[0]


def test_long_lists_write_rows_without_their_parse(spark, monkeypatch):
    """Two lists that are joined: one written stage, of texts and a number."""
    written = []
    monkeypatch.setattr(lexicons, "materialise", lambda df: written.append(df.columns) or df.localCheckpoint())
    texts = [(n, " ".join(f"w{chr(97 + (n * i * 7) % 23)}" for i in range(60))) for n in range(20)] + [(3, None), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id long, t string")
    lists = {"phrasal_preps": ["wa", "w", "wb wc"], "scene_nouns": ["wa", "w", "wd"], "keep_tokens": False, "want": ("entities",)}
    parse = lambda rows: hashed_tokens(rows, "t", "doc_id")
    joined = scenegraph.extract_scene_graph(docs, **lists, inline_entries=0, parse=parse)
    plain = scenegraph.extract_scene_graph(parse(docs), **lists)
    assert joined.columns == plain.columns and sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    assert any(e.type == "scene" for r in plain.collect() for e in r.entities or [])
    assert written == [["doc_id", "t", "_row"]]


def test_long_list_in_python(spark, monkeypatch):
    monkeypatch.setattr(lexicons, "MAX_INLINE_ENTRIES", 3)
    df = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, None), (3, ["z"])], "k int, p array<string>")
    table = lexicons.lexicon_table(spark, ["a", "z", "q", "a", "x"])
    got = lexicons.document_hits(df, {"one": (F.col("p"), table), "two": (F.col("p"), lexicons.lexicon_table(spark, ["b"]))}).collect()
    assert {r.k: (sorted(r.one), r.two) for r in got} == {1: (["a"], ["b"]), 2: ([], []), 3: (["z"], [])}


def brute_probes(rows, per_image, pool):
    own = {}
    for image, name in rows:
        if image is not None and name is not None:
            own.setdefault(image, set()).add(name)
    counts = Counter(x for names in own.values() for x in names)
    order = sorted(counts, key=lambda x: (-counts[x], x))
    rank = {x: i for i, x in enumerate(order)}
    beside = Counter((a, b) for names in own.values() for a in names for b in names if a != b and rank[b] < pool)
    out = set()
    for image, names in own.items():
        lacking = [x for x in order if x not in names]
        near = {b: max(beside[a, b] for a in names) for b in lacking}
        sets = {
            "popular": lacking[:per_image],
            "random": sorted(lacking, key=lambda x: (rank[x] - image * 7) % len(order))[:per_image],
            "adversarial": sorted((x for x in lacking if near[x]), key=lambda x: (-near[x], rank[x]))[:per_image],
        }
        yes = sorted(names, key=rank.get)[:per_image]
        for kind, no in sets.items():
            out |= {(image, kind, n, x, "yes", f"{x}?") for n, x in enumerate(yes)} | {(image, kind, n, x, "no", f"{x}?") for n, x in enumerate(no)}
    return out


@pytest.mark.parametrize("per_image, pool", [(1, 3), (3, 1000), (30, 1000)])
def test_probe_sets(spark, per_image, pool):
    rng = random.Random(per_image)
    names = [f"o{int(rng.expovariate(0.15))}" for _ in range(600)]
    rows = [(rng.randrange(80), x) for x in names] + [(3, "o1")] * 5 + [(None, "o1"), (4, None)]
    df = spark.createDataFrame(rows, "img int, what string").withColumn("rank", F.lit(1))
    got = probes.probe_sets(df, "img", "what", per_image=per_image, pool=pool, start=F.col("image") * 7, question="{}?")
    assert sorted(map(tuple, got.collect())) == sorted(brute_probes(rows, per_image, pool))
    assert probes.probe_sets(df.limit(0), "img", "what").collect() == []
    scored = probes.score_probes(got.withColumn("output", F.lit("Yes, it is.")), ["probe_set"]).collect()
    assert {r.probe_set for r in scored} == {"random", "popular", "adversarial"} and all(r.recall == 1 for r in scored)


def test_probes_are_not_brought_to_one_task(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "img int, what string")
    assert "SinglePartition" not in probes.probe_sets(df, "img", "what")._jdf.queryExecution().executedPlan().toString()


def test_adversarial_objects_of_any_rank(spark):
    """More than 1,000 objects: what is beside an image's objects is offered though it is rarer than all others."""
    rows = [(2 * n + copy, f"a{n:04}") for n in range(1_100) for copy in (0, 1)] + [(-1, "x"), (-1, "y"), (-2, "x")]
    df = spark.createDataFrame(rows, "img long, what string")
    got = probes.probe_sets(df, "img", "what").where("probe_set = 'adversarial' AND label = 'no'").collect()
    assert [(r.img, r.place, r.object) for r in got] == [(-2, 0, "y")]


@pytest.mark.parametrize("per_image", [1, 4])
def test_probe_sets_of_all_ranks(spark, per_image):
    """Images of very different sizes; lists of neighbours are as long as each of them needs."""
    rng = random.Random(per_image)
    rows = [(image, f"o{int(rng.expovariate(0.05))}") for image in range(60) for _ in range(rng.choice([1, 1, 2, 5, 40]))]
    df = spark.createDataFrame(rows, "img int, what string")
    got = probes.probe_sets(df, "img", "what", per_image=per_image, start=F.col("image") * 7, question="{}?")
    assert sorted(map(tuple, got.collect())) == sorted(brute_probes(rows, per_image, 10**9))
