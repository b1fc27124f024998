"""Samples, transcripts, nesting, scores, probes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import nesting, probes, samples, scoring, transcripts
from plumbline.plans import catalogue


@pytest.fixture(scope="module")
def annotations(spark):
    return {
        "images": spark.createDataFrame(
            [(7, "7.jpg", 0), (3, "3.jpg", 1), (5, "5.jpg", 2)], "image_id bigint, file_name string, ord bigint"
        ),
        "instances": spark.createDataFrame(
            [(7, 2, [1.0, 2.0, 3.0, 4.0], 9.0, 5), (7, 1, [0.0, 0.0, 1.0, 1.0], 1.0, 2), (7, 1, [5.0, 5.0, 1.0, 1.0], 1.5, 8), (3, 99, [1.0, 1.0, 1.0, 1.0], 2.0, 0)],
            "image_id bigint, category_id int, bbox array<double>, area double, ord bigint",
        ),
        "captions": spark.createDataFrame(
            [(7, "second", 4), (7, "first", 1), (5, "only", 0)], "image_id bigint, caption string, ord bigint"
        ),
        "categories": spark.createDataFrame([(1, "dog"), (2, "cat")], "category_id int, name string"),
    }


def test_assemble_samples(annotations):
    rows = {r.image_id: r for r in samples.assemble_samples(**annotations).collect()}
    assert [(i.category, i.pixel_area) for i in rows[7].instances] == [("dog", 1.0), ("cat", 9.0), ("dog", 1.5)]
    assert rows[7].instances[1].bbox == [1.0, 2.0, 3.0, 4.0]
    assert rows[7].captions == ["first", "second"]
    assert [i.category for i in rows[3].instances] == [None] and rows[3].captions == []
    assert rows[5].instances == [] and rows[5].captions == ["only"]
    (one,) = samples.load_sample(7, **annotations).select(samples.caption_text().alias("t")).collect()
    assert one.t == "first second"


def test_sample_checks(annotations):
    unknown = samples.unknown_categories(annotations["instances"], annotations["categories"]).collect()
    assert [(r.category_id, r.instances) for r in unknown] == [(99, 1)]
    assert [r.image_id for r in samples.first_images(annotations["images"], 2).collect()] == [7, 3]
    stats = {r.image_id: r for r in samples.sample_stats(*(annotations[t] for t in ("images", "instances", "captions"))).collect()}
    assert (stats[7].n_instances, stats[7].n_captions, stats[7].total_area) == (3, 2, 11.5)
    assert (stats[5].n_instances, stats[5].n_captions, stats[5].total_area) == (0, 1, 0.0)


def numbers(spark, hot=500):
    rows = [(k, n, f"{k}-{n}") for k in range(20) for n in range(5)] + [(None, n, f"x-{n}") for n in range(3)]
    rows += [(99, n, f"99-{n}") for n in range(hot)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k int, n int, v string"), rows


def joined(nested):
    parts = sorted(nested.collect(), key=lambda r: (r.k is None, r.k or 0, r.part))
    return {k: [v for r in g for v in r.vs] for k, g in itertools.groupby(parts, key=lambda r: r.k)}, parts


@pytest.mark.parametrize("part_rows", [3, 50, 10_000])
def test_nest_cuts_all_keys_at_the_same_places(spark, part_rows):
    df, rows = numbers(spark)
    got, parts = joined(nesting.nest_ordered(df, ["k"], ["n"], F.col("v"), "vs", part_rows=part_rows))
    want = {}
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(v)
    assert got == want
    for k, rest in itertools.groupby(parts, key=lambda r: r.k):
        rest = list(rest)
        assert [(r.part, r.first_position) for r in rest] == [(i, i * part_rows) for i in range(-(-len(want[k]) // part_rows))]
        assert all(len(r.vs) == part_rows for r in rest[:-1])


def test_a_key_over_many_ranges(spark):
    """One key fills ten ranges and more; equal places in the order, and null keys."""
    rows = [(None if n % 50 == 0 else n % 3, n // 4, f"{n:04}") for n in range(900)] + [(7, 1, "same")] * 40
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "k int, n int, v string").repartition(6)
    got, parts = joined(nesting.nest_ordered(df, ["k"], ["n"], F.col("v"), "vs", part_rows=3, range_rows=25))
    want = {}
    for k, _, v in sorted(rows, key=lambda r: r[1:]):
        want.setdefault(k, []).append(v)
    assert got == want and max(len(r.vs) for r in parts) == 3
    for k, rest in itertools.groupby(parts, key=lambda r: r.k):
        assert [(r.part, r.first_position) for r in rest] == [(i, 3 * i) for i in range(-(-len(want[k]) // 3))]


def test_parts_are_cut_by_bytes(spark):
    """Items of very different lengths: no part holds more than the limit and one item."""
    rng = random.Random(3)
    rows = [(k, n, "x" * rng.choice([0, 1, 5, 300, 2000])) for k in range(4) for n in range(200 if k else 30)]
    rows += [(9, 0, "y" * 5000), (10, 0, "z" * 10)]
    df = spark.createDataFrame(rows, "k int, n int, v string").repartition(5)
    item = F.struct(F.col("v").alias("a"), F.array("v").alias("b"), F.create_map("v", "n").alias("m")["none"])
    got, parts = joined(nesting.nest_ordered(df, ["k"], ["n"], F.col("v"), "vs", part_rows=50, part_bytes=3000, range_rows=64))
    want = {}
    for k, _, v in sorted(rows):
        want.setdefault(k, []).append(v)
    assert got == want
    for k, rest in itertools.groupby(parts, key=lambda r: r.k):
        rest, at = list(rest), 0
        assert [r.part for r in rest] == list(range(len(rest)))
        for r in rest:
            assert r.first_position == at and len(r.vs) <= 50 and sum(map(len, r.vs[:-1])) <= 3000
            at += len(r.vs)
    sizes = df.where("k = 10").select(nesting.item_bytes(item, df.select(item.alias("i")).schema["i"].dataType))
    assert sizes.first()[0] > 20


def test_ordinary_keys_do_not_depend_on_hot_ones(spark):
    def ordinary(hot):
        df, _ = numbers(spark, hot)
        nested = nesting.nest_ordered(df, ["k"], ["n"], F.col("v"), "vs", part_rows=4)
        return sorted(map(repr, (tuple(r) for r in nested.collect() if r.k != 99)))

    assert ordinary(0) == ordinary(3_000)


def test_nest_of_nothing(spark):
    df, _ = numbers(spark)
    assert nesting.nest_ordered(df.limit(0), ["k"], ["n"], F.col("v"), "vs").count() == 0


TURNS = "s bigint, turn int, role string, content string"


def test_truncate(spark):
    rows = [
        (1, 0, "evaluator", "Hi"), (1, 1, "evaluatee", "THE END"), (1, 2, "evaluator", "WEEKEND?"), (1, 3, "evaluatee", "x"),
        (2, 0, "evaluator", "END"), (2, 1, "evaluatee", "x"), (2, 2, "evaluator", "END"),
        (3, 0, "evaluator", "end"), (3, 1, "evaluatee", "x"),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    cut = transcripts.truncate_at_marker(turns, "s")
    kept = sorted((r.s, r.turn) for r in cut.collect())
    assert kept == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)]
    again = transcripts.truncate_at_marker(cut, "s")
    assert sorted((r.s, r.turn) for r in again.collect()) == kept


def test_nest_and_explode_transcripts(spark):
    rows = [(1, 2, "evaluator", "c"), (1, 0, "evaluator", "a"), (1, 1, "evaluatee", "b")]
    turns = spark.createDataFrame(rows, TURNS)
    nested = transcripts.nest_transcripts(turns, "s")
    (row,) = nested.collect()
    assert [(m.role, m.content) for m in row.conversation] == [("evaluator", "a"), ("evaluatee", "b"), ("evaluator", "c")]
    assert sorted(tuple(r) for r in transcripts.explode_transcripts(nested).collect()) == sorted(rows)
    assert [r.content for r in transcripts.evaluatee_turns(turns).collect()] == ["b"]
    parts = transcripts.nest_transcripts(turns, "s", part_rows=2)
    assert parts.count() == 2
    assert sorted(tuple(r) for r in transcripts.explode_transcripts(parts).collect()) == sorted(rows)


def brute_scores(objects, relations):
    cases = {}
    for case, side, head, attrs in objects:
        heads = cases.setdefault(case, {"gt": ({}, []), "vlm": ({}, [])})[side][0]
        heads.setdefault(head, []).extend(attrs)
    for case, side, *triple in relations:
        cases.setdefault(case, {"gt": ({}, []), "vlm": ({}, [])})[side][1].append(triple)
    out = {}
    for case, sides in cases.items():
        (gt_heads, gt_rels), (heads, rels) = sides["gt"], sides["vlm"]
        bad = sum(1 for h, a in heads.items() if h not in gt_heads or any(x not in gt_heads[h] for x in a))
        out[case] = (bad, sum(1 for r in rels if r not in gt_rels))
    return out


OBJ = "case_id bigint, side string, head string, attributes array<string>"
REL = "case_id bigint, side string, subj string, rel string, obj string"


def scores(spark, objects, relations, cases=None):
    df = scoring.score_tables(spark.createDataFrame(objects, OBJ), spark.createDataFrame(relations, REL), cases=cases)
    return {r.case_id: (r.object_hallucination_num, r.relation_hallucination_num) for r in df.collect()}


def test_scores_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcd")
    objects = [
        (rnd.randrange(30), rnd.choice(["gt", "vlm"]), word(), [word() for _ in range(rnd.randrange(3))]) for _ in range(400)
    ]
    relations = [(rnd.randrange(30), rnd.choice(["gt", "vlm"]), word(), word(), word()) for _ in range(400)]
    assert scores(spark, objects, relations) == brute_scores(objects, relations)


def test_score_cases(spark):
    objects = [
        (1, "gt", "dog", ["big"]), (1, "vlm", "dog", ["big"]),  # same
        (2, "vlm", "cat", []),  # missing head, no ground truth at all
        (3, "gt", "dog", ["big"]), (3, "vlm", "dog", ["red", "wet"]),  # two missing attributes count once
        (4, "gt", "dog", []),  # nothing claimed
    ]
    relations = [(1, "gt", "dog", "on", "mat"), (1, "vlm", "dog", "on", "mat"), (3, "vlm", "dog", "in", "box"), (3, "vlm", "dog", "in", "box")]
    cases = spark.createDataFrame([(c,) for c in range(1, 6)], "case_id bigint")
    assert scores(spark, objects, relations, cases) == {1: (0, 0), 2: (1, 0), 3: (1, 2), 4: (0, 0), 5: (0, 0)}


def test_more_truth_never_raises_a_count(spark):
    rnd = random.Random(9)
    objects = [(c, "vlm", rnd.choice("abc"), [rnd.choice("xyz")]) for c in range(20) for _ in range(3)]
    truth = [(c, "gt", rnd.choice("abc"), [rnd.choice("xyz")]) for c in range(20)]
    fewer, more = scores(spark, objects, []), scores(spark, objects + truth, [])
    assert all(more[c][0] <= fewer[c][0] for c in fewer)


def test_unsupported_lists_and_report(spark):
    objects = [(1, "gt", "dog", ["big"]), (1, "vlm", "dog", ["red"]), (1, "vlm", "cat", [])]
    relations = [(1, "vlm", "a", "on", "b"), (1, "vlm", "a", "on", "b")]
    facts = scoring.table_facts(spark.createDataFrame(objects, OBJ), spark.createDataFrame(relations, REL))
    assert sorted((r.head, r.missing) for r in scoring.unsupported_objects(facts, "case_id").collect()) == [("cat", "object"), ("dog", "attribute")]
    assert [(r.subject, r.claims) for r in scoring.unsupported_relations(facts, "case_id").collect()] == [("a", 2)]
    (report,) = scoring.metric_report(scoring.score_facts(facts, "case_id")).collect()
    assert tuple(report) == (1, 2, 2)


def test_scores_need_no_join(spark):
    facts = scoring.table_facts(spark.createDataFrame([], OBJ), spark.createDataFrame([], REL))
    plan = scoring.score_facts(facts, "case_id")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "CollectLimit" not in plan


def test_attributes_filter(spark):
    df = spark.createDataFrame([([("det", "The", "the"), ("det", "this", "this"), ("amod", "Big", "big"), ("det", "", "")],)], "m array<struct<dep:string,span:string,lemma_span:string>>")
    assert df.select(scoring.attributes(F.col("m"))).first()[0] == ["this", "big"]


def test_merge_entities(spark):
    mod = "array<struct<dep:string,span:string,lemma_span:string>>"
    df = spark.createDataFrame(
        [(1, 1, "Dog", [("amod", "Big", "big")]), (1, 0, "dog", [("amod", "red", "red"), ("det", "the", "the")]), (1, 2, "DOG", [("amod", "big", "big")])],
        f"doc_id int, entity_id int, head string, modifiers {mod}",
    )
    (row,) = scoring.merge_entities(df, ["doc_id"]).collect()
    assert (row["head"], row["attributes"]) == ("dog", ["red", "big", "big"])
    one = df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("entity_id", "head", "modifiers"))), lambda e: e).alias("entities"))
    both = one.select(scoring.merged_in_row(F.col("entities")).alias("m"))
    assert [(m["head"], m["attributes"]) for m in both.first()["m"]] == [("dog", ["red", "big", "big"])]
    assert "Exchange" not in spark.range(1).select(scoring.merged_in_row(F.lit(None).cast(f"array<struct<head:string,modifiers:{mod}>>")))._jdf.queryExecution().executedPlan().toString()


def test_probes(spark):
    rows = [("p", "m", "yes", "Yes"), ("p", "m", "yes", "no"), ("p", "m", "no", "it is not there"), ("p", "m", "no", "yes. no"), ("q", "m", "no", "No, none"), ("r", "m", "yes", "nothing")]
    df = spark.createDataFrame(rows, "probe_set string, model string, label string, output string")
    got = {r.probe_set: r for r in probes.score_probes(df, ["probe_set", "model"]).collect()}
    p, q, r = got["p"], got["q"], got["r"]
    assert (p.tp, p.fp, p.tn, p.fn) == (1, 1, 1, 1)
    assert (p.accuracy, p.precision, p.recall, p.f1, p.yes_ratio) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert (q.tn, q.precision, q.recall, q.f1) == (1, None, None, None)
    assert (r.tp, r.yes_ratio) == (1, 1.0)


def test_short_lists_are_cut_in_their_row(spark, monkeypatch):
    """Keys that a task can hold take one shuffle, however short the parts; nothing is written or ranged."""
    rows = [(k, n, f"{k}.{n}") for k in (None, *range(40)) for n in range((k or 3) % 9 + 1)]
    df = spark.createDataFrame(rows, "k int, n int, v string").repartition(5)
    monkeypatch.setattr(nesting, "materialise", lambda df: pytest.fail("written"))
    got = {(r.k, r.part, r.first_position): r.vs for r in nesting.nest_ordered(df, ["k"], ["n"], F.col("v"), "vs", part_rows=2).collect()}
    want = {}
    for k, n, v in rows:
        want.setdefault((k, n // 2, n // 2 * 2), []).append(v)
    assert got == want


def test_merged_table_parses_once(spark, tmp_path):
    spark.createDataFrame([(1, "red dog of a dog on dog with blue dog"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    merged = catalogue.merged_table(spark, str(tmp_path))
    assert not [f for f in merged.inputFiles() if "documents.parquet" in f]
    assert sorted(map(tuple, merged.collect())) == [(1, "dog", 0, "red"), (1, "dog", 1, "blue")]


def test_spread_goes_by_rows(spark):
    """As many splits as cores, but rows in one of them."""
    uneven = spark.range(0, 2000, 1, 16).where("id < 125")
    assert session.spread(uneven).select(F.spark_partition_id().alias("p")).distinct().count() >= 8
