"""Stages that call out, with stand-ins; sources and sinks."""

import json
import os
import random
import time
import uuid
from collections import Counter

import pytest
from parses import RULES, document
from pyspark.sql import functions as F

from plumbline.functions import prompts
from plumbline.operators import dialogue, grading, inference, scenegraph
from plumbline.sources import annotations, images, lexicons, tasks


def test_batch_infer_keeps_columns_and_runs_once_per_row(spark, tmp_path):
    log = str(tmp_path)

    def make():
        import os
        import uuid

        def predict(paths, questions):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(questions))
            return [f" {q.upper()}. " for q in questions]

        return predict

    df = spark.createDataFrame([(n, "i", f"q{n}", [n]) for n in range(50)], "n int, image string, question string, extra array<int>")
    out = inference.materialise(inference.batch_infer(df, make, partitions=4))
    rows = out.where(F.col("output").startswith("q")).orderBy("n").collect()
    assert [(r.output, r.extra) for r in rows] == [(f"q{n}", [n]) for n in range(50)]
    asked = [line for p in tmp_path.iterdir() for line in p.read_text().splitlines()]
    assert sorted(asked) == sorted(f"q{n}" for n in range(50))


def test_chat_retries(spark):
    def make():
        calls = {}

        def client(messages, model):
            text = messages[-1]["content"]
            calls[text] = calls.get(text, 0) + 1
            if text == "never":
                raise RuntimeError("down")
            if text == "third" and calls[text] < 3:
                raise RuntimeError("busy")
            return "bad" if text == "refused" else f"{model}:{messages[0]['role']}:{calls[text]}"

        return client

    df = spark.createDataFrame([(t,) for t in ("first", "third", "never", "refused")], "t string").coalesce(1)
    df = df.withColumn("messages", prompts.opening_messages("sys", F.col("t")))
    out = inference.chat_complete(df, "messages", make, model="m", max_retries=2, backoff=0.0, check=lambda r: r != "bad")
    got = {r.t: (r.reply, r.reply_error) for r in out.collect()}
    assert got == {
        "first": ("m:system:1", None),
        "third": ("m:system:3", None),
        "never": (None, "RuntimeError: down"),
        "refused": ("bad", "reply refused by check"),
    }


class _Token:
    def __init__(self, doc, row):
        self.doc, (self.i, self.text, self.lemma_, self.pos_, self.dep_, self._head, ws) = doc, row
        self.whitespace_ = " " if ws else ""

    @property
    def head(self):
        return self.doc.tokens[self._head]


class _Chunk:
    def __init__(self, doc, row):
        _, self.start, self.end, root, self.text, self.lemma_ = row
        self.root = doc.tokens[root]


class _Doc:
    def __init__(self, tokens, chunks):
        self.tokens = [_Token(self, t) for t in tokens]
        self.noun_chunks = [_Chunk(self, c) for c in chunks]

    def __iter__(self):
        return iter(self.tokens)


def test_annotate_through_a_pipeline(spark):
    words, chunks, want = RULES["active"]
    _, tokens, noun_chunks = document("d", words, chunks)
    from plumbline.operators.inference import spacy_annotator

    parsed = spacy_annotator(lambda text: _Doc(tokens, noun_chunks))("any")
    df = spark.createDataFrame([("any",), (None,)], "t string")
    graphs = scenegraph.extract_scene_graph(inference.annotate(df, "t", lambda: lambda text: parsed))
    got = {r.t: r for r in graphs.collect()}
    assert [(r.subject, r.relation, r.object) for r in got["any"].relations] == want
    assert got[None].entities == []


def test_dialogues(spark):
    seen = []

    def evaluator():
        def client(messages, model):
            sample = json.loads(messages[1]["content"])
            assert "secret" not in sample and messages[0]["role"] == "system"
            asked = [m["content"] for m in messages[2:] if m["role"] == "assistant"]
            answers = [m["content"] for m in messages[2:] if m["role"] == "user"]
            assert len(asked) == len(answers)
            if sample["id"] == 4:
                raise RuntimeError("down")
            return "It is the END" if len(asked) >= sample["id"] else f"q{len(asked)}"

        return client

    def model():
        return lambda paths, questions: [f" {p}: {q.upper()}. " for p, q in zip(paths, questions)]

    df = spark.createDataFrame([(n, f"{n}.jpg", "s") for n in range(5)], "id int, file_name string, secret string")
    out = dialogue.run_dialogues(
        df, evaluator, model, image_dir="d", hide=("secret",), template="{}", max_turns=3, max_retries=0, backoff=0.0
    )
    got = {r.id: ([(m.role, m.content) for m in r.conversation], r.status) for r in out.collect()}
    assert got[0] == ([("evaluator", "It is the END")], "ended")
    assert got[2] == (
        [("evaluator", "q0"), ("evaluatee", "d/2jpg: q0"), ("evaluator", "q1"), ("evaluatee", "d/2jpg: q1"), ("evaluator", "It is the END")],
        "ended",
    )
    assert got[3][1] == "max_turns" and len(got[3][0]) == 6
    assert got[4] == ([], "failed")
    assert out.columns == ["id", "file_name", "secret", "conversation", "status"]


def counted_client(log, answer):
    def make():
        import os
        import uuid

        def client(messages, model):
            open(os.path.join(log, uuid.uuid4().hex), "w").close()
            return answer(messages)

        return client

    return make


def test_replies_are_paid_for_once(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    make = counted_client(str(calls), lambda m: "bad" if m[1]["content"] == "c" else m[1]["content"] * 2)
    df = spark.createDataFrame([(t,) for t in "aabc"], "t string").withColumn("messages", prompts.opening_messages("s", F.col("t")))
    ask = lambda rows: sorted(
        (r.t, r.reply, r.reply_error is None)
        for r in inference.chat_complete(rows, "messages", make, model="m", max_retries=0, backoff=0.0, check=lambda r: r != "bad", store=store).collect()
    )
    want = [("a", "aa", True), ("a", "aa", True), ("b", "bb", True), ("c", "bad", False)]
    assert ask(df) == want and len(list(calls.iterdir())) == 3
    assert ask(df) == want and len(list(calls.iterdir())) == 4  # only the refused one is asked again


def test_dialogues_go_on_where_they_died(spark, tmp_path):
    calls, work = tmp_path / "calls", str(tmp_path / "work")
    calls.mkdir()
    talk = counted_client(str(calls), lambda m: "END" if len(m) > 6 else f"q{len(m)}")
    df = spark.createDataFrame([(n, f"{n}.jpg") for n in range(3)], "id int, file_name string")
    hold = lambda model: dialogue.run_dialogues(df, talk, model, template="{}", max_turns=9, work_dir=work, max_retries=0, backoff=0.0)

    def dies():
        def predict(paths, questions):
            if questions[0] == "q4":
                raise RuntimeError("killed")
            return ["a"] * len(paths)

        return predict

    with pytest.raises(Exception):
        hold(dies)
    assert len(list(calls.iterdir())) == 6  # two rounds of three
    got = hold(lambda: lambda paths, questions: ["a"] * len(paths)).collect()
    assert [(len(r.conversation), r.status) for r in got] == [(7, "ended")] * 3
    assert len(list(calls.iterdir())) == 12  # two more rounds, none twice


def test_grade_samples(spark):
    def make():
        failed = set()

        def client(messages, model):
            prompt = messages[1]["content"]
            description, answer = prompt.split("##")
            assert "conversation" not in description and json.loads(description)["file_name"]
            if answer == "later" and answer not in failed:
                failed.add(answer)
                return "sorry"
            if answer == "never":
                return "sorry"
            return "```json\n" + json.dumps([{"sentence": s, "result_type": 1, "reason": None} for s in answer.split(",")]) + "\n```"

        return client

    say = lambda *answers: [m for a in answers for m in (("evaluator", "q"), ("evaluatee", a))]
    rows = [(1, "1.jpg", say("a,b", "later")), (2, "2.jpg", say("never", "c")), (3, "3.jpg", [])]
    df = spark.createDataFrame(rows, "id int, file_name string, conversation array<struct<role:string,content:string>>")
    out = grading.grade_samples(df, make, template="{}##{}", max_retries=1, backoff=0.0)
    got = {r.id: ([g.sentence for g in r.grading_results], r.ungraded) for r in out.collect()}
    assert got == {1: (["a", "b", "later"], 0), 2: (["c"], 1), 3: ([], 0)}


@pytest.mark.parametrize("reply, ok", [
    ("[]", True), ("{}", False), ("```\n[]\n```", True), ("no", False), ("[1]", False), ("3", False),
    ('[{"sentence": "s", "result_type": 1}]', True), ('{"sentence": "s", "result_type": "2"}', True), ('[{"sentence": "s", "result_type": 1}] Done.', False),
    ("[{'sentence': 's', 'result_type': 1}]", False), ('{"results": [{"sentence": "s", "result_type": 1}]}', False), ('[{"sentence": "s", "result_type": 0.9}]', True),
    ('[{"sentence": "s", "result_type": "bad"}, {"sentence": "t", "result_type": 2}]', True), ('[{"result_type": 1}]', False), ('[{"sentence": null}]', False),
])
def test_one_rule_for_gradings(spark, reply, ok):
    from plumbline.functions.replies import parse_gradings

    assert inference.is_grading(reply) is ok
    parsed = spark.createDataFrame([(reply,)], "r string").select(parse_gradings("r")).first()[0]
    assert (parsed is not None) is ok


def test_a_code_that_cant_be_read_costs_no_sentence(spark):
    said = [{"sentence": "a", "result_type": "unsure"}, {"sentence": "b", "result_type": 1}, {"sentence": "c"}]
    calls = []
    def make():
        return lambda messages, model: calls.append(1) or json.dumps(said)
    talk = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([("1.jpg", [("evaluatee", "x")])], f"file_name string, conversation {talk}")
    (row,) = grading.grade_samples(df, make, template="{}##{}", max_retries=3, backoff=0.0).collect()
    assert [(g.sentence, g.result_type) for g in row.grading_results] == [("a", None), ("b", 1), ("c", None)]
    assert (row.ungraded, row.uncoded) == (0, 2)


def test_samples_are_graded_by_row(spark):
    """Two samples of one image, and one without a name."""
    grade = lambda: lambda messages, model: json.dumps([{"sentence": messages[1]["content"].split("##")[1], "result_type": 1}])
    talk = "array<struct<role:string,content:string>>"
    rows = [("1.jpg", [("evaluatee", "a")]), ("1.jpg", [("evaluatee", "b"), ("evaluatee", "c")]), (None, [("evaluatee", "d")])]
    out = grading.grade_samples(spark.createDataFrame(rows, f"file_name string, conversation {talk}"), grade, template="{}##{}", max_retries=0, backoff=0.0)
    assert sorted((str(r.file_name), [g.sentence for g in r.grading_results], r.ungraded) for r in out.collect()) == [
        ("1.jpg", ["a"], 0), ("1.jpg", ["b", "c"], 0), ("None", ["d"], 0),
    ]


def test_parses_leave_in_slices(spark):
    seen = []

    def make():
        return lambda text: ([dict(i=i, text=w, lemma=w, pos="X", dep="ROOT", head_i=i, ws=True) for i, w in enumerate(text.split())], [])

    df = spark.createDataFrame([("w " * 400,), ("v " * 300,), (None,)], "t string").coalesce(1)
    got = inference.annotate(df, "t", make, slice_tokens=200).collect()
    assert sorted(len(r.tokens) for r in got) == [0, 300, 400] and not seen


def test_replies_of_finished_tasks_survive_the_job(spark, tmp_path):
    """A job dies in one of its tasks: the next run asks only for what the tasks that ended have not been told."""
    calls, store, broken = tmp_path / "calls", str(tmp_path / "store"), tmp_path / "broken"
    calls.mkdir()
    broken.write_text("")

    def make():
        def client(messages, model):
            said = messages[0]["content"]
            if said == "7" and broken.exists():
                for _ in range(200):  # until the other tasks have written theirs
                    if len(os.listdir(calls)) >= 35 and len([f for f in os.listdir(store) if f.endswith(".parquet")]) >= 7:
                        break
                    time.sleep(0.1)
                os._exit(1)
            (calls / f"{said}-{uuid.uuid4()}").write_text("")
            return "re " + said

        return client

    rows = spark.range(0, 40, 1, 8).select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    ask = lambda: inference.chat_complete(rows, "messages", make, model="m", max_retries=0, partitions=8, store=store)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Exception):
            ask().collect()
        first = {f.split("-")[0] for f in os.listdir(calls)}
        kept = {r.reply for r in spark.read.parquet(store).collect()}
        assert len(kept) >= 20 and "re 7" not in kept
        broken.unlink()
        assert {r.id: r.reply for r in ask().collect()} == {i: f"re {i}" for i in range(40)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    counts = Counter(f.split("-")[0] for f in os.listdir(calls))
    assert all(counts[reply.removeprefix("re ")] == 1 for reply in kept) and counts.keys() == {str(i) for i in range(40)} and first
    assert ask().count() == 40 and Counter(f.split("-")[0] for f in os.listdir(calls)) == counts


def test_batches_of_alike_sizes(spark):
    """The same answers in the same rows; what a batch is padded to stays within the budget."""
    rng = random.Random(5)
    rows = [(n, f"{n}.jpg", " ".join(["w"] * rng.choice([0, 1, 3, 20, 60, 500]))) for n in range(3000)]
    df = spark.createDataFrame(rows, "n int, image string, question string").repartition(3)

    def make():
        return lambda images, questions: [f"{i} {len(q.split())} {len(images) * max(len(x.split()) for x in questions)}" for i, q in zip(images, questions)]

    for limit in (None, 7):
        got = inference.batch_infer(df, make, batch_budget=120, batch_size=limit, normalise=False).collect()
        assert len(got) == 3000
        for r in got:
            name, words, padded = r.output.split()
            assert name == r.image and int(words) == len(r.question.split())
            assert int(padded) <= 120 or int(padded) == int(words) == 500
    sizes = [rng.randrange(50) for _ in range(400)]
    batches = inference.sized_batches(sizes, 100)
    assert sorted(p for b in batches for p in b) == list(range(400))
    assert all(len(b) * max(sizes[p] for p in b) <= 100 or len(b) == 1 for b in batches)
    assert sum(len(b) * max(sizes[p] for p in b) for b in batches) < 1.2 * sum(sizes)
    assert inference.sized_batches([], 5) == [] and inference.sized_batches([0, 9, 0], 5) == [[1], [0, 2]]
    assert inference.row_size(b"abc", "x y") == 5 and inference.row_size("a.jpg", None) == 0
    assert inference.batch_infer(df.limit(0), make, batch_budget=10).collect() == []


def test_predictor_gets_bounded_batches(spark):
    make = lambda: lambda paths, questions: [str(len(paths))] * len(paths)
    df = spark.createDataFrame([("i", str(n)) for n in range(7)], "image string, question string").coalesce(1)
    got = inference.batch_infer(df, make, batch_size=3).collect()
    assert sorted(r.output for r in got) == ["1"] + ["3"] * 6


def test_annotations_of_two_files(spark, tmp_path):
    for n, names in (("a", "xy"), ("b", "z")):
        (tmp_path / f"{n}.json").write_text(json.dumps({
            "images": [{"id": ord(c), "file_name": c} for c in names], "annotations": [], "categories": [{"id": 1, "name": "one"}],
        }))
    tables = annotations.read_instances(spark, str(tmp_path / "*.json"))
    assert [r.file_name for r in tables["images"].orderBy("ord").collect()] == ["x", "y", "z"]
    assert tables["categories"].count() == 1


def test_debug_samples(spark):
    from plumbline.operators import samples

    images_ = spark.createDataFrame([(n, f"{n}.jpg", 9 - n) for n in range(9)], "image_id bigint, file_name string, ord bigint")
    boxes = spark.createDataFrame([(n, 1, [0.0], 1.0, n) for n in range(9)], "image_id bigint, category_id int, bbox array<double>, area double, ord bigint")
    said = spark.createDataFrame([(n, f"c{n}", n) for n in range(9)], "image_id bigint, caption string, ord bigint")
    kinds = spark.createDataFrame([(1, "dog")], "category_id int, name string")
    got = samples.debug_samples(images_, boxes, said, kinds, n=2).collect()
    assert sorted((r.file_name, len(r.instances), r.captions) for r in got) == [("7.jpg", 1, ["c7"]), ("8.jpg", 1, ["c8"])]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "instances.json").write_text(json.dumps({
        "info": {"year": 2017},
        "images": [{"id": 9, "file_name": "9.jpg", "width": 3}, {"id": 4, "file_name": "4.jpg"}],
        "annotations": [{"id": 1, "image_id": 9, "category_id": 2, "bbox": [1, 2.5, 3, 4], "area": 7, "iscrowd": 1, "segmentation": [[1, 2]]}],
        "categories": [{"id": 2, "name": "cat", "supercategory": "animal"}],
    }, indent=1))
    (tmp_path / "captions.json").write_text(json.dumps({
        "images": [], "annotations": [{"id": 5, "image_id": 4, "caption": "b"}, {"id": 3, "image_id": 4, "caption": "a"}],
    }))
    tables = annotations.read_instances(spark, str(tmp_path / "instances.json"))
    tables["captions"] = annotations.read_captions(spark, str(tmp_path / "captions.json"))
    landed = annotations.land(tables, str(tmp_path / "landed"))
    assert [tuple(r) for r in landed["images"].orderBy("ord").collect()] == [(9, "9.jpg", 0), (4, "4.jpg", 1)]
    assert [tuple(r) for r in landed["instances"].collect()] == [(9, 2, [1.0, 2.5, 3.0, 4.0], 7.0, 0)]
    assert [tuple(r) for r in landed["categories"].collect()] == [(2, "cat")]
    assert [(r.caption, r.ord) for r in landed["captions"].orderBy("ord").collect()] == [("b", 0), ("a", 1)]
    assert [r.image_id for r in annotations.image_ids(landed["images"]).orderBy("ord").collect()] == [9, 4]
    from plumbline.operators.samples import assemble_samples

    plan = assemble_samples(**landed)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # the category table, by its landed size


def test_tasks(spark, tmp_path):
    (tmp_path / "tasks.json").write_text(json.dumps([{"image": "a", "question": "q", "label": "yes"}], indent=4))
    df = tasks.read_tasks(spark, str(tmp_path / "tasks.json"))
    tasks.write_rows(df, str(tmp_path / "a" / "b"), "json")
    assert tasks.read_tasks(spark, str(tmp_path / "a" / "b"), "jsonl").first().label == "yes"
    tasks.write_rows(df.drop("image"), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        tasks.read_tasks(spark, str(tmp_path / "p"), "parquet")
    with pytest.raises(ValueError):
        tasks.read_rows(spark, "x", "csv")
    with pytest.raises(ValueError):
        tasks.write_rows(df, "x", "csv")


def test_conversation_and_grading_sinks(spark, tmp_path):
    schema = "id int, grading_results array<struct<sentence:string,result_type:int,reason:string>>, conversation array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("s", 0, "r")], [("evaluator", "a"), ("evaluatee", "b")])], schema)
    tasks.write_gradings(df, str(tmp_path / "g"))
    assert tasks.read_conversations(spark, str(tmp_path / "g"), schema=schema).first() == df.first()
    assert [r.content for r in tasks.read_turns(spark, str(tmp_path / "g"), schema=schema).orderBy("turn").collect()] == ["a", "b"]


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"A")
    (tmp_path / "b.jpg").write_bytes(b"B")
    df = spark.createDataFrame([(1, "b.jpg,a.jpg"), (2, "c.jpg"), (3, "http://x/y.jpg"), (4, "b.jpg,a.jpg"), (5, None)], "id int, image string")
    files = images.read_images(spark, str(tmp_path), "*.jpg")
    got = {r.id: r.contents and [None if c is None else bytes(c) for c in r.contents] for r in images.attach_images(df, files, str(tmp_path)).collect()}
    assert got == {1: [b"B", b"A"], 2: [None], 3: [None], 4: [b"B", b"A"], 5: None}
    refs = images.image_references(df, "d").collect()
    assert [(r.path, r.remote) for r in refs][:4] == [("d/b.jpg", False), ("d/a.jpg", False), ("d/c.jpg", False), ("http://x/y.jpg", True)]


def test_attached_images_come_from_all_parts(spark, sf_dir):
    from plumbline.plans.catalogue import attached_images

    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    pages = [r["page_id"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()]
    want = {p: f"{names.get(p, '-')}|{names.get(9 * p, '-')}" for p in pages}
    assert {r["page_id"]: r["contents"] for r in attached_images(spark, sf_dir).collect()} == want
    asked = {9 * p for p in pages}
    assert asked - names.keys() and any(k >= 90 for k in asked & names.keys())


def test_lexicons(spark, tmp_path):
    (tmp_path / "l.txt").write_text("  sea \n\nblue sea\nsea\n")
    words = lexicons.read_lexicon(spark, str(tmp_path / "l.txt"))
    assert lexicons.lexicon_values(words) == ["blue sea", "sea"]
    df = spark.createDataFrame([("deep sea",), ("sea",), ("seaside",), (None,)], "n string")
    flags = {r.n: (r.whole, r.scene) for r in lexicons.flag_members(
        lexicons.flag_members(df, "n", words, "whole"), "n", words, "scene", or_last_word=True).collect()}
    assert flags == {"deep sea": (False, True), "sea": (True, True), "seaside": (False, False), None: (False, False)}


def test_oversized_lexicon(monkeypatch):
    monkeypatch.setattr(lexicons, "MAX_INLINE_ENTRIES", 1)
    assert lexicons.lexicon_values(["a", "b"]) is None
