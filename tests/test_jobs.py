"""Whole jobs over files, with stand-ins."""

import json

from parses import RULES, document
from pyspark.sql import functions as F

from plumbline.plans import jobs
from plumbline.sources import tasks


def test_answer_questions(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"image": "a.jpg", "question": "Q?", "label": "yes"}, {"image": "/b.jpg", "question": "R?", "label": "no"}]))
    make = lambda: lambda paths, questions: [f" {p} {q}. " for p, q in zip(paths, questions)]
    jobs.answer_questions(spark, str(tmp_path / "in.json"), str(tmp_path / "new" / "out"), make, image_dir="data")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "new" / "out")).select("image", "label", "output").collect())
    assert got == [("/b.jpg", "no", "/bjpg r?"), ("a.jpg", "yes", "data/ajpg q?")]


def test_settings_of_a_model_family_reach_the_predictor(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"image": "a", "question": "q"}]))

    def make(num_beams, max_new_tokens, temperature):
        return lambda paths, questions: [f"{num_beams} {max_new_tokens} {temperature}"] * len(paths)

    jobs.answer_questions(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), make, model="llava")
    assert spark.read.parquet(str(tmp_path / "out")).first().output == "1 512 00"


def test_dialogues_then_grades(spark, tmp_path):
    talk = lambda: lambda messages, model: "END" if len(messages) > 3 else "What?"
    answer = lambda: lambda paths, questions: ["A dog."] * len(paths)
    grade = lambda: lambda messages, model: json.dumps([{"sentence": "a dog", "result_type": 1, "reason": "seen"}])
    samples = spark.createDataFrame([("1.jpg", ["a dog"]), ("2.jpg", [])], "file_name string, captions array<string>")
    jobs.hold_dialogues(samples, str(tmp_path / "conv"), talk, answer, image_dir="d", max_turns=5, max_retries=0, backoff=0.0)
    held = tasks.read_conversations(spark, str(tmp_path / "conv"))
    assert [len(r.conversation) for r in held.collect()] == [3, 3]
    jobs.grade_conversations(spark, str(tmp_path / "conv"), str(tmp_path / "graded"), grade, max_retries=0, backoff=0.0)
    rows = tasks.read_rows(spark, str(tmp_path / "graded"), "jsonl").orderBy("file_name").collect()
    assert [(r.file_name, r.status, r.grading_results[0].result_type, r.ungraded) for r in rows] == [
        ("1.jpg", "ended", 1, 0), ("2.jpg", "ended", 1, 0),
    ]


def test_files_to_samples(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({
        "images": [{"id": n, "file_name": f"{n}.jpg"} for n in (5, 3, 4)],
        "annotations": [{"id": n, "image_id": n, "category_id": 1, "bbox": [0, 0, 1, 1], "area": 1} for n in (3, 4, 5)],
        "categories": [{"id": 1, "name": "dog"}],
    }))
    (tmp_path / "c.json").write_text(json.dumps({"images": [], "annotations": [{"id": n, "image_id": n, "caption": f"c{n}"} for n in (3, 4, 5)]}))
    for debug, want in ((None, ["3.jpg", "4.jpg", "5.jpg"]), (2, ["3.jpg", "5.jpg"])):
        out = str(tmp_path / f"out-{debug}")
        jobs.assemble_files(spark, str(tmp_path / "i.json"), str(tmp_path / "c.json"), out, debug=debug)
        rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r.file_name)
        assert [r.file_name for r in rows] == want and all(len(r.instances) == len(r.captions) == 1 for r in rows)


def test_judge_texts(spark):
    parses = {}
    for name in ("active", "noun_preposition", "copula"):
        words, chunks, _ = RULES[name]
        _, tokens, noun_chunks = document(name, words, chunks)
        fields = ("i", "text", "lemma", "pos", "dep", "head_i", "ws")
        chunk_fields = ("chunk_id", "start", "end", "root_i", "text", "lemma")
        parses[name] = ([dict(zip(fields, t)) for t in tokens], [dict(zip(chunk_fields, c)) for c in noun_chunks])
    make = lambda: parses.__getitem__
    truth = spark.createDataFrame([(1, "active"), (2, "noun_preposition"), (2, "copula"), (3, "active")], "case_id int, text string")
    said = spark.createDataFrame([(1, "active"), (2, "active"), (3, "copula")], "case_id int, text string")
    got = {r.case_id: (r.object_hallucination_num, r.relation_hallucination_num) for r in jobs.judge_texts(truth, said, make).collect()}
    # 1: its own graph; 2 and 3: nothing in common, so every noun and relation counts
    assert got == {1: (0, 0), 2: (3, 2), 3: (2, 1)}
    samples_ = spark.createDataFrame([("1.jpg", ["active"]), ("2.jpg", ["noun_preposition"])], "file_name string, captions array<string>")
    answers = spark.createDataFrame([("1.jpg", "active"), ("2.jpg", "active")], "file_name string, text string")
    scores = {r.file_name: r.object_hallucination_num for r in jobs.judge_samples(samples_, answers, make).collect()}
    assert scores["1.jpg"] == 0 and scores["2.jpg"] >= 1
