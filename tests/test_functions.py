import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import prompts, replies
from plumbline.functions import text as tx
from plumbline.functions.arrays import computed, entries_of, first_of, indices, keyed, last_of


def values(spark, expression, inputs, schema="v string"):
    df = spark.createDataFrame([(n, *((x,) if not isinstance(x, tuple) else x)) for n, x in enumerate(inputs)], "n int, " + schema)
    return [r.r for r in df.select("n", expression.alias("r")).orderBy("n").collect()]


def test_normalise_answer(spark):
    given_ = [" Yes. ", "yes .", "2.5 M.", "\t\nNo \x1c\n", "...", "", None, "\x85a b　"]
    want = [x if x is None else x.strip().replace(".", "").lower() for x in given_]
    assert values(spark, tx.normalise_answer("v"), given_) == want
    assert want[:3] == ["yes", "yes ", "25 m"]


EDGES = st.text(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　.aZé"), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(EDGES, min_size=20, max_size=60))
def test_normalise_answer_as_python(spark, texts):
    assert values(spark, tx.normalise_answer("v"), texts) == [t.strip().replace(".", "").lower() for t in texts]


def test_join_path(spark):
    assert values(spark, tx.join_path("a/b", F.col("v")), ["x.jpg", "/abs/x.jpg", "", None]) == ["a/b/x.jpg", "/abs/x.jpg", "a/b/", None]
    assert values(spark, tx.join_path("a/", F.col("v")), ["x"]) == ["a/x"]
    assert values(spark, tx.join_path("", F.col("v")), ["x"]) == ["x"]


def test_small_text_functions(spark):
    assert values(spark, tx.cut_at("v"), ["a</s>b</s>", "no mark"]) == ["a", "no mark"]
    assert values(spark, tx.last_word("v"), ["big blue sea", "sea", "sea "]) == ["sea", "sea", ""]
    assert values(spark, tx.image_list("v"), ["a, b", "c"]) == [["a", " b"], ["c"]]
    assert values(spark, tx.is_remote("v"), ["http://x", "https://x", "x/http"]) == [True, True, False]
    assert values(spark, tx.after_prompt("v", 2), [([1, 2, 3],), ([1],)], "v array<int>") == [[3], []]
    assert values(spark, tx.square_edge("a", "b"), [(3, 5)], "a int, b int") == [5]


@pytest.mark.parametrize(
    "name, style",
    [
        ("LLaVA-Llama-2-13b", "llava_llama_2"),
        ("llava-v1.6-mistral-7b", "mistral_instruct"),
        ("llava-v1.6-34b", "chatml_direct"),
        ("llava-v1.5-13b", "llava_v1"),
        ("llava-mpt-7b", "mpt"),
        ("other", "llava_v0"),
    ],
)
def test_conversation_style(spark, name, style):
    assert values(spark, prompts.conversation_style("v"), [name]) == [style]
    assert values(spark, prompts.conversation_style("v", F.lit("own")), [name]) == ["own"]
    assert values(spark, prompts.style_overridden("v", F.lit(style)), [name]) == [False]


def test_vqa_prompt(spark):
    q = ["What is it?", "In <image-placeholder>: what?"]
    assert values(spark, prompts.vqa_prompt("v"), q) == ["<image>\nWhat is it?", "In <image>: what?"]
    assert values(spark, prompts.vqa_prompt("v", wrap=("<s>", "<e>")), q) == ["<s><image><e>\nWhat is it?", "In <s><image><e>: what?"]
    assert values(spark, prompts.vqa_prompt("v", separator=""), q)[0] == "<image>What is it?"


def test_fill_template(spark):
    c = prompts.fill_template("a {} {{b}} {}", F.col("v"), F.lit(2).cast("string"))
    assert values(spark, c, ["x{}"]) == ["a x{} {b} 2"]
    with pytest.raises(ValueError):
        prompts.fill_template("{} {}", F.lit("x"))


ROW = '{"sentence": "s", "result_type": 1, "reason": "r"}'


@pytest.mark.parametrize(
    "reply, want",
    [
        (f"[{ROW}]", [("s", 1, "r")]),
        (f"text\n```json\n[{ROW},{ROW}]\n```\nmore", [("s", 1, "r")] * 2),
        (f"```\n[{ROW}]\n```", [("s", 1, "r")]),
        (ROW, [("s", 1, "r")]),
        ('[{"sentence": "s", "result_type": "0", "reason": "r"}]', [("s", 0, "r")]),
        ('[{"sentence": "s", "result_type": "bad"}]', [("s", None, None)]),
        ("I cannot say", None),
        ("[]", []),
        (None, None),
    ],
)
def test_parse_gradings(spark, reply, want):
    (got,) = values(spark, replies.parse_gradings("v"), [reply])
    assert got is None if want is None else [tuple(g) for g in got] == want


def test_keyed(spark):
    entries = "array<struct<k:int,v:string>>"
    rows = [([(4, "c"), (1, "b"), (1, "a")],), ([],), ([(0, "x")],)]
    found = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(entries_of(F.col("i"), k), lambda e: e["v"]))
    df = computed(spark.createDataFrame(rows, f"e {entries}"), {"i": keyed(F.col("e"))})
    got = [r.f for r in df.select(found.alias("f")).collect()]
    assert got == [[[], ["a", "b"], [], [], ["c"], []], [[]] * 6, [["x"], [], [], [], [], []]]
    ends = df.select(first_of(F.col("i"), F.lit(1))["v"], last_of(F.col("i"), F.lit(1))["v"], last_of(F.col("i"), F.lit(2))["v"]).collect()
    assert tuple(ends[0]) == ("a", "b", None)
    assert values(spark, indices(F.col("a")), [([5, 6],), ([],)], "a array<int>") == [[0, 1], []]


def test_computed_is_not_repeated(spark):
    df = computed(spark.range(3), {"a": F.transform(F.array("id"), lambda x: x + 1)})
    plan = df.where(F.size("a") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform") == 1


def test_stateless_over_stream(spark, tmp_path):
    from plumbline.operators.transcripts import evaluatee_turns

    rows = [(1, 0, "evaluator", "Is it?"), (1, 1, "evaluatee", " Yes. ")]
    spark.createDataFrame(rows, "id int, turn int, role string, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, turn int, role string, content string").parquet(str(tmp_path / "in"))
    out = evaluatee_turns(stream).withColumn("output", tx.normalise_answer("content"))
    query = (
        out.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(60)
    assert [r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["yes"]
