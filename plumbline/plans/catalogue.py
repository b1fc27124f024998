"""Queries over the driver tables, one per operator or small group of operators.

Every query reads whole tables. The tables stand in for the real inputs: orders are images,
line items instances, parts categories, conversations transcripts and captions, documents
texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import prompts, replies
from plumbline.functions import text as tx
from plumbline.functions.arrays import computed, listed
from plumbline.operators import dialogue, grading, inference, locate as locating, probes, samples, scenegraph, scoring, transcripts
from plumbline.plans import stubs
from plumbline.plans.tokens import hashed_tokens, shallow_tokens, words
from plumbline.session import shared_dir, spread, tune
from plumbline.sources import images as image_files
from plumbline.sources import annotations, jsonarrays, lexicons, tasks

Query = Callable[[SparkSession, str], DataFrame]

# Word lists for the made-up parse: pairs and triples that are frequent in the texts.
PHRASAL_VERBS = [
    "of the", "in the", "to the", "and the", "that the", "the of", "for the", "on the", "de la", "is the",
    "a the", "the and", "the to", "der die", "que la", "the in", "en la", "the the", "and of", "of of",
    "la la", "are the", "lich der", "the thedan", "the heorst", "ouelle par", "ra doñ", "eau éen", "ed lytionor", "thshat onan",
    "ththwhan and", "erinnter ththth", "hehely hehely", "ingble anreblehe",
]
PHRASAL_PREPS = [
    "of the", "in the", "to the", "and the", "the of", "de la", "the", "of", "and", "to", "a", "in", "en", "der",
    "of the and", "the of the", "that the", "die", "la", "is",
]
SCENE_WORDS = ["the", "and", "of the", "la", "der", "in", "is", "ring"]
PART_SCENES = ["ring", "bolt", "blue gear", "hot widget"]

STOP = "ing"
SIDE = {"user": scoring.TRUTH, "assistant": scoring.MODEL}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: the user evaluates, the assistant is evaluated, others are others."""
    role = (
        F.when(F.col("role") == "user", transcripts.EVALUATOR)
        .when(F.col("role") == "assistant", transcripts.EVALUATEE)
        .otherwise(F.col("role"))
    )
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), F.col("text").alias("content"))


def annotation_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, items, parts = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return {
        "images": orders.select(
            F.col("o_orderkey").alias("image_id"),
            F.concat("o_orderkey", F.lit(".jpg")).alias("file_name"),
            F.col("o_orderkey").alias("ord"),
        ),
        "instances": items.select(
            F.col("l_orderkey").alias("image_id"),
            F.col("l_partkey").alias("category_id"),
            F.array("l_quantity", "l_extendedprice").alias("bbox"),
            F.col("l_extendedprice").alias("area"),
            (F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey")).alias("ord"),
        ),
        "captions": turns(spark, sf_dir).select(
            F.col("conv_id").alias("image_id"), F.col("content").alias("caption"), F.col("turn").alias("ord")
        ),
        "categories": parts.select(F.col("p_partkey").alias("category_id"), F.col("p_type").alias("name")),
    }


def document_graphs(spark: SparkSession, sf_dir: str, want=("entities", "relations")) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scenegraph.extract_scene_graph(shallow_tokens(docs, "text"), keep_tokens=False, want=want)


def hashed_graphs(spark: SparkSession, sf_dir: str, want: tuple[str, ...], joined: bool = False) -> DataFrame:
    """Graphs of made-up parses; ``joined`` with the word lists as tables, among an entry for every line item."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lists = {"phrasal_verbs": PHRASAL_VERBS, "phrasal_preps": PHRASAL_PREPS, "scene_nouns": SCENE_WORDS}
    if joined:
        more = read(spark, sf_dir, "lineitem").select(F.concat_ws(" ", F.lit("item"), "l_orderkey", "l_linenumber", "l_partkey"))
        lists = {k: spark.createDataFrame([(x,) for x in v], "entry string").union(more) for k, v in lists.items()}
    return scenegraph.extract_scene_graph(
        docs, **lists, keep_tokens=False, want=want, inline_entries=0 if joined else None, parse=lambda rows: hashed_tokens(rows, "text", "doc_id")
    )


def conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are the ground truth of a conversation, assistant turns the model's claims.

    Each turn is parsed by itself, so that a long conversation never has to be one text.
    """
    side = F.when(F.col("role") == transcripts.EVALUATOR, scoring.TRUTH).otherwise(scoring.MODEL)
    of_both = F.col("role").isin(transcripts.EVALUATOR, transcripts.EVALUATEE)
    said = spread(turns(spark, sf_dir).where(of_both)).select("conv_id", side.alias("side"), "content")
    graphs = scenegraph.extract_scene_graph(shallow_tokens(said, "content"), keep_tokens=False)
    return scoring.graph_facts(graphs, "conv_id", "side")


def modifier_text(modifiers: Column) -> Column:
    return F.array_join(F.transform(modifiers, lambda m: F.concat_ws(":", m["dep"], m["span"], m["lemma_span"])), ",")


# --- text, paths, prompts -------------------------------------------------------------------


def normalise_answers(spark, sf_dir):
    said = transcripts.evaluatee_turns(turns(spark, sf_dir))
    return said.select("conv_id", "turn", tx.normalise_answer("content").alias("output"))


def text_edges(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        tx.cut_at("text", " the ").alias("before_marker"),
        F.array_join(tx.after_prompt(words("text"), (F.col("doc_id") % 50).cast("int")), " ").alias("after_prompt"),
        tx.last_word("text").alias("last_word"),
        tx.strip("text").alias("stripped"),
    )


def image_paths(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    name = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("/abs/"), "page_id"))
        .when(F.col("page_id") % 4 == 2, F.concat("page_id", F.lit(".jpg, b/"), "page_id", F.lit(".png")))
        .otherwise(F.concat("page_id", F.lit(".jpg")))
    )
    rows = pages.select(
        "page_id", name.alias("image"), tx.square_edge(F.length("url"), F.length("html")).alias("edge")
    )
    return image_files.image_references(rows, "data/images").drop("image")


def conversation_styles(spark, sf_dir):
    fragments = F.array(*map(F.lit, ["LLaMA-2", "Mistral-v1", "v1.6-34b", "V1.5", "mpt", "base"]))
    model = F.concat(
        F.lit("x-"), F.get(fragments, (F.col("p_partkey") % 6).cast("int")), F.lit("-"), "p_brand"
    )
    explicit = F.when(F.col("p_size") % 5 == 0, F.lit("mpt"))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        prompts.conversation_style(model).alias("inferred"),
        prompts.conversation_style(model, explicit).alias("style"),
        prompts.style_overridden(model, explicit).alias("overridden"),
    )


def vqa_prompts(spark, sf_dir):
    marked = {"placeholder": "the", "image_token": "<im>"}
    return turns(spark, sf_dir).where(F.col("role") == transcripts.EVALUATOR).select(
        "conv_id",
        "turn",
        prompts.vqa_prompt("content", **marked).alias("plain"),
        prompts.vqa_prompt("content", wrap=("<s>", "</s>"), **marked).alias("wrapped"),
        prompts.vqa_prompt("content", separator="", **marked).alias("joined"),
    )


# --- lexicons -------------------------------------------------------------------------------


def lexicon_scan(spark, sf_dir):
    lines = spread(read(spark, sf_dir, "documents").select("text")).select(F.explode(F.split("text", "\n")).alias("line"))
    return lexicons.lexicon_entries(lines, "line")


def scene_flags(spark, sf_dir):
    scenes = spark.createDataFrame([(s,) for s in PART_SCENES], "entry string")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = lexicons.flag_members(parts, "p_name", scenes, "scene", or_last_word=True)
    return joined.withColumn("scene_inline", scenegraph.is_scene_noun(F.col("p_name"), PART_SCENES))


# --- samples --------------------------------------------------------------------------------


def assemble_samples(spark, sf_dir):
    rows = samples.assemble_samples(**annotation_tables(spark, sf_dir))
    instance_text = F.transform(
        "instances",
        lambda x: F.concat_ws(":", x["category"], F.get(x["bbox"], F.lit(0)).cast("int"), (x["pixel_area"] * 100).cast("decimal(20,0)")),
    )
    return rows.select(
        "image_id",
        "file_name",
        F.array_join(instance_text, "|").alias("instances"),
        F.array_join("captions", "|").alias("captions"),
    )


def caption_texts(spark, sf_dir):
    tables = annotation_tables(spark, sf_dir)
    rows = samples.caption_lists(tables["images"], tables["captions"])
    return rows.select("image_id", samples.caption_text().alias("ground_truth"))


def sample_stats(spark, sf_dir):
    tables = annotation_tables(spark, sf_dir)
    return samples.sample_stats(tables["images"], tables["instances"], tables["captions"])


def unknown_categories(spark, sf_dir):
    """Nations stand in for a category table that lacks most ids."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"))
    return samples.unknown_categories(annotation_tables(spark, sf_dir)["instances"], nations)


def debug_head(spark, sf_dir):
    return samples.first_images(annotation_tables(spark, sf_dir)["images"], 30)


def debug_samples(spark, sf_dir):
    rows = samples.debug_samples(**annotation_tables(spark, sf_dir), n=30)
    return rows.select("image_id", "file_name", F.size("instances").alias("n_instances"), F.array_join("captions", "|").alias("captions"))


# --- transcripts and grading ----------------------------------------------------------------


def truncate_at_marker(spark, sf_dir):
    return transcripts.truncate_at_marker(turns(spark, sf_dir), "conv_id", marker=STOP)


def evaluatee_turns(spark, sf_dir):
    return transcripts.evaluatee_turns(turns(spark, sf_dir))


def transcript_lists(spark, sf_dir):
    nested = transcripts.nest_transcripts(turns(spark, sf_dir), "conv_id")
    said = F.transform("conversation", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return nested.select("conv_id", F.array_join(said, "\n").alias("conversation"))


def transcript_turns(spark, sf_dir):
    """Nest in parts of two turns, write, read back and explode."""
    path = shared_dir(spark)
    nested = transcripts.nest_transcripts(turns(spark, sf_dir), "conv_id", part_rows=2)
    tasks.write_conversations(nested, path)
    return tasks.read_turns(spark, path, schema=nested.schema)


def grader_prompts(spark, sf_dir):
    nested = transcripts.nest_transcripts(turns(spark, sf_dir), "conv_id", part_rows=3)
    asked = grading.grader_messages(
        nested.withColumn("file_name", F.concat("conv_id", F.lit(".jpg"))), template="about {} {{exactly}}: {}"
    )
    flat = F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"]))
    return asked.select("conv_id", "turn", F.array_join(flat, "\n").alias("messages"))


def event_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graders' replies of every kind, made from event properties."""
    k = F.get_json_object("props", "$.k")
    row = F.concat(
        F.lit('{"sentence": "'), F.col("event_type"), F.lit('", "result_type": '), k, F.lit(', "reason": "r'), k, F.lit('"}')
    )
    quoted = F.concat(F.lit('[{"sentence": "q", "result_type": "'), k, F.lit('"}]'))
    kind = F.col("event_id") % 6
    reply = (
        F.when(kind == 0, F.concat(F.lit("["), row, F.lit(","), row, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n["), row, F.lit("]\n``` done")))
        .when(kind == 2, F.concat(F.lit("```\n["), row, F.lit("]\n```")))
        .when(kind == 3, quoted)
        .when(kind == 4, row)
        .otherwise(F.concat(F.lit("no json "), k))
    )
    return read(spark, sf_dir, "events").select("event_id", "user_id", reply.alias("raw"))


def nested_parts(spark, sf_dir):
    """Every conversation in parts of three turns."""
    nested = transcripts.nest_transcripts(turns(spark, sf_dir), "conv_id", part_rows=3)
    said = F.transform("conversation", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return nested.select("conv_id", "part", "first_position", F.array_join(said, "\n").alias("conversation"))


def sample_parts(spark, sf_dir):
    """Captions of the line items' images, in parts of two annotations: instances first."""
    rows = samples.assemble_samples(**annotation_tables(spark, sf_dir), part_rows=2)
    return rows.select("image_id", "part", F.size("instances").alias("n_instances"), F.array_join("captions", "|").alias("captions"))


def grading_parts(spark, sf_dir):
    parsed = event_replies(spark, sf_dir).withColumn("gradings", replies.parse_gradings("raw"))
    lists = grading.concat_gradings(parsed, ["user_id"], turn="event_id", part_rows=4)
    flat = F.transform("grading_results", lambda g: F.concat_ws(":", g["sentence"], g["result_type"], g["reason"]))
    return lists.select("user_id", "part", F.array_join(flat, ",").alias("grading_results"))


def grade_parse(spark, sf_dir):
    parsed = event_replies(spark, sf_dir).withColumn("gradings", replies.parse_gradings("raw"))
    return grading.grading_table(parsed, "event_id")


def grading_lists(spark, sf_dir):
    parsed = event_replies(spark, sf_dir).withColumn("gradings", replies.parse_gradings("raw"))
    lists = grading.concat_gradings(parsed, ["user_id"], turn="event_id")
    flat = F.transform("grading_results", lambda g: F.concat_ws(":", g["sentence"], g["result_type"], g["reason"]))
    return lists.select("user_id", F.array_join(flat, ",").alias("grading_results"))


# --- scene graphs ---------------------------------------------------------------------------


def graph_entities(spark, sf_dir):
    return scenegraph.entity_view(document_graphs(spark, sf_dir, ("entities",)), "doc_id")


def graph_relations(spark, sf_dir):
    return scenegraph.graph_view(document_graphs(spark, sf_dir), "doc_id")[1].drop("relation_id")


def graph_endpoints(spark, sf_dir):
    """The same relations from entity and relation tables stored apart, written once each."""
    graphs = inference.materialise(document_graphs(spark, sf_dir))
    entities = scenegraph.entity_table(graphs, "doc_id")
    return scoring.endpoint_heads(scenegraph.relation_table(graphs, "doc_id"), entities, ["doc_id"]).drop("relation_id")


def rule_entities(spark, sf_dir):
    entities = scenegraph.entity_table(hashed_graphs(spark, sf_dir, ("entities",)), "doc_id")
    return entities.select(
        "doc_id", "entity_id", "span", "lemma_span", "head", "lemma_head",
        F.col("span_bounds.start").alias("span_start"), F.col("span_bounds.end").alias("span_end"),
        modifier_text(F.col("modifiers")).alias("modifiers"), "type",
    )


def rule_relations(spark, sf_dir):
    return scenegraph.relation_table(hashed_graphs(spark, sf_dir, ("relations",)), "doc_id").drop("relation_id")


def rule_relations_joined(spark, sf_dir):
    """The same with word lists that are joined."""
    graphs = hashed_graphs(spark, sf_dir, ("relations",), joined=True)
    return scenegraph.relation_table(graphs, "doc_id").drop("relation_id")


def rule_types_joined(spark, sf_dir):
    """Types of the entities' nouns by a list that is joined."""
    graphs = hashed_graphs(spark, sf_dir, ("entities",), joined=True)
    return scenegraph.entity_table(graphs, "doc_id").select("doc_id", "entity_id", "lemma_head", "type")


def located_relations(spark, sf_dir):
    """The same relations, their ends found by an interval join of positions and spans as tables."""
    graphs = inference.materialise(hashed_graphs(spark, sf_dir, ("positions",)).select("doc_id", "relation_positions", "entity_spans"))
    relations = listed(graphs, ["doc_id"], "relation_positions", "relation_id").drop("relation_id")
    spans = listed(graphs, ["doc_id"], "entity_spans", "at").drop("at")
    return locating.locate_relations(relations, spans, ["doc_id"])


def merged_entities(spark, sf_dir):
    merged = computed(document_graphs(spark, sf_dir, ("entities",)).select("doc_id", "entities"), {"merged": scoring.merged_in_row(F.col("entities"))})
    heads = listed(merged, ["doc_id"], "merged", "n")
    return heads.select("doc_id", "head", F.array_join("attributes", ",").alias("attributes"))


def merged_table(spark, sf_dir):
    """The same from an entity table, in parts of three entities. Nesting reads its rows twice, so the table is written first."""
    entities = scenegraph.entity_table(document_graphs(spark, sf_dir, ("entities",)), "doc_id")
    entities = inference.materialise(entities.select("doc_id", "entity_id", "head", "modifiers"))
    merged = scoring.merge_entities(entities, ["doc_id"], part_rows=3)
    return merged.select("doc_id", "head", "part", F.array_join("attributes", ",").alias("attributes"))


# --- scores ---------------------------------------------------------------------------------


def judge_scores(spark, sf_dir):
    return scoring.score_facts(conversation_facts(spark, sf_dir), "conv_id")


def metric_report(spark, sf_dir):
    return scoring.metric_report(judge_scores(spark, sf_dir))


def object_hallucination(spark, sf_dir):
    return scoring.unsupported_objects(conversation_facts(spark, sf_dir), "conv_id")


def relation_hallucination(spark, sf_dir):
    return scoring.unsupported_relations(conversation_facts(spark, sf_dir), "conv_id")


def probe_scores(spark, sf_dir):
    # the answer is read before the join, so no text is shuffled
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", probes.yes_no("text").alias("prediction"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"))
    rows = docs.join(labels, "doc_id").select(
        F.col("lang").alias("probe_set"), F.col("source").alias("model"), "label", "prediction"
    )
    return probes.score_probes(rows, ["probe_set", "model"], prediction=F.col("prediction"))


def probe_sets(spark, sf_dir):
    """Probes of orders for the types of their line items' parts."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    shown = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return probes.probe_sets(shown, "l_orderkey", "p_type", start=F.col("image") * 48271)


# --- stages that call out -------------------------------------------------------------------


def batch_inference(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", F.concat("doc_id", F.lit(".jpg")).alias("image"), F.col("text").alias("question")
    )
    answered = inference.batch_infer(docs, stubs.word_count_model)
    return answered.select("doc_id", "source", "output")


def result_round_trip(spark, sf_dir):
    """Question rows with outputs, written as JSON lines and read back with their schema."""
    path = shared_dir(spark)
    rows = turns(spark, sf_dir).select(
        F.concat("conv_id", F.lit(".jpg")).alias("image"), F.col("content").alias("question"), "turn"
    )
    answered = inference.batch_infer(rows, stubs.word_count_model)
    tasks.write_rows(answered, path, "json")
    return tasks.read_tasks(spark, path, "jsonl", answered.schema)


def json_array_scan(spark, sf_dir):
    """Question rows with outputs, written as one JSON array and read by many tasks."""
    path = f"{shared_dir(spark)}/answers.json"
    rows = turns(spark, sf_dir).select(
        F.concat("conv_id", F.lit(".jpg")).alias("image"), F.col("content").alias("question"), "turn", F.array("role").alias("roles")
    )
    tasks.write_rows(inference.batch_infer(rows, stubs.word_count_model), path, "array")
    return tasks.read_tasks(spark, path, "json", "image string, question string, turn bigint, roles array<string>, output string").select(
        "image", "question", "turn", F.array_join("roles", ",").alias("roles"), "output"
    )


def _annotation_file(spark, sf_dir):
    """The tables of an instance file of line items, written as one file and read by many tasks."""
    path = f"{shared_dir(spark)}/instances.json"
    tables = annotation_tables(spark, sf_dir)
    jsonarrays.write_json_fields(
        {
            "images": tables["images"].select(F.col("image_id").alias("id"), "file_name"),
            "annotations": tables["instances"].select(F.col("ord").alias("id"), "image_id", "category_id", "bbox", "area"),
            "categories": tables["categories"].select(F.col("category_id").alias("id"), "name"),
        },
        path,
        ["id"],
    )
    return annotations.read_instances(spark, path)


def annotation_scan(spark, sf_dir):
    """Instances with their place in the file and their category's name."""
    tables = _annotation_file(spark, sf_dir)
    box = F.array_join(F.transform("bbox", lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return tables["instances"].join(tables["categories"], "category_id", "left").select(
        "image_id", "category_id", "name", box.alias("bbox"), F.round(F.col("area") * 100).cast("long").alias("area")
    )


def image_id_scan(spark, sf_dir):
    return annotations.image_ids(_annotation_file(spark, sf_dir)["images"])


def chat_replies(spark, sf_dir):
    asked = turns(spark, sf_dir).withColumn("messages", prompts.opening_messages("s", F.col("content")))
    done = inference.chat_complete(
        asked, "messages", stubs.echo_chat, model="m", max_retries=2, backoff=0.0, concurrency=4
    )
    return done.select("conv_id", "turn", "reply", "reply_error")


def annotated_turns(spark, sf_dir):
    parsed = inference.annotate(spread(turns(spark, sf_dir)), "content", stubs.long_word_annotator)
    graphs = scenegraph.extract_scene_graph(parsed)
    heads = F.array_join(F.transform("entities", lambda e: e["head"]), " ")
    return graphs.select("conv_id", "turn", F.size("tokens").alias("n_tokens"), heads.alias("heads"))


def dialogues(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_custkey", F.lit(".jpg")).alias("file_name")
    )
    held = dialogue.run_dialogues(
        customers, stubs.interviewer(4), stubs.interviewed, image_dir="data/val", template="{}", max_turns=3, max_retries=0, backoff=0.0
    )
    said = F.transform("conversation", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return held.select("c_custkey", F.array_join(said, "\n").alias("conversation"), "status")


def graded_repeats(spark, sf_dir):
    """Samples of one file name each: every row is graded by itself."""
    nested = transcripts.nest_transcripts(turns(spark, sf_dir), "conv_id").withColumn("file_name", F.concat(F.col("conv_id") % 3, F.lit(".jpg")))
    path = shared_dir(spark)
    graded = grading.grade_samples(nested.drop("conv_id"), stubs.length_grader, template="{}\x1f{}", model="g", max_retries=0, backoff=0.0)
    tasks.write_gradings(graded, path, "parquet")
    back = tasks.read_conversations(spark, path, "parquet", graded.schema)
    return back.select(
        "file_name", F.size("conversation").alias("turns"), F.size("grading_results").alias("gradings"), "ungraded",
        F.array_join(F.transform("grading_results", lambda g: g["sentence"]), ",").alias("sentences"),
    )


def attached_images(spark, sf_dir):
    """Bytes of the images each page shows; parts stand in for image files.

    The second image is spread over all parts; the last pages ask for missing ones.
    """
    pages = read(spark, sf_dir, "pages").select(
        "page_id", F.concat("page_id", F.lit(".jpg,"), F.col("page_id") * 9, F.lit(".jpg")).alias("image")
    )
    files = read(spark, sf_dir, "part").select(
        F.concat(F.lit("img/"), "p_partkey", F.lit(".jpg")).alias("path"), F.col("p_name").cast("binary").alias("content")
    )
    shown = image_files.attach_images(pages, files, "img")
    contents = F.transform("contents", lambda c: F.coalesce(c.cast("string"), F.lit("-")))
    return shown.select("page_id", F.array_join(contents, "|").alias("contents"))


def graded_samples(spark, sf_dir):
    nested = transcripts.nest_transcripts(turns(spark, sf_dir), "conv_id")
    graded = grading.grade_samples(
        nested, stubs.length_grader, template="{}\x1f{}", model="g", max_retries=1, backoff=0.0
    )
    flat = F.transform("grading_results", lambda g: F.concat_ws(":", g["sentence"], g["result_type"], g["reason"]))
    return graded.select("conv_id", F.array_join(flat, ",").alias("grading_results"), "ungraded")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        normalise_answers, text_edges, image_paths, conversation_styles, vqa_prompts,
        lexicon_scan, scene_flags,
        assemble_samples, sample_parts, caption_texts, sample_stats, unknown_categories, debug_head, debug_samples,
        truncate_at_marker, evaluatee_turns, transcript_lists, nested_parts, transcript_turns, grader_prompts,
        grade_parse, grading_lists, grading_parts,
        graph_entities, graph_relations, graph_endpoints, rule_entities, rule_relations, merged_entities, merged_table,
        judge_scores, metric_report, object_hallucination, relation_hallucination, probe_scores,
        rule_relations_joined, rule_types_joined, located_relations, probe_sets,
        batch_inference, result_round_trip, json_array_scan, annotation_scan, image_id_scan, chat_replies, annotated_turns, dialogues, graded_samples,
        graded_repeats, attached_images,
    )
}
