import random
import time

import pytest
from parses import ENTITIES, RULES, document
from pyspark.sql import functions as F

from plumbline.operators import scenegraph
from plumbline.operators.scenegraph import (
    CHUNKS,
    TOKENS,
    entity_table,
    extract_scene_graph,
    graph_view,
    relation_table,
)

SCHEMA = f"doc_id string, tokens {TOKENS}, chunks {CHUNKS}"
LEXICONS = {
    "phrasal_verbs": ["wait for", "give up on"],
    "phrasal_preps": ["on top of"],
    "scene_nouns": ["street", "kitchen"],
}


def graphs(spark, cases, **options):
    rows = [document(name, words, chunks) for name, (words, chunks, _) in cases.items()]
    return extract_scene_graph(spark.createDataFrame(rows, SCHEMA), **LEXICONS, **options)


@pytest.fixture(scope="module")
def rules(spark):
    return {r.doc_id: r for r in graphs(spark, RULES).collect()}


@pytest.fixture(scope="module")
def entities(spark):
    return {r.doc_id: r for r in graphs(spark, ENTITIES).collect()}


@pytest.mark.parametrize("name", RULES)
def test_relations(rules, name):
    got = [(r.subject, r.relation, r.object) for r in rules[name].relations]
    assert got == RULES[name][2]


@pytest.mark.parametrize("name", ENTITIES)
def test_entities(entities, name):
    got = [
        (e.head, e.lemma_head, [(m.dep, m.span) for m in e.modifiers], e.type) for e in entities[name].entities
    ]
    assert got == ENTITIES[name][2]


def test_lemma_relation_stops_one_short(rules):
    (relation,) = rules["phrasal_preposition"].relations
    assert relation.lemma_relation == "on top"


def test_passive_lemma(rules):
    assert rules["passive"].relations[0].lemma_relation == "sign"


def test_drop_pronouns(spark):
    case = {"pronoun_tagged": ENTITIES["pronoun_tagged"]}
    (row,) = graphs(spark, case, drop_pronouns=True).collect()
    assert [e.head for e in row.entities] == ["dog"]
    assert row.relations == []  # its subject was the pronoun


def test_overlapping_chunks_first_wins(spark):
    words = "man/NOUN/nsubj/1 eats|eat/VERB/ROOT/1 bread/NOUN/dobj/1"
    case = {"overlap": (words, [(0, 3, 0), (2, 3, 2)], None)}
    (row,) = graphs(spark, case).collect()
    assert [(r.subject, r.object) for r in row.relations] == [(0, 0)]


def test_empty_documents(spark):
    rows = [("none", [], [])]
    (row,) = extract_scene_graph(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row.entities == [] and row.relations == []


def test_no_exchange(spark):
    plan = graphs(spark, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("want", [("entities",), ("relations",)])
def test_only_what_is_wanted(spark, rules, want):
    got = {r.doc_id: r for r in graphs(spark, RULES, want=want).collect()}
    assert all(got[name][want[0]] == rules[name][want[0]] for name in RULES)
    plan = graphs(spark, RULES, want=want)._jdf.queryExecution().executedPlan().toString()
    assert ("_where" in plan) is (want == ("relations",)) and ("_members" in plan) is (want == ("entities",))


def test_tables_and_view(spark):
    g = graphs(spark, {"active": RULES["active"]})
    assert [(r.entity_id, r.span) for r in entity_table(g, "doc_id").collect()] == [
        (0, "Two painters"), (1, "a wall"), (2, "the bridge"),
    ]
    assert relation_table(g, "doc_id").count() == 2
    ents, rels = graph_view(g, "doc_id")
    assert [(r["head"], r["span"], r["modifiers"]) for r in ents.collect()][0] == ("painters", "two painters", "two")
    assert [(r.subject, r.relation, r.object) for r in rels.collect()] == [
        ("painters", "repairing", "wall"), ("painters", "under", "bridge"),
    ]


def brute_members(tokens, root):
    """Members of a chunk root depth first, by recursion."""
    kinds = ("det", "nummod", "amod", "compound")
    out = []
    for t in tokens:
        if t["dep"] in kinds and t["head_i"] == root and t["i"] != root:
            out.append(t["i"])
            if t["dep"] == "compound":
                out += brute_members(tokens, t["i"])
    return out


def test_members_of_random_trees(spark):
    """Chains, fans and trees of compounds; several chunk roots above and inside each other."""
    rng = random.Random(8)
    rows, want = [], {}
    for doc in range(120):
        n = rng.randrange(1, 40)
        order = rng.sample(range(n), n)  # heads come earlier in this order, so there is no circle
        tokens = []
        for i in range(n):
            at = order.index(i)
            head = order[rng.randrange(max(0, at - rng.choice([1, 3, 40])), at)] if at else i
            dep = "ROOT" if head == i else rng.choice(["compound"] * 5 + ["det", "amod", "nummod", "prep", "conj"])
            tokens.append({"i": i, "text": f"t{i}", "lemma": f"l{i}", "pos": "NOUN", "dep": dep, "head_i": head, "ws": True})
        roots = rng.sample(range(n), rng.randrange(1, n + 1))
        chunks = [{"chunk_id": c, "start": r, "end": r + 1, "root_i": r, "text": f"t{r}", "lemma": f"l{r}"} for c, r in enumerate(sorted(roots))]
        rows.append((doc, tokens, chunks))
        for c, r in enumerate(sorted(roots)):
            members = brute_members(tokens, r)
            names = [f"t{i}" for i in members if tokens[i]["dep"] == "compound"]
            conjuncts = lambda i: [t["text"] for t in tokens if t["dep"] == "conj" and t["head_i"] == i and t["i"] != i] if tokens[i]["dep"] == "amod" else []  # noqa: B023,E731
            want[doc, c] = (" ".join([*names[::-1], f"t{r}"]), [x for i in members if tokens[i]["dep"] != "compound" for x in [f"t{i}", *conjuncts(i)]])
    df = spark.createDataFrame(rows, f"doc int, tokens {scenegraph.TOKENS}, chunks {scenegraph.CHUNKS}")
    got = scenegraph.entity_table(scenegraph.extract_scene_graph(df, want=("entities",)), "doc").collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["head"], [m["span"] for m in r["modifiers"]]) == want[r["doc"], r["entity_id"]]


def test_a_chain_of_many_compounds(spark, tmp_path):
    """20,000 compounds, each hanging on the next: time grows as the text, not as its square."""
    def seconds(n):
        tokens = F.transform(
            F.sequence(F.lit(0), F.lit(n)),
            lambda i: F.struct(
                i.alias("i"), F.lit("t").alias("text"), i.cast("string").alias("lemma"), F.lit("NOUN").alias("pos"),
                F.when(i < n, "compound").otherwise("ROOT").alias("dep"), F.least(i + 1, F.lit(n)).alias("head_i"), F.lit(True).alias("ws"),
            ),
        )
        chunk = F.struct(F.lit(0).alias("chunk_id"), F.lit(0).alias("start"), F.lit(n + 1).alias("end"), F.lit(n).alias("root_i"), F.lit("c").alias("text"), F.lit("c").alias("lemma"))
        spark.range(1).select(tokens.alias("tokens"), F.array(chunk).alias("chunks")).write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        begin = time.perf_counter()
        (row,) = scenegraph.extract_scene_graph(df, want=("entities",)).select(F.col("entities")[0]["lemma_head"].alias("h")).collect()
        assert row["h"] == " ".join(map(str, range(n + 1)))  # the nearest compound stands last
        return time.perf_counter() - begin

    seconds(500)
    small, large = seconds(5_000), seconds(20_000)
    assert large < 60 and large < 8 * small + 5


def test_many_compounds_that_are_roots(spark):
    """A text of 30,000 words; work that grows with its square would take minutes."""
    def token(i):
        kind, head = F.when(i % 3 == 2, "ROOT").otherwise("compound"), F.when(i % 3 == 2, i).otherwise(i + 1)
        word = F.concat(F.lit("w"), i % 3)
        named = [("i", i), ("text", word), ("lemma", word), ("pos", F.lit("NOUN")), ("dep", kind), ("head_i", head), ("ws", F.lit(True))]
        return F.struct(*[c.alias(n) for n, c in named])

    def chunk(i):
        named = [("chunk_id", i), ("start", i), ("end", i + 1), ("root_i", i), ("text", F.lit("w")), ("lemma", F.lit("w"))]
        return F.struct(*[c.alias(n) for n, c in named])

    places = F.sequence(F.lit(0), F.lit(29_999))
    df = spark.range(1).select("id", F.transform(places, token).alias("tokens"), F.transform(places, chunk).alias("chunks"))
    begun = time.monotonic()
    heads = scenegraph.entity_table(extract_scene_graph(df, want=("entities",)), "id").groupBy("head").count().collect()
    assert dict(map(tuple, heads)) == {"w0": 10_000, "w0 w1": 10_000, "w0 w1 w2": 10_000}
    assert time.monotonic() - begun < 60


def test_short_chains_need_no_ranks(spark, monkeypatch):
    """What hangs on compounds is put in behind them; ranks by doubling are for chains of more than three."""
    words = "red/ADJ/amod/1 a/NOUN/compound/2 b/NOUN/compound/4 two/NUM/nummod/2 c/NOUN/ROOT/4 d/NOUN/compound/4"
    case = {"short": (words, [(0, 6, 4), (1, 3, 2)], None)}
    want = [("d a b c", ["red", "two"]), ("a b", ["red", "two"])]
    for ranked in (scenegraph._ranked_members, lambda tokens, chunks, relevant: F.transform(F.slice(relevant, 1, 0), lambda t: scenegraph._member(t["i"], t["i"], t))):
        monkeypatch.setattr(scenegraph, "_ranked_members", ranked)
        (row,) = graphs(spark, case, want=("entities",)).collect()
        assert [(e.head, [m.span for m in e.modifiers]) for e in row.entities] == want


@pytest.mark.parametrize("chain", [2, 3, 4, 5, 6])
def test_chains_around_the_limit(spark, chain):
    """A chain of compounds with an adjective on each."""
    words = " ".join(f"j{n}/ADJ/amod/{2 * n + 1} c{n}/NOUN/compound/{2 * n + 3}" for n in range(chain)) + f" z/ADJ/amod/{2 * chain + 1} r/NOUN/ROOT/{2 * chain + 1}"
    (row,) = graphs(spark, {"chain": (words, [(0, 2 * chain + 2, 2 * chain + 1)], None)}, want=("entities",)).collect()
    (entity,) = row.entities
    tokens = document("chain", words, [])[1]
    members = brute_members([{"dep": t[4], "head_i": t[5], "i": t[0]} for t in tokens], 2 * chain + 1)
    names = [f"c{(i - 1) // 2}" for i in members if i % 2]
    assert entity.head == " ".join([*names[::-1], "r"])
    assert [m.span for m in entity.modifiers] == [tokens[i][1] for i in members if i % 2 == 0]
