import random

from pyspark.sql import functions as F

from plumbline.operators.scenegraph import entity_view, extract_scene_graph
from plumbline.plans import tokens as parses
from plumbline.plans.tokens import DETERMINERS, HASHED_DEPS, HASHED_POS, PREPOSITIONS, WINDOW, hashed_tokens, shallow_tokens

WORDS = [*DETERMINERS, "of", "in", "dog", "cat", "Été", "thee"]


def parsed_by_hand(text):
    """The rule of ``shallow_tokens``, word by word."""
    words = text.lower().split()
    kinds = ["D" if w in DETERMINERS else "P" if w in PREPOSITIONS else "N" for w in words]
    kind = lambda i: kinds[i] if 0 <= i < len(kinds) else ""
    governs = lambda i: kind(i) == "P" and kind(i - 1) == "N" and (kind(i + 1) == "N" or kind(i + 1) + kind(i + 2) == "DN")

    def end_of(i):
        while kind(i + 1) == "N":
            i += 1
        return i

    def start_of(i):
        while kind(i - 1) == "N":
            i -= 1
        return i - (kind(i - 1) == "D")

    tokens, chunks = [], []
    for i, w in enumerate(words):
        if kind(i) == "N" and end_of(i) != i:
            label = ("ADJ", "amod", end_of(i))
        elif kind(i) == "N":
            start = start_of(i)
            chunks.append((len(chunks), start, i + 1, i, " ".join(words[start : i + 1])))
            label = ("NOUN", "pobj", start - 1) if governs(start - 1) else ("NOUN", "ROOT", i)
        elif kind(i) == "D":
            label = ("DET", "det", end_of(i + 1)) if kind(i + 1) == "N" else ("DET", "ROOT", i)
        else:
            label = ("ADP", "prep", i - 1) if governs(i) else ("ADP", "ROOT", i)
        tokens.append((i, w, w, *label, True))
    return tokens, chunks


def test_shallow_tokens_of_random_texts(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(WORDS, k=rng.randrange(20))) for i in range(500)} | {-1: "", -2: "of", -3: "the", -4: "dog"}
    rows = shallow_tokens(spark.createDataFrame(list(texts.items()), "id int, text string"), "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens, chunks = parsed_by_hand(texts[r.id])
        assert [tuple(t) for t in r.tokens] == tokens
        assert [tuple(c) for c in r.chunks] == [(*c, c[-1]) for c in chunks]


def test_null_text(spark):
    (row,) = shallow_tokens(spark.createDataFrame([(1, None)], "id int, text string"), "text").collect()
    assert row.tokens is None and row.chunks == []


def test_words_get_no_lambda(spark):
    """Columns with a value for each word are laid out by run and zipped, not built by a lambda for each word."""
    df = shallow_tokens(spark.createDataFrame([(1, "a dog")], "id int, text string"), "text")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in plan and plan.count("transform(_w") == 1


def test_modifiers_are_lowered_as_each_would_be(spark):
    tokens = [(0, "ΟΔΟΣ", "x", "ADJ", "amod", 2, True), (1, "ΣΑΣ", "y", "ADJ", "amod", 2, True), (2, "Dog", "dog", "NOUN", "ROOT", 2, True)]
    chunks = [(0, 0, 3, 2, "ΟΔΟΣ ΣΑΣ Dog", "x y dog")]
    from plumbline.operators.scenegraph import CHUNKS, TOKENS

    df = spark.createDataFrame([("d", tokens, chunks)], f"doc_id string, tokens {TOKENS}, chunks {CHUNKS}")
    graph = extract_scene_graph(df)
    (row,) = entity_view(graph, "doc_id").collect()
    (want,) = graph.select(F.transform(F.col("entities")[0]["modifiers"], lambda m: F.lower(m["span"]))).collect()
    assert row.modifiers == ",".join(want[0])


def hashed_by_hand(text, key):
    """The rule of ``hashed_tokens``, word by word, for keys that aren't negative."""
    w = text.lower().split()
    lemma = ["-PRON-" if x == "it" else x[:-1] if x.endswith("s") else x for x in w]
    draw = lambda i, a, b, c, d, m: (i * a + ord(w[i][0]) * b + len(w[i]) * c + key * d) % m
    pos, is_root, tokens, chunks = [draw(i, 57, 5, 29, 3, 103) for i in range(len(w))], [draw(i, 11, 41, 3, 7, 107) % 3 == 0 for i in range(len(w))], [], []
    for i, x in enumerate(w):
        base = i - i % WINDOW
        middle = base + (key + base) % min(WINDOW, len(w) - base)
        head = i + 1 + pos[i] % (middle - i) if i < middle else i - 1 - pos[i] % (i - middle) if i > middle else i
        tokens.append((i, x, lemma[i], HASHED_POS[pos[i] % 6], HASHED_DEPS[draw(i, 31, 17, 7, 1, 101) % 20], head, True))
        if is_root[i]:
            start = i - (i > 0 and not is_root[i - 1] and pos[i] % 2 == 0)
            chunks.append((len(chunks), start, i + 1, i, " ".join(w[start : i + 1]), " ".join(lemma[start : i + 1])))
    return tokens, chunks


def test_hashed_tokens_of_random_texts(spark, monkeypatch):
    """Many texts at a time, other columns kept; no lambda for each word."""
    rng = random.Random(6)
    some = ["it", "s", "dogs", "été", "ß", "Ω", "日本語", "𝔘x", "the", "in", "mass"]
    rows = [(n, " ".join(rng.choices(some, k=rng.randrange(70))), [n]) for n in range(400)] + [(5, None, None), (5, "", [1]), (5, "x", None)]
    df = hashed_tokens(spark.createDataFrame(rows, "id long, text string, more array<int>").repartition(3), "text", "id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.columns == ["id", "more", "tokens", "chunks"] and "MapInArrow" in plan and "transform(" not in plan
    got = sorted(((r.id, r.more, r.tokens and [tuple(t) for t in r.tokens], [tuple(c) for c in r.chunks]) for r in df.collect()), key=str)
    want = sorted(((n, more, *((None, []) if text is None else hashed_by_hand(text, n))) for n, text, more in rows), key=str)
    assert [(a, b, c or c, d) for a, b, c, d in got] == want


def test_hashed_tokens_without_a_key(spark):
    """No key, nothing is drawn; every word heads itself."""
    (row,) = hashed_tokens(spark.createDataFrame([(None, "a dog")], "id long, text string"), "text", "id").collect()
    assert [(t.i, t.text, t.pos, t.dep, t.head_i) for t in row.tokens] == [(0, "a", None, None, 0), (1, "dog", None, None, 1)] and row.chunks == []


def test_texts_are_parsed_few_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(parses, "WORDS_AT_A_TIME", 50)
    texts = [["a"] * 20] * 10 + [None] + [["b"] * 200] + [["c"]] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(17)), pa.array(range(17))], names=["_w", "_key", "id"])
    got = list(parses.hashed_batches(iter([batch])))
    assert [n for b in got for n in b.column("id").to_pylist()] == list(range(17))
    assert len(got) > 4 and all(sum(len(x or []) for x in b.column("tokens").to_pylist()) <= 250 for b in got)
    assert [len(x) if x is not None else None for b in got for x in b.column("tokens").to_pylist()] == [20] * 10 + [None] + [200] + [1] * 5
