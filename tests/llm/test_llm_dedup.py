"""Operators over many rows, against brute force on small tables."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import linededup, packing, simhash, vectors
from plumbline.llm.common import prepare
from plumbline.llm.components import connected_components
from plumbline.llm.pipeline import COLUMNS, STAGES
from plumbline.llm.queries import QUERIES
from test_llm_nearcopies import jaccard, runs_of


def parts(nodes, links):
    """node -> smallest node of its part."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components -------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "none"])
def test_components(spark, kind):
    prepare(spark)
    rng = random.Random(4)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "hub": [(500, i) for i in range(200)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(7, 7), (8, None), (1, 2), (2, 1)],
        "none": [],
    }[kind]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == parts({n for pair in real for n in pair}, real)


# --- line dedup -------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def brute_lines(rows):
    """rows: (doc_id, text). For each row the text without lines that an earlier one matches."""
    lines = []
    for doc_id, text in {(d, t) for d, t in rows if t}:
        for n, line in enumerate(text.split("\n")):
            words = [w for w in line.encode().lower().split()]
            if len(words) >= 2:
                lines.append(((doc_id is not None, doc_id or 0, text_key(text), n), words, (doc_id, text)))
    lines.sort(key=lambda x: x[0])
    gone = defaultdict(set)
    for k, (at, words, row) in enumerate(lines):
        for _, other, _ in lines[:k]:
            if words == other or (min(len(words), len(other)) >= 5 and abs(len(words) - len(other)) <= 1 and edits(words, other) <= 1):
                gone[row].add(at[3])
                break
    return sorted(
        (str(d), "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d, t]) if t else str(t)) for d, t in rows
    )


def text_key(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_line_dedup_against_brute_force(spark):
    prepare(spark)
    rng = random.Random(8)
    words = "red green blue old new tall small wide".split()

    def line():
        return " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8])))

    pool = [line() for _ in range(40)]

    def edited(x):
        w = x.split()
        k = rng.randrange(len(w))
        return " ".join([w[:k] + w[k + 1 :], w[:k] + ["NEW"] + w[k:], w[:k] + ["odd"] + w[k + 1 :], [x.upper()]][rng.randrange(4)])

    rows = [(i, "\n".join(rng.choice([rng.choice(pool), edited(rng.choice(pool)), line(), ""]) for _ in range(6))) for i in range(80)]
    rows += [(None, None), (81, ""), (82, None), (3, rows[3][1]), (83, rows[4][1]), (None, rows[5][1]), (84, "long line of words " * 5_000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, line_no string, n_equal int")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "line_no", "n_equal", "n_near"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == brute_lines(rows)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_ends_with_one_join(spark):
    """Earlier steps are written: while the texts are shuffled no shuffle of theirs takes disk."""
    rows = [(1, "a b c d e f\nx y z"), (2, "a b c d e g\nx y z"), (3, None)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2, plan
    assert sorted(got.collect(), key=lambda r: r["doc_id"])[1]["text"] == ""


def test_line_dedup_removes_what_it_wrote(spark, monkeypatch):
    """Written steps go once nothing reads them: only near lines and the result are left."""
    prepare(spark)
    written = []
    for name in ("land", "stage"):
        monkeypatch.setattr(linededup, name, lambda df, real=getattr(linededup, name): written.append(real(df)) or written[-1])
    rows = [(1, "a b c d e f\nx y z"), (2, "a b c d e g\nx y z"), (3, None)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_equal"], r["n_near"]) for r in got.collect()} == {1: (0, 0), 2: (1, 1), 3: (0, 0)}
    folders = [(w[0] if isinstance(w, tuple) else w).inputFiles() for w in written]
    there = [any(os.path.exists(f.removeprefix("file://")) for f in files) for files in folders]
    assert len(there) >= 7 and sum(there) <= 2, there


def test_line_keys_of_many_texts():
    """Keys of a line are those of its words, wherever and in whichever batch it stands; deletions have the shorter line's key."""
    texts = ["A b\tc  d e\n\n x", "", "a B c d e", "b c d e\na c d e\na b d e\na b c e\na b c d", "longer\x0bthan_eight_bytes é É\r\n"]
    hasher = linededup.LineHasher()
    per_text, sizes, keys, halves = hasher.lines([t.encode() for t in texts], 5)
    assert per_text.tolist() == [3, 1, 1, 5, 2] and sizes.tolist() == [5, 0, 1, 0, 5, 4, 4, 4, 4, 4, 4, 0]
    assert keys[0] == keys[4] and (halves[0] == halves[4]).all() and len(set(keys.tolist())) == 9 and not halves[1].any()
    sizes, whole, without = linededup.LineHasher().variants([b"a b c d e", b"x"])
    assert sizes.tolist() == [5, 1] and whole.tolist() == keys[[0, 2]].tolist() and without[:5].tolist() == keys[5:10].tolist()


def test_within_one_edit():
    rng = random.Random(9)
    for _ in range(3_000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(1, 6))] for _ in range(2))
        assert linededup.within_one_edit(a, b) == (edits(a, b) <= 1)


def test_many_lines_of_one_template(spark):
    """A third of all lines differ in one word: one key, and only the first of them stays."""
    prepare(spark)
    rows = [(i, f"page number {i} of the great book\nline {i} stands {i * 7} alone {i * 13} here {i * 17} now") for i in range(2_000)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r["doc_id"]: r for r in got.collect()}
    assert sum(r["n_near"] for r in kept.values()) == 1_999 and kept[0]["n_near"] == 0


# --- SimHash ----------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=4):
    p = sorted(prints)
    return [(a, b) for i, a in enumerate(p) for b in p[i + 1 :] if (a ^ b).bit_count() <= radius]


def test_simhash_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    part = parts(set(prints.values()), linked(set(prints.values())))
    least = {}
    for d, p in prints.items():
        least[part[p]] = min(d, least.get(part[p], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", least[part[p]]) for d, p in prints.items()}


def close_prints(n, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set()
    while len(out) < n:
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


@pytest.mark.parametrize("shard_rows", [2, 5, 4096])
def test_links_hold_all_components(spark, shard_rows):
    """Also where shards are cut into pieces that meet each other."""
    prepare(spark)
    prints = close_prints(400, shard_rows)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    got = simhash.fingerprint_links(spark.createDataFrame(signed, "print long"), shard_rows=shard_rows).collect()
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert parts(prints, found) == parts(prints, linked(prints))


def test_tree_finds_all_within_the_radius():
    prints = list(close_prints(300, 77))
    tree = simhash.Tree(4)
    for x in prints:
        tree.add(x)
    for x in prints[:60]:
        assert sorted(tree.near(x)) == sorted(y for y in prints if (x ^ y).bit_count() <= 4)


def test_simhash_odd_rows(spark):
    prepare(spark)
    rows = [(5, None), (4, ""), (9, " \n"), (1, "one two"), (1, "one two"), (2, "ONE  two"), (None, "one two"), (None, "all alone here"), (7, "word " * 50_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, print int")
    got = sorted((str(r["doc_id"]), r["print"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(df).collect())
    want = {0: 4, brute_print("one two"): 1, brute_print("all alone here"): None, brute_print("word " * 50_000): 7}
    assert got == sorted((str(d), brute_print(t), want[brute_print(t)]) for d, t in rows)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.drop_near_copies(df).collect() if r["doc_id"] is not None)
    assert [d for d, _ in kept] == ["1", "4", "7"]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_near_copies_of_a_repeated_id(spark):
    """Id 1 has texts of two groups, and one of them twice: a row of each group stays, whichever text hashes least."""
    prepare(spark)
    a, b = "one two three four five six seven", "red green blue black white brown grey"
    for one, two in ((a, b), (b, a)):
        rows = [(1, one), (1, one), (1, two), (2, one), (3, two), (None, one)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(7))
        got = sorted((str(r["doc_id"]), r["text"], r["n"]) for r in simhash.drop_near_copies(docs).collect())
        assert got == sorted([("1", one, 7), ("1", two, 7), ("None", one, 7)])
    rows = [(1, a), (2, b), (1, b), (3, "x y z u v w"), (0, a)]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([(0, a), (1, b), (3, "x y z u v w")])


# --- vectors ----------------------------------------------------------------------------------


def brute_vectors(rows):
    clean = {}
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            clean[vec_id] = np.array(v, float)
    links = []
    ids = sorted(clean)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(clean[a]) == len(clean[b]):
                x, y = (clean[k] / np.abs(clean[k]).max() for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links.append((a, b))
    part = parts(ids, links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((str(v), count[v], part.get(v, v), v is not None and part.get(v, v) == v) for v in {r[0] for r in rows if r[0] is not None})


@pytest.mark.parametrize("group_rows", [16, 64, 4096])
def test_vectors_against_brute_force(spark, group_rows):
    prepare(spark)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=24) * (0.1 + 0.03 * (i % 11)))]) for i in range(240)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, [2 * x for x in rows[0][1]]), (401, [1e-200 * x for x in rows[1][1]])]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] + [1.0] * 23), (504, [None] + [1.0] * 23), (505, [1.0] * 7), (506, [1.0] * 7)]
    rows += [(507, [float("inf")] * 24), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, kept string")
    got = vectors.near_vectors(df, group_rows=group_rows).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None) == brute_vectors(rows)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, False)]


def test_vectors_query_against_sql(spark, sf_dir):
    from compare import compare, oracle_connection

    from plumbline.llm.queries import ORACLES

    assert set(ORACLES) <= set(QUERIES)
    for name, sql in ORACLES.items():
        same, message = compare(QUERIES[name](spark, sf_dir), oracle_connection(sf_dir), sql)
        assert same, message


def test_vectors_query_and_empty(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op10_pca_tiles"](spark, sf_dir).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == brute_vectors(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(empty).count() == 0


# --- packing ----------------------------------------------------------------------------------


def test_hilbert_curve_is_one_path():
    bits, dims = 3, 3
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    along = points[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbouring cell


def check_packing(pieces, texts):
    """texts: (doc_id, text) rows; every id in one piece, sequences gapless, full or a power of two long."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, rows in by_doc.items():
        got = sorted((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in rows)
        for ids in want[doc_id]:
            at = 0
            while at < len(ids):
                one = next(g for g in got if g[0] == at and g[2] == len(ids) and g[3] == zlib.crc32(np.array(ids[at : at + g[1]], "<u4").tobytes()))
                got.remove(one)
                at += one[1]
            assert at == len(ids)
        assert not got
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)


def test_packing_query(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(QUERIES["op7_hilbert_packing"](spark, sf_dir).collect(), texts)


def test_packing_odd_rows(spark):
    prepare(spark)
    rows = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (4, "same text here"), (None, "no id"), (5, "word " * 20_000), (6, "<|endoftext|> é日😀 \n\n  x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, place string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(packing.pack(df, path, public_tokenizers.PATTERN).collect(), rows)
    assert packing.pack(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_packing_finds_added_tokens(spark):
    """Ids as the tokenizer file gives them, by the library's own settings."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    rows = list(enumerate([f"x {end} y", end, f"{end}{end}  b", f"a\n{end} \n{end[:-1]} {end[1:]}", f"{end} é日😀 \n\n  x", "none"]))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    for doc_id, text in rows:
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == want, text
        assert {r["doc_tokens"] for r in pieces} == {len(want)}
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, step in STAGES:
        out = step(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
        if name != "packing":
            assert tuple(docs.columns) == COLUMNS
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    before, after = seen["toxicity"]
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {d for d, _ in pairs(after)}
    clean = [d for d, _ in pairs(before) if marks.get(d) == 0]
    assert np.mean([d in left for d in clean]) > 0.97

    before, after = seen["line dedup"]
    want = [(d, t) for d, t in brute_lines(pairs(before)) if t.split()]
    assert sorted((str(d), t) for d, t in pairs(after)) == want
    assert after.where("n_chars != length(text)").count() == 0

    before, after = seen["simhash near-dedup"]
    texts, kept = dict(pairs(before)), {d for d, _ in pairs(after)}
    assert kept <= texts.keys() and dict(pairs(after)) == {d: texts[d] for d in kept}
    runs = {d: runs_of(t) for d, t in texts.items()}
    ids = sorted(texts)
    alike = {(a, b): jaccard(runs[a], runs[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    close = [p for p, j in alike.items() if j >= 0.8]
    assert sum(a in kept and b in kept for a, b in close) <= 0.1 * len(close)
    for d in texts.keys() - kept:
        assert any(jaccard(runs[d], runs[o]) >= 0.6 for o in ids if o != d)

    before, after = seen["secret scan"]
    from plumbline.llm.secrets import redact

    assert sorted(pairs(after)) == sorted((d, redact(t)) for d, t in pairs(before))
    check_packing(seen["packing"][1].collect(), pairs(seen["packing"][0]))


def test_pipeline_run(spark, sf_dir):
    import corpus_pipeline

    assert corpus_pipeline.STAGES is STAGES
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.agg(F.sum("length")).first()[0] > 0
