"""Queries of the operators over whole driver tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import bpe, language, linededup, packing, pages, phrases, quality, rules, secrets, simhash, toxicity, vectors, whitening
from plumbline.llm.common import held_out, read

TOXIC_FOLDS = (5, 0)
QUALITY_FOLDS = (3, 1)


def op1_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    listed = ids.select(
        F.struct(
            "doc_id",
            F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        ).alias("doc_id"),
        "ids",
    )
    return bpe.decode(listed, path, strict=True).select(
        "doc_id.*", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op2_line_dedup(spark, sf_dir):
    kept = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "n_equal", "n_near")


def op3_toxicity(spark, sf_dir):
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, "toxic", *TOXIC_FOLDS)
    scored = docs.select("doc_id", held_out("doc_id", *TOXIC_FOLDS).alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_compression_quality(spark, sf_dir):
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    model = quality.train(docs, labels, "quality", *QUALITY_FOLDS)
    scored = docs.select("doc_id", held_out("doc_id", *QUALITY_FOLDS).alias("held_out"), quality.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_divergence_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", rules.measures("text", rules.references(docs)).alias("found"))
    failed, kept = rules.verdict(F.col("found"))
    shown = [F.col(f"found.{c}").alias(c) for c in (*rules.COUNTS, "class_distance", "word_distance")]
    return found.select("doc_id", *shown, failed.alias("base_failed"), kept.alias("kept"))


def op6_language_fusion(spark, sf_dir):
    return language.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op7_hilbert_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("ids")


def _spans_text(spans):
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def op8_secret_scan(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(_spans_text(base).cast("binary"), 256).alias("base_sha256"),
        _spans_text(F.col("found")).alias("spans"),
    )


def op9_simhash(spark, sf_dir):
    found = simhash.simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("print").alias("fingerprint"), "component_id")


def op10_pca_tiles(spark, sf_dir):
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_whitening(spark, sf_dir):
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_main_text(spark, sf_dir):
    return pages.extract(read(spark, sf_dir, "pages"))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (op1_byte_bpe, op2_line_dedup, op3_toxicity, op4_compression_quality, op5_divergence_rules, op6_language_fusion, op7_hilbert_packing, op8_secret_scan, op9_simhash, op10_pca_tiles, op11_whitening, op12_main_text, op13_phrases)
}

# Counterparts in SQL, where SQL can express an operator over its whole table. The others rest on hashes,
# tokenizers, trained models or code point spans that the SQL engine lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op10_pca_tiles": """
WITH RECURSIVE
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reach(a, b) AS (SELECT vec_id, vec_id FROM ok UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(coalesce(c, vec_id) = vec_id, false) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op13_phrases": r"""
WITH
piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
run AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 100 OR k = 1),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
part AS (
  SELECT lang, a, k, unnest(list_distinct(flatten(list_transform(range(2, k), lambda s: list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' ')))))) AS phrase FROM c WHERE k > 2
),
longer AS (SELECT lang, phrase, max(a) AS m FROM part GROUP BY ALL),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM c LEFT JOIN longer USING (lang, phrase), range(1, 5) t(j) WHERE j < k AND NOT coalesce(100 * m >= 100 * c.a, false)
),
scored AS (
  SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail JOIN n ON n.lang = cut.lang
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM worst QUALIFY rank <= 2000""",
}
