"""Token documents made from plain text by rule, for tables that come without a parse.

These are fixtures that let the extraction run over whole tables, not parsers: real parses
come from ``annotate``. Both work inside the row, linear in the number of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.arrays import computed, indices
from plumbline.operators.scenegraph import CHUNKS, TOKENS
from plumbline.session import ship_package

# The word classes of the shallow rule; every other word is a noun-like N.
DETERMINERS = ["a", "an", "the"]
PREPOSITIONS = ["in", "on", "of", "by", "with", "at", "from", "for", "to"]

# Labels the hashed parse draws from, by residue.
HASHED_DEPS = [
    "pobj", "pobj", "pobj", "pobj", "agent", "nsubj", "nsubj", "acl", "dobj", "attr",
    "nsubjpass", "amod", "amod", "advmod", "det", "nummod", "compound", "compound", "conj", "conj",
]
HASHED_POS = ["NOUN", "NOUN", "VERB", "VERB", "AUX", "ADP"]
WINDOW = 12

# Words that are parsed at a time, and a text.
WORDS_AT_A_TIME = 50_000

_TOKEN_NAMES = ["i", "text", "lemma", "pos", "dep", "head_i", "ws"]
_CHUNK_NAMES = ["chunk_id", "start", "end", "root_i", "text", "lemma"]


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters (of any script) and the marks on them."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.array_remove(F.split(spaced, " "), "")


def shallow_tokens(df: DataFrame, text: str) -> DataFrame:
    """Add ``tokens`` and ``chunks``; the text is dropped.

    A run of N words is a chunk: its last word the root, the others adjectives of it, an article
    just before its determiner. A preposition directly between two chunks hangs on the first
    root and governs the second.
    """
    w, codes, governing, runs = (F.col(n) for n in ("_w", "_codes", "_governing", "_runs"))

    # function words are short; the lists need not be searched for longer words
    longest = max(map(len, DETERMINERS + PREPOSITIONS))

    def code(x: Column, i: Column) -> Column:
        """Twice a function word's position, plus one for a preposition."""
        found = F.when(x.isin(DETERMINERS), i * 2).when(x.isin(PREPOSITIONS), i * 2 + 1)
        return F.when(F.octet_length(x) <= longest, found)

    def place(code_: Column) -> Column:
        return F.shiftright(code_, 1)

    def is_p(code_: Column) -> Column:
        return code_.bitwiseAND(F.lit(1)) == 1

    def behind_n(x: Column, j: Column) -> Column:
        return F.coalesce(is_p(x) & (place(F.get(codes, j - 1)) < place(x) - 1), F.lit(False))

    def run(x: Column, j: Column) -> Column:
        """A function word and the N words up to the next one."""
        at, following, after = place(x), F.get(codes, j + 1), F.get(codes, j + 2)
        n, end = place(following) - at - 1, place(following) - 1
        chunk_follows = (n > 0) | (~is_p(following) & F.coalesce(place(after) > place(following) + 1, F.lit(False)))
        governs = F.get(governing, j) & chunk_follows
        start = F.when(is_p(x), at + 1).otherwise(at)
        governed = F.when(is_p(x), F.get(governing, j)).otherwise(
            F.coalesce(F.get(governing, j - 1) & (place(F.get(codes, j - 1)) == at - 1), F.lit(False))
        )
        return F.struct(
            n.alias("n"), start.alias("start"), end.alias("end"),
            F.when(is_p(x), "ADP").otherwise("DET").alias("pos"),
            F.when(is_p(x), F.when(governs, "prep").otherwise("ROOT")).when(n > 0, "det").otherwise("ROOT").alias("dep"),
            F.when(is_p(x), F.when(governs, at - 1).otherwise(at)).when(n > 0, end).otherwise(at).alias("head"),
            F.when(governed, start - 1).alias("governor"),
            F.when(n > 0, F.array_join(F.slice(w, start + 1, end + 1 - start), " ")).alias("span"),
        )

    def by_word(first: Callable[[Column], Column], others: Callable[[Column], Column], root: Callable[[Column], Column]) -> Column:
        """A value for each word: for a function word, for the N words behind it but the last, and for the last."""

        def laid_out(r: Column) -> Column:
            return F.concat(F.array(first(r)), F.array_repeat(others(r), r["n"] - 1), F.array_repeat(root(r), F.least(r["n"], F.lit(1))))

        return F.slice(F.flatten(F.transform(runs, laid_out)), F.lit(2), F.size(w))

    def chunk(r: Column, k: Column) -> Column:
        return F.struct(
            k.alias("chunk_id"), r["start"].alias("start"), (r["end"] + 1).alias("end"), r["end"].alias("root_i"),
            r["span"].alias("text"), r["span"].alias("lemma"),
        )

    steps = computed(df, {"_w": words(text)}).drop(text)
    found = F.filter(F.transform(w, code), lambda x: x.isNotNull())
    # as if a preposition stood before the first word and an article behind the last one
    steps = computed(steps, {"_codes": F.concat(F.array(F.lit(-1)), found, F.array(F.size(w) * 2))})
    steps = computed(steps, {"_governing": F.transform(codes, behind_n)})
    steps = computed(steps, {"_runs": F.transform(F.slice(codes, F.lit(1), F.size(codes) - 1), run)})
    parts = {
        "i": indices(w), "text": w, "lemma": w,
        "pos": by_word(lambda r: r["pos"], lambda r: F.lit("ADJ"), lambda r: F.lit("NOUN")),
        "dep": by_word(lambda r: r["dep"], lambda r: F.lit("amod"), lambda r: F.when(r["governor"].isNull(), "ROOT").otherwise("pobj")),
        "head_i": by_word(lambda r: r["head"], lambda r: r["end"], lambda r: F.coalesce(r["governor"], r["end"])),
        "ws": F.array_repeat(F.lit(True), F.size(w)),
    }
    chunks = F.coalesce(F.transform(F.filter(runs, lambda r: r["n"] > 0), chunk), F.array().cast(CHUNKS))
    steps = computed(steps, {"_parts": F.struct(*[c.alias(name) for name, c in parts.items()]), "chunks": chunks})
    # no lambda for each word: the parts are zipped
    tokens = F.arrays_zip(*[F.col(f"_parts.{name}") for name in parts])
    return steps.withColumn("tokens", tokens).drop("_w", "_codes", "_governing", "_runs", "_parts")


def hashed_tokens(df: DataFrame, text: str, key: str) -> DataFrame:
    """Add ``tokens`` and ``chunks`` of a made-up parse in which every rule occurs; the text is dropped.

    Tags, labels and heads are drawn by a hash of word and place. Every stretch of WINDOW words
    is one tree around its centre word: words before it hang on a later word, words behind it
    on an earlier one. The words of many texts are parsed at a time, in numpy.
    """
    ship_package(df.sparkSession)
    rows = df.withColumn("_w", words(text)).withColumn("_key", F.col(key).cast("long")).drop(text)
    kept = [f for f in rows.schema if f.name not in ("_w", "_key")]
    schema = StructType([*kept, *StructType.fromDDL(f"tokens {TOKENS}, chunks {CHUNKS}")])
    return rows.mapInArrow(hashed_batches, schema)


def hashed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches with the columns ``_w`` (words) and ``_key`` -> the others, with their parses, few texts at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("_w")), 0).to_numpy()
        turns = np.cumsum(sizes) // WORDS_AT_A_TIME
        edges = [0, *(np.flatnonzero(np.diff(turns)) + 1), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            part = batch.slice(begin, end - begin)
            kept = [n for n in part.schema.names if n not in ("_w", "_key")]
            tokens, chunks = _hashed(part.column("_w"), part.column("_key"))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), tokens, chunks], names=[*kept, "tokens", "chunks"])


def _hashed(texts: pa.ListArray, keys: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    w = texts.flatten()
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    i = np.arange(len(w)) - np.repeat(ends - sizes, sizes)
    size, known = np.repeat(sizes, sizes), np.repeat(pc.is_valid(keys).to_numpy(zero_copy_only=False), sizes)
    key = np.repeat(pc.fill_null(keys, 0).to_numpy().astype(np.int64), sizes)
    letter, length = _first_letters(w), pc.utf8_length(w).to_numpy().astype(np.int64)

    def drawn(by_place: int, by_letter: int, by_length: int, by_key: int, modulus: int) -> np.ndarray:
        return np.fmod(i * by_place + letter * by_letter + length * by_length + key * by_key, modulus)

    dep, pos, chunk = drawn(31, 17, 7, 1, 101), drawn(57, 5, 29, 3, 103), drawn(11, 41, 3, 7, 107)
    base = i - i % WINDOW
    # without a key nothing is drawn: no labels, no chunks, and every word heads itself
    centre = np.where(known, base + np.fmod(key + base, np.minimum(WINDOW, size - base)), i)
    away = np.abs(centre - i)
    step = 1 + np.fmod(pos, np.maximum(away, 1))
    head = i + np.sign(centre - i) * step

    def label(draw: np.ndarray, labels: list[str]) -> pa.Array:
        at = np.fmod(draw, len(labels))
        return pa.array(labels).take(pa.array(at, mask=~known | (at < 0)))

    cut = pc.if_else(pc.ends_with(w, "s"), pc.utf8_slice_codeunits(w, 0, -1), w)
    lemmas = pc.if_else(pc.equal(w, "it"), "-PRON-", cut)
    values = [i.astype(np.int32), w, lemmas, label(pos, HASHED_POS), label(dep, HASHED_DEPS), head.astype(np.int32), np.ones(len(i), bool)]
    tokens = _lists(sizes, pa.StructArray.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in values], _TOKEN_NAMES), texts.is_null())

    is_root = (chunk % 3 == 0) & known
    roots = np.flatnonzero(is_root)
    two = (i[roots] > 0) & ~is_root[roots - 1] & (pos[roots] % 2 == 0)

    def joined(a: pa.Array) -> pa.Array:
        last = a.take(pa.array(roots))
        return pc.if_else(pa.array(two), pc.binary_join_element_wise(a.take(pa.array(np.maximum(roots - 1, 0))), last, " "), last)

    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[roots], minlength=len(sizes))
    number = np.arange(len(roots)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = (number, i[roots] - two, i[roots] + 1, i[roots])
    values = [*(pa.array(x.astype(np.int32)) for x in places), joined(w), joined(lemmas)]
    return tokens, _lists(counts, pa.StructArray.from_arrays(values, _CHUNK_NAMES))


def _lists(sizes: np.ndarray, values: pa.Array, missing: pa.Array | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing)


def _first_letters(w: pa.Array) -> np.ndarray:
    """The first character of each word (none is empty) as a number."""
    at = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w)].astype(np.int64) if len(w) else np.zeros(0, np.int64)
    data = np.concatenate([np.frombuffer(w.buffers()[2] or b"", np.uint8), np.zeros(4, np.uint8)])
    lead, more = data[at].astype(np.int64), [data[at + n].astype(np.int64) & 0x3F for n in (1, 2, 3)]
    two, three = (lead & 0x1F) << 6 | more[0], (lead & 0x0F) << 12 | more[0] << 6 | more[1]
    four = (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    return np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, two, three], four)
