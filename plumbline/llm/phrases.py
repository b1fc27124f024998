r"""Phrase collocations by SON partitioning.

A text's ASCII capitals are lowered, it is split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words
``[^\x20\x09]+``; a phrase is a run of words within a piece. Counts are per language. A phrase is frequent
with ``support`` occurrences or more. A shard is what a task holds at a time, some ``SHARD_BYTES`` of
text, held as codes of its words, and is mined completely, level by level, at the support times its share of the language's words, rounded up.
A phrase below that in every shard is below the support in all, so the union of what shards find
misses none. The union is cut to phrases that can still reach the support if every shard that did not report
them holds just too few. Then all are counted exactly over all shards: what a shard has reported is known, so
it adds its counts below its local support. That needs the same shards in all rounds, which is compared by
their contents; were they not the same, everything would be counted anew.

Rounds: words; phrases of two; longer ones; counts. What an earlier round found frequent restricts a later
one through a Bloom filter of fixed size (``FILTER_BITS``) on hashes of phrases. A filter lets everything through that
it should, and the same phrases in every shard, so counts are exact however full it is; only work grows.
Where shards are so many that their support is one, the union is the count and the filters alone prune.

Defined results: null and empty texts have no words; a null language is ``und``. Repeated rows count as often as
they occur. An empty table gives no rows. Other columns are not read. Ties of rank end with the phrase, which is unique in
its language. A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import land, prepare, remove, stage

SUPPORT = 100
LONGEST = 5
UNKNOWN = "und"
SHARD_BYTES = 120 << 20
FILTER_BITS = 26
# Parts a language's candidates are ranked in before its best of all parts are.
RANK_PARTS = 256
_EMIT_ROWS = 50_000
# What a shard is coded by, and how many places of phrases are counted at once: temporary arrays stay this small.
_CHUNK_BYTES = 4 << 20
_COUNTED = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK

_ROWS = "lang string, words int, phrase string, h bigint, n bigint, slack bigint"


# --- a shard -----------------------------------------------------------------------------------


class _Coded:
    """Texts of a language as they come, of which only codes of words are held."""

    def __init__(self, lang: str):
        self.lang, self.size, self.held, self.waiting = lang, 0, [], 0
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.content = xxhash.xxh64(seed=self.seed)
        self.words: list[pa.DictionaryArray] = []
        self.joined: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        self.held.append(text)
        self.size += len(text) + 1
        self.waiting += len(text) + 1
        if self.waiting >= _CHUNK_BYTES:
            self.code()

    def code(self) -> None:
        raw = np.frombuffer(b"\n".join([*self.held, b""]), np.uint8)  # the line break keeps texts apart
        self.held, self.waiting = [], 0
        self.content.update(raw)
        kind = _KIND[raw]
        word = kind == _WORD
        edges = np.diff(word.view(np.int8), prepend=0, append=0)
        starts = np.flatnonzero(edges == 1)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.flatnonzero(edges == -1) - starts, out=offsets[1:])
        letters = _LOWER[raw[word]]
        listed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        self.words.append(listed.dictionary_encode())
        piece = np.searchsorted(np.flatnonzero(kind == _BREAK), starts)
        self.joined.append(np.append(piece[1:] == piece[:-1], False)[: len(starts)])


class Shard:
    """The words of some texts of one language: codes in reading order, and which stand in one piece with the next."""

    def __init__(self, texts: list[bytes] | _Coded, lang: str):
        coded = texts
        if not isinstance(coded, _Coded):
            coded = _Coded(lang)
            for text in texts:
                coded.add(text)
        coded.code()
        words, coded.words = pa.chunked_array(coded.words).unify_dictionaries(), []
        self.codes = np.concatenate([c.indices.to_numpy() for c in words.chunks])
        self.joined, coded.joined = np.concatenate(coded.joined)[:-1], []
        forms = words.chunk(0).dictionary
        self.forms = forms.cast(pa.binary()).cast(pa.string())
        self.lang = lang
        self.content = np.array([coded.content.intdigest()], dtype=np.uint64)
        self.hashes = np.empty(len(forms), np.uint64)
        for i in range(0, len(forms), _EMIT_ROWS):
            some = forms.slice(i, _EMIT_ROWS).to_pylist()
            self.hashes[i : i + len(some)] = [xxhash.xxh64_intdigest(w, coded.seed) for w in some]

    def counts(self) -> np.ndarray:
        """Occurrences of each word."""
        counts = np.zeros(len(self.forms), np.int64)
        for i in range(0, len(self.codes), _COUNTED):
            some = np.bincount(self.codes[i : i + _COUNTED])
            counts[: len(some)] += some
        return counts

    def hash_at(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words that begin at the given words."""
        h = self.hashes[self.codes[at]]
        for i in range(1, size):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.codes[at + i]]
        return h ^ (h >> np.uint64(29)) if size > 1 else h

    def phrases_at(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.forms.take(pa.array(self.codes[at + i])) for i in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")

    def facts(self, least: int) -> Iterator[pa.RecordBatch]:
        """A row without a phrase: the shard's content, and by how much a phrase it doesn't report may occur."""
        yield from _rows(self.lang, 0, pa.array([""]), self.content, np.ones(1, np.int64), least - 1)

    def word_rows(self) -> Iterator[pa.RecordBatch]:
        counts = self.counts()
        yield from _rows(self.lang, 1, self.forms, self.hashes, counts, 0)

    def mine(self, least: int, longest: int, wanted: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, counts) of phrases of 2 words and more that occur ``least`` times or more here.

        ``wanted``: filters by size that a phrase must pass; sizes without one are not filtered. A phrase
        is only looked at if both its parts that lack one word were found on the level before. Phrases are
        counted by their first part, some ``_COUNTED`` at a time, so a size may come several times.
        """
        counts = self.counts()
        fine = counts >= least
        if 1 in wanted:
            fine &= passes(wanted[1], self.hashes)
        ids = np.where(fine[self.codes], self.codes, np.int32(-1))
        kinds = len(counts)
        for size in range(2, longest + 1):
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            if size == 2:
                both &= self.joined
            found = int(both.sum())
            if not found:
                return
            turns = min(1 + found // _COUNTED, 255)
            turn = np.full(len(both), 255, np.uint8)
            for i in range(0, len(both), _COUNTED):
                np.copyto(turn[i : i + _COUNTED], ids[i : i + _COUNTED][: len(both) - i] % turns, casting="unsafe", where=both[i : i + _COUNTED])
            following, kept = np.full(len(both), -1, np.int32), 0
            del both
            for i in range(turns):
                at = np.flatnonzero(turn == i)
                if not len(at):
                    continue
                coded = pa.array(ids[at].astype(np.int64) * kinds + ids[at + 1]).dictionary_encode()
                inverse = coded.indices.to_numpy()
                counts = np.bincount(inverse)
                places = np.empty(len(counts), np.int64)
                places[inverse] = at
                fine = counts >= least
                if size in wanted:
                    fine &= passes(wanted[size], self.hash_at(places, size))
                yield size, places[fine], counts[fine]
                following[at] = np.where(fine, np.cumsum(fine) - 1 + kept, -1)[inverse]
                kept += int(fine.sum())
            ids, kinds = following, kept


def _rows(lang, size, phrases, hashes, counts, slack) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(counts), _EMIT_ROWS):
        n = len(counts[i : i + _EMIT_ROWS])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))),
                pa.array(np.full(n, size), pa.int32()),
                phrases.slice(i, n),
                pa.array(hashes[i : i + n].view(np.int64)),
                pa.array(counts[i : i + n], pa.int64()),
                pa.array(np.full(n, slack), pa.int64()),
            ],
            names=["lang", "words", "phrase", "h", "n", "slack"],
        )


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    mask, low = np.uint64(len(bits) * 64 - 1), np.uint64(63)

    def hit(at):
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & low)) & np.uint64(1) != 0

    return hit(hashes & mask) & hit((hashes >> np.uint64(32)) & mask)


def _shards(batches, most: int) -> Iterator[Shard]:
    """The shards of a task's texts: when these pass ``most`` bytes, the language that holds most of them is one."""
    held: dict[str, _Coded] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            while held and sum(c.size for c in held.values()) + len(data) > most:
                largest = max(held, key=lambda name: held[name].size)
                yield Shard(held.pop(largest), largest)
            if lang not in held:
                held[lang] = _Coded(lang)
            held[lang].add(data)
    while held:
        yield Shard(*held.popitem()[::-1])


# --- rounds over all shards ----------------------------------------------------------------------


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the hashes in ``h``. At most 2^(bits - 6) numbers reach the driver."""
    mask = F.lit((1 << bits) - 1)
    places = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    at = found.select(F.explode(places).alias("p")).select(
        F.shiftright("p", 6).alias("at"), F.expr("shiftleft(1L, CAST(p & 63 AS int))").alias("bit")
    )
    set_bits = at.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[set_bits.column("at").to_numpy()] = set_bits.column("bit").to_numpy().view(np.uint64)
    return table


def by_language(texts: DataFrame, shard_bytes: int) -> tuple[DataFrame, str]:
    """(lang, text) written anew, a language's texts side by side, and the path.

    A shard then holds one language, and as much of it as it may: the fewer shards, the higher is the support they mine
    at and the fewer report the same phrase. Texts of a language are dealt at random. Files are smaller than shards, as
    the rest of a larger one would be a small shard, which reports much.
    """
    total = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = 1 + int(total) // max(shard_bytes - shard_bytes // 4, 1)
    return stage(texts.repartitionByRange(parts, "lang", F.rand(1)))


def _share(support: int, here: int, everywhere: int) -> int:
    """The support times a shard's share of the words, rounded up."""
    return -(-support * here // everywhere)


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST,
    shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of 1 to ``longest`` words with ``support`` or more occurrences,
    and (lang, n) with the word occurrences of each language.
    """
    spark = prepare(docs.sparkSession)
    context = spark.sparkContext
    texts = docs.where(F.length(text_col) > 0).select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    texts, texts_path = by_language(texts, shard_bytes)

    def count_words(batches):
        for shard in _shards(batches, shard_bytes):
            yield from shard.word_rows()

    words = land(texts.mapInArrow(count_words, _ROWS).groupBy("lang", "words", "phrase", "h").agg(F.sum("n").alias("n")))
    totals = land(words.groupBy("lang").agg(F.sum("n").alias("n")))
    # a language is a row here; those with fewer words than the support can't hold a frequent phrase
    sizes = {r["lang"]: r["n"] for r in totals.where(F.col("n") >= support).collect()}
    frequent_words = words.where(F.col("n") >= support)
    filters = {1: _filter(frequent_words, filter_bits)}

    def over_shards(task) -> DataFrame:
        """Sums over shards of what ``task(shard, least, filters)`` puts out, written."""
        shared = context.broadcast((sizes, dict(filters)))  # a filter's size is fixed

        def run(batches):
            everywhere, wanted = shared.value
            for shard in _shards(batches, shard_bytes):
                if shard.lang in everywhere and len(shard.codes):
                    least = _share(support, len(shard.codes), everywhere[shard.lang])
                    yield from shard.facts(least)
                    yield from task(shard, least, wanted)

        sums = F.sum("n").alias("n"), F.sum("slack").alias("slack")
        return land(texts.mapInArrow(run, _ROWS).groupBy("lang", "words", "phrase", "h").agg(*sums))

    def mined(first: int, last: int) -> DataFrame:
        def task(shard, least, wanted):
            for size, at, counts in shard.mine(least, last, wanted):
                if size >= first:
                    yield from _rows(shard.lang, size, shard.phrases_at(at, size), shard.hash_at(at, size), counts, least - 1)

        return over_shards(task)

    def candidates(found: DataFrame) -> DataFrame:
        """Phrases that some shard found and that may reach the support."""
        unseen = found.where(F.col("words") == 0).groupBy("lang").agg(F.sum("slack").alias("all_slack"))
        # shards that did not report a phrase hold at most their slack of it
        may_reach = F.col("n") + F.col("all_slack") - F.col("slack") >= support
        return found.where(F.col("words") > 0).join(unseen, "lang").where(may_reach).select("lang", "words", "phrase", "h", "n")

    rounds = [mined(2, 2)]
    reported = candidates(rounds[0])
    filters[2] = _filter(reported, filter_bits)
    if longest > 2:
        rounds.append(mined(3, longest))
        longer = land(candidates(rounds[1]))
        for size in range(3, longest + 1):
            filters[size] = _filter(longer.where(F.col("words") == size), filter_bits)
        reported = reported.unionByName(longer)

    def count(all_counts: bool) -> DataFrame:
        def task(shard, least, wanted):
            for size, at, counts in shard.mine(1, longest, wanted):
                if not all_counts:
                    at, counts = at[counts < least], counts[counts < least]
                yield from _rows(shard.lang, size, shard.phrases_at(at, size), shard.hash_at(at, size), counts, 0)

        return over_shards(task)

    rest = count(all_counts=False)
    if all(_same_shards(found, rest) for found in rounds):
        added = rest.where(F.col("words") > 0).select("lang", "phrase", F.col("n").alias("more"))
        counted = reported.join(added, ["lang", "phrase"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    else:
        counted = count(all_counts=True).where(F.col("words") > 0)
    columns = "lang", "words", "phrase", "n"
    counts = land(frequent_words.select(*columns).unionByName(counted.where(F.col("n") >= support).select(*columns)))
    remove(spark, texts_path)
    return counts, totals


def _same_shards(a: DataFrame, b: DataFrame) -> bool:
    """Whether two rounds had the same shards, by their contents and supports."""
    facts = [found.where(F.col("words") == 0).select("lang", "h", "n", "slack") for found in (a, b)]
    return facts[0].exceptAll(facts[1]).isEmpty() and facts[1].exceptAll(facts[0]).isEmpty()


# --- collocations ----------------------------------------------------------------------------------


def _parts(first: str, last: str) -> str:
    """SQL for the words numbered ``first`` to ``last`` of the phrase in ``w``, joined."""
    return f"array_join(slice(w, {first}, {last} - {first} + 1), ' ')"


def collocations(docs: DataFrame, top: int = 2000, subsumed_percent: int = 100, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` collocations.

    The score of a cut is floor(1000 a n / (l r)), in exact decimals; a phrase's is that of its worst cut,
    ties to the earliest. A phrase goes if a longer frequent phrase contains it and occurs at least
    ``subsumed_percent`` per cent as often. Ranks go by score, occurrences and phrase. ``options`` as in ``phrase_counts``.
    """
    counts, totals = phrase_counts(docs, **options)
    phrases = counts.where(F.col("words") > 1).select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))

    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), size -> "
        f"transform(sequence(1, words - size + 1), at -> {_parts('at', 'at + size - 1')})))"
    )
    within = phrases.where(F.col("words") > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    covered = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    swallowed = F.coalesce(100 * F.col("longer") >= subsumed_percent * F.col("a"), F.lit(False))
    kept = phrases.join(covered, ["lang", "phrase"], "left").where(~swallowed).drop("longer")

    cuts = kept.select(
        "lang", "phrase", "a",
        F.expr(f"explode(transform(sequence(1, words - 1), k -> struct(k, {_parts('1', 'k')} AS head, {_parts('k + 1', 'words')} AS tail)))").alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    parts = counts.select("lang", "phrase", "n")
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
        .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
        .join(totals, "lang")
        .withColumn(
            "score",
            F.expr("(1000 * CAST(a AS decimal(15,0)) * CAST(n AS decimal(15,0))) div (CAST(l AS decimal(15,0)) * CAST(r AS decimal(15,0)))"),
        )
    )
    worst = F.min(F.struct("score", "k", "l", "r")).alias("worst")
    found = scored.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return best.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
