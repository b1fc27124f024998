"""Line dedup by a deletion neighbourhood.

Two lines match if their words (split at ASCII white space, A-Z lower-cased) are equal or differ by
one word put in, left out or replaced. Of matching lines the earliest stays, by (doc_id, hash of
the text, line number), null ids first; a line goes if any earlier line matches it, whether or not
that one stays. A character typo is one replaced word.

Lines of fewer than ``exact_words`` words stay as they are; those of fewer than ``edit_words`` match
equal lines only, as one word of four is no small edit. Blank lines stay. Null and empty texts have no
line that can go and come back as they are. Rows repeated in full count as one row: they lose the
same lines. Columns other than id and text are not read.

How: a line emits a hashed key for itself and for every deletion of one word; equal keys are joined
with the earliest line of the key. A key of replaced words also holds the place of the deletion, so
all lines of such a key match one another and the earliest stands for them all; no pairs within a
key are made. Deletions are joined with the whole line of the same key, of which there is one.
Every match is verified by edit distance on the words.

Before that, lines that share neither their first nor their second half with any other line are set
aside: one edit leaves one half as it is, so this loses nothing. A line that shares one half only
emits the deletions of the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import land, remove, stage, texts_of

EXACT_WORDS = 2
EDIT_WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            step = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, step, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, step, 1 << 64))])
        return self.up, self.down


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Scatter polynomial values over 64 bits; signed, as Spark's longs are."""
    x = x ^ (np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


_WHOLE, _FRONT, _BACK = 1, 2, 3
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word (none is empty): its groups of eight bytes, scattered by their place and added up."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    sizes = np.diff(ends)
    groups = (sizes + 7) // 8
    starts = np.cumsum(groups) - groups
    padded = np.zeros(8 * int(groups.sum()), np.uint8)
    padded[np.arange(ends[-1]) + np.repeat(8 * starts - ends[:-1], sizes)] = np.frombuffer(words.buffers()[2], np.uint8, ends[-1])
    place = np.arange(len(padded) // 8) - np.repeat(starts, groups)
    with np.errstate(over="ignore"):
        scattered = _mix(padded.view("<u8").astype(np.uint64), place + 1).view(np.uint64)
        return _mix(np.add.reduceat(scattered, starts), sizes).view(np.uint64)


class LineHasher:
    """Keys of all lines of a text from one running polynomial over its word hashes."""

    def __init__(self):
        self.powers = _Powers()

    def _sums(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of some lower-cased bytes begin, the running polynomial and the inverse powers."""
        word = ~_WHITE[raw]
        edges = np.diff(word.view(np.int8), prepend=0, append=0)
        starts = np.flatnonzero(edges == 1)
        n = len(starts)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(np.flatnonzero(edges == -1) - starts, out=offsets[1:])
        listed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
        coded = listed.dictionary_encode()
        up, down = self.powers.of(n + 1)
        hashes = _word_hashes(coded.dictionary)[coded.indices.to_numpy()]
        return starts, np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])]), down

    def lines(self, texts: list[bytes], edit_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all lines of some texts, one after another: lines per text; words per line, key per line, and four
        keys of halves per line (0: none).
        """
        raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        per_text = np.fromiter((text.count(b"\n") + 1 for text in texts), np.int64, len(texts))
        begins, sums, down = self._sums(raw)
        ends = np.append(np.searchsorted(begins, np.flatnonzero(raw == 10)), len(begins))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        sizes = ends - starts

        def key(a, b, kind):
            with np.errstate(over="ignore"):
                return _mix((sums[b] - sums[a]) * down[a], kind + 8 * (b - a))

        half, less = sizes // 2, (sizes - 1) // 2  # of a line, and of one that lacks a word
        back, back_less = sizes - half, np.maximum(sizes - 1, 0) - less
        halves = np.stack(
            [
                key(starts, starts + half, _FRONT),
                np.where(less != half, key(starts, starts + np.maximum(less, 0), _FRONT), 0),
                key(ends - back, ends, _BACK),
                np.where(back_less != back, key(ends - np.maximum(back_less, 0), ends, _BACK), 0),
            ],
            axis=1,
        )
        halves[sizes < edit_words] = 0
        return per_text, sizes, key(starts, ends, _WHOLE), halves

    def variants(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per line and key per line as it is; key of its line without it, word by word."""
        raw = np.frombuffer(b"\n".join(lines), np.uint8)
        begins, sums, down = self._sums(raw)
        ends = np.append(np.searchsorted(begins, np.flatnonzero(raw == 10)), len(begins))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        sizes = ends - starts
        first, last, at = np.repeat(starts, sizes), np.repeat(ends, sizes), np.arange(len(begins))
        with np.errstate(over="ignore"):
            whole = (sums[ends] - sums[starts]) * down[starts]
            without = (sums[at] - sums[first] + (sums[last] - sums[at + 1]) * np.uint64(_INVERSE)) * down[first]
        return sizes, _mix(whole, _WHOLE + 8 * sizes), _mix(without, _WHOLE + 8 * (last - first - 1))


def _line_rows(exact_words: int, edit_words: int):
    names = ["doc_id", "text_key", "line_no", "line_key", "front", "front_less", "back", "back_less"]

    def rows(batches):
        hasher = LineHasher()
        for batch in batches:
            batch = batch.filter(pc.greater(pc.binary_length(batch.column("text")), 0))
            if not batch.num_rows:
                continue
            per_text, sizes, keys, halves = hasher.lines(batch.column("text").cast(pa.binary()).to_pylist(), edit_words)
            at = np.flatnonzero(sizes >= exact_words)
            row = np.repeat(np.arange(batch.num_rows), per_text)[at]
            line_no = at - (np.cumsum(per_text) - per_text)[row]
            halves = halves[at]
            columns = [
                *(batch.column(c).cast(pa.int64()).take(pa.array(row)) for c in ("doc_id", "text_key")),
                pa.array(line_no.astype(np.int32)),
                pa.array(keys[at]),
                *(pa.array(halves[:, i], mask=halves[:, i] == 0) for i in range(4)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows


_LINES = "doc_id long, text_key long, line_no int, line_key long, front long, front_less long, back long, back_less long"


def _picked(batches):
    """The listed lines of each text: its words, lower-cased and joined by one space."""
    for batch in batches:
        keys, docs, hashes, numbers, fronts, backs, words = [], [], [], [], [], [], []
        for doc_id, text_key, text, wanted in zip(
            *(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "wanted"))
        ):
            lines = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
            for w in wanted:
                keys.append(w["line_key"])
                docs.append(doc_id)
                hashes.append(text_key)
                numbers.append(w["line_no"])
                fronts.append(w["front_shared"])
                backs.append(w["back_shared"])
                words.append(b" ".join(lines[w["line_no"]].split()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(fronts, pa.bool_()), pa.array(backs, pa.bool_()), pa.array(words, pa.binary())],
            ["line_key", "doc_id", "text_key", "line_no", "front", "back", "words"],
        )


def _variant_rows(batches):
    """A row for each whole line (place -1) and for each place whose deletion can meet another line's.

    With a front half in common the edit lies behind it, with a back half before it.
    """
    hasher = LineHasher()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, whole, without = hasher.variants(batch.column("words").to_pylist())
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        front, back = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool)[row] for c in ("front", "back"))
        middle = (sizes[row] - 1) // 2
        at = np.flatnonzero((front & (place >= middle)) | (back & (place <= middle)))
        rows = pa.array(np.concatenate([np.arange(len(sizes)), row[at]]))
        places = np.concatenate([np.full(len(sizes), -1), place[at]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([whole, without[at]])), pa.array(places), *(batch.column(c).take(rows) for c in ("line_key", "doc_id", "text_key", "line_no"))],
            ["variant", "place", "line_key", "doc_id", "text_key", "line_no"],
        )


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Word edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


@F.pandas_udf(T.BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one_edit(x.split(b" "), y.split(b" ")) for x, y in zip(a, b)], dtype=bool)


_POSITION = ("doc_id", "text_key", "line_no")


def near_lines(texts: DataFrame, firsts: DataFrame, edit_words: int) -> DataFrame:
    """(line_key) of distinct lines that an earlier line matches with one edit.

    ``firsts`` has each distinct line once: line_key, its first position, the keys of its halves.
    """
    halves = firsts.select(
        "line_key", F.posexplode(F.array("front", "front_less", "back", "back_less")).alias("side", "half")
    ).where("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.min("line_key").alias("lo"), F.max("line_key").alias("hi")).where("lo != hi")
    screened = (
        halves.join(shared.select("half"), "half", "left_semi")
        .groupBy("line_key")
        .agg(F.max(F.col("side") < 2).alias("front_shared"), F.max(F.col("side") >= 2).alias("back_shared"))
    )

    wanted = (
        firsts.select("line_key", "first")
        .join(screened, "line_key")
        .groupBy("first.doc_id", "first.text_key")
        .agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "line_key", "front_shared", "back_shared")).alias("wanted"))
        .select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "wanted")
    )
    # written, as are links and results below, so that shuffles of an earlier step are gone when a later one begins;
    # what no later step reads is removed
    wanted, wanted_path = stage(wanted)
    found = texts.where(F.length("text") > 0).join(
        wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))
    )
    lines, lines_path = stage(
        found.select("doc_id", "text_key", "text", "wanted").mapInArrow(
            _picked, "line_key long, doc_id long, text_key long, line_no int, front boolean, back boolean, words binary"
        )
    )
    remove(texts.sparkSession, wanted_path)
    long_enough = F.size(F.split(F.col("words").cast("string"), " "))
    variants, variants_path = stage(
        lines.mapInArrow(_variant_rows, "variant long, place int, line_key long, doc_id long, text_key long, line_no int")
    )
    variants = variants.select("variant", "place", "line_key", F.struct(*_POSITION).alias("at"))

    # replaced words: the earliest line of the same key and place
    firsts_of = (
        variants.where("place >= 0")
        .groupBy("variant", "place")
        .agg(F.min(F.struct("at", "line_key")).alias("earliest"), F.max("line_key").alias("hi"), F.min("line_key").alias("lo"))
        .where("lo != hi")
        .select("variant", "place", F.col("earliest.at").alias("e_at"), F.col("earliest.line_key").alias("earlier"))
    )
    replaced = (
        variants.where("place >= 0")
        .join(firsts_of, ["variant", "place"])
        .where(F.col("at") > F.col("e_at"))
        .select(F.col("line_key").alias("later"), "earlier")
    )
    # a word more or less: the one whole line of the same key
    whole = variants.where("place = -1").select("variant", F.col("line_key").alias("w_line"), F.col("at").alias("w_at"))
    inserted = (
        variants.where("place >= 0")
        .join(whole, "variant")
        .select(
            F.when(F.col("at") > F.col("w_at"), F.col("line_key")).otherwise(F.col("w_line")).alias("later"),
            F.when(F.col("at") > F.col("w_at"), F.col("w_line")).otherwise(F.col("line_key")).alias("earlier"),
        )
    )
    links, links_path = stage(replaced.union(inserted).distinct())
    remove(texts.sparkSession, variants_path)
    a = lines.where(long_enough >= edit_words).select(F.col("line_key").alias("later"), F.col("words").alias("later_words"))
    b = lines.where(long_enough >= edit_words).select(F.col("line_key").alias("earlier"), F.col("words").alias("earlier_words"))
    checked = links.join(a, "later").join(b, "earlier")
    near = land(checked.where(_verified("later_words", "earlier_words")).select(F.col("later").alias("line_key")).distinct())
    for path in (lines_path, links_path):
        remove(texts.sparkSession, path)
    return near


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_words: int = EXACT_WORDS, edit_words: int = EDIT_WORDS
) -> DataFrame:
    """(doc_id, text_key, equal_lines, near_lines): line numbers that go, of texts that lose any.

    ``text_key`` is Spark's xxhash64 of the text. The result is a written table.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    lines, lines_path = stage(texts.select("doc_id", "text_key", "text").mapInArrow(_line_rows(exact_words, edit_words), _LINES))
    firsts, firsts_path = stage(
        lines.groupBy("line_key").agg(
            F.min(F.struct(*_POSITION)).alias("first"),
            F.max(F.struct(*_POSITION)).alias("last"),
            *(F.max(c).alias(c) for c in ("front", "front_less", "back", "back_less")),
        )
    )
    near = near_lines(texts, firsts, edit_words).withColumn("near", F.lit(True))
    judged = (
        firsts.join(near, "line_key", "left")
        .where(F.col("near") | (F.col("first") != F.col("last")))
        .select("line_key", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    going = lines.select(*_POSITION, "line_key").join(judged, "line_key").where(F.col("near") | (F.struct(*_POSITION) != F.col("first")))
    equal = F.when(F.struct(*_POSITION) != F.col("first"), F.col("line_no"))
    gone = land(
        going.groupBy("doc_id", "text_key").agg(
            F.sort_array(F.collect_set(equal)).alias("equal_lines"),
            F.sort_array(F.collect_set(F.when(equal.isNull(), F.col("line_no")))).alias("near_lines"),
        )
    )
    for path in (lines_path, firsts_path):
        remove(docs.sparkSession, path)
    return gone


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, equal: pd.Series, near: pd.Series) -> pd.Series:
    out = []
    for text, a, b in zip(texts, equal, near):
        if text is not None and a is not None:
            gone = {*a, *b}
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` as it is after dedup, and n_equal and n_near: lines gone.

    All other columns stay as they are (an n_equal or n_near of the input is replaced).
    """
    gone = repeated_lines(docs, id_col, text_col, **settings).toDF("_ld_gone", "_ld_gone_key", "_ld_equal", "_ld_near")
    rows = docs.withColumn("_ld_key", F.xxhash64(text_col)).withColumn("_ld_id", F.col(id_col))
    # texts are sorted by key however few lose lines: the plan, and the disk it takes, don't hinge on sizes
    joined = rows.join(gone.hint("merge"), F.col("_ld_id").eqNullSafe(F.col("_ld_gone")) & (F.col("_ld_key") == F.col("_ld_gone_key")), "left")
    counted = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    shown = [
        _without(F.col(text_col), F.col("_ld_equal"), F.col("_ld_near")).alias(text_col) if c == text_col else F.col(c)
        for c in docs.columns
        if c not in ("n_equal", "n_near")
    ]
    return joined.select(*shown, counted("_ld_equal").alias("n_equal"), counted("_ld_near").alias("n_near"))
