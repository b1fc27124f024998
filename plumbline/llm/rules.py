"""Quality rules: counts of a text, and how far its histograms diverge from its language's.

Counts: words are runs without ASCII white space. A text fails the base rules with fewer than
``LEAST_WORDS`` words, or with over 20 % of its words in 5-word windows that it repeats. A text that
passes is compared with references: a histogram of character classes and one of each language's
``COMMON`` most frequent words (and all others together), both summed over all documents of the
language. The measure is the Jensen-Shannon distance (root of the divergence in bits, 0 to 1) to the nearest
language. Common words are a part of all words, so even a text without any stays well below 1 (0.49 where they
are 41 %): distances of words are judged as shares of what such a text has from the same language. Texts too
short for a histogram to mean anything pass: see the two guards.

Null and empty texts have no words and fail the base rules. Rows without a language, or with one of too few
words for a reference, are left out of the references but judged like all others. Without any reference
nothing is compared. Repeated rows count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import land

LEAST_WORDS = 10
WINDOW = 5
SYMBOLS = "#*$%&|<>"
COMMON = 100
# Words a text needs to be compared by character classes, and by common words.
CLASS_GUARD, WORD_GUARD = 20, 60
# Greatest distance of classes of texts that are kept, and greatest share of the distance of a text without common words.
CLASS_LIMIT, WORD_LIMIT = 0.32, 0.9
# Words a language needs to be a reference.
REFERENCE_WORDS = 1000

_SPACES = " \t\n\v\f\r"
_EDGES = b".,;:!?\"'()[]#*$%&|<>-"
_FLUSH = 200_000

CLASSES = ("lower", "upper", "digit", "space", "stop", "exclaim", "symbol", "other", "beyond")


def _class_table() -> np.ndarray:
    """The class of every byte; bytes within a character count as nothing (the last number)."""
    table = np.full(256, len(CLASSES), np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = (
            0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in _SPACES
            else 4 if c in ".,;:'\"-()" else 5 if c in "!?" else 6 if c in SYMBOLS else 7
        )
    table[0xC0:] = 8
    return table


_TABLE = _class_table()


def class_counts(data: bytes) -> np.ndarray:
    """Characters by class, of a text in UTF-8."""
    bytes_seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(_TABLE, bytes_seen, minlength=len(CLASSES) + 1)[: len(CLASSES)]


def common_forms(words: list[bytes]) -> Counter:
    """Words by their lower-cased form without marks at the ends."""
    return Counter([w.strip(_EDGES) for w in words])


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    marked = np.zeros(len(words) + 1, np.int64)
    twice = np.array([i for i, w in enumerate(windows) if times[w] > 1])
    np.add.at(marked, twice, 1)
    np.add.at(marked, twice + size, -1)
    return int((np.cumsum(marked) > 0).sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts; 1 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0.0)))


def _histograms(batches):
    """Counts of a task's texts by language: rows (lang, kind, item, n)."""

    def table(lang, kind, items):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(items), pa.string()),
                pa.array([kind] * len(items), pa.string()),
                pa.array(list(items), pa.binary()),
                pa.array(list(items.values()), pa.int64()),
            ],
            ["lang", "kind", "item", "n"],
        )

    words, classes = {}, {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            seen = words.setdefault(lang, Counter())
            seen.update(w.strip(_EDGES) for w in data.lower().split())
            classes[lang] = classes.get(lang, 0) + class_counts(data)
            if len(seen) > _FLUSH:  # a sum of parts is the same sum
                yield table(lang, "word", seen)
                words[lang] = Counter()
    for lang, seen in words.items():
        yield table(lang, "word", seen)
    for lang, seen in classes.items():
        yield table(lang, "class", {c.encode(): int(n) for c, n in zip(CLASSES, seen)})


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> dict[str, dict]:
    """By language: counts by class, and of its common words with all others under ``None``.

    Summed over all documents; the driver gets ``common`` words a language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(_histograms, "lang string, kind string, item binary, n long").groupBy("lang", "kind", "item").agg(
        F.sum("n").alias("n")
    )
    sums = land(sums.where(F.length("item") > 0))
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    top = sums.where("kind = 'word'").withColumn("rank", ranked).where(F.col("rank") <= common).select("lang", "kind", "item", "n")
    totals = sums.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n"))
    found: dict[str, dict] = {}
    for r in top.union(sums.where("kind = 'class'")).collect():
        found.setdefault(r["lang"], {"word": {}, "class": {}})[r["kind"]][bytes(r["item"])] = r["n"]
    for r in totals.collect():
        if r["n"] < REFERENCE_WORDS:
            found.pop(r["lang"], None)
        elif r["lang"] in found:
            found[r["lang"]]["word"][None] = r["n"] - sum(found[r["lang"]]["word"].values())
    return dict(sorted(found.items()))


class Judge:
    """Distances of texts to the nearest language's references."""

    def __init__(self, found: dict[str, dict]):
        self.classes = [np.array([r["class"].get(c.encode(), 0) for c in CLASSES], float) for r in found.values()]
        self.words, self.places = [], {}
        for i, r in enumerate(found.values()):
            listed = [w for w in r["word"] if w is not None]
            self.words.append(np.array([*(r["word"][w] for w in listed), r["word"][None]], float))
            for j, w in enumerate(listed):
                self.places.setdefault(w, []).append((i, j))
        # distances of a text without any common word
        self.reach = [distance(np.eye(len(w))[-1], w) for w in self.words]

    def distances(self, data: bytes, words: list[bytes]) -> tuple[float, float, float]:
        """Of classes and of words, and the latter's least share of what a text without common words has."""
        if not self.classes:
            return 0.0, 0.0, 0.0
        own = class_counts(data)
        seen = [np.zeros(len(w)) for w in self.words]
        total = 0
        for form, n in common_forms(words).items():
            if form:
                total += n
                for i, j in self.places.get(form, ()):
                    seen[i][j] += n
        for s in seen:
            s[-1] = total - s[:-1].sum()
        by_word = [distance(s, w) for s, w in zip(seen, self.words)]
        share = min(d / r if r else 0.0 for d, r in zip(by_word, self.reach))
        return min(distance(own, c) for c in self.classes), min(by_word), share


def measure(text: str | None, judge: Judge) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class distance, word distance and its share."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0.0, 0.0, 0.0
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    by_class, by_word, share = judge.distances(data, data.lower().split())
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        by_class,
        by_word,
        share,
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in COUNTS),
        *(T.StructField(c, T.DoubleType()) for c in ("class_distance", "word_distance", "word_share")),
    ]
)


def measures(text: Column | str, found: dict[str, dict]) -> Column:
    """A struct of the counts and distances of a text."""

    @F.pandas_udf(_MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        judge = Judge(found)
        return pd.DataFrame([measure(t, judge) for t in texts], columns=_MEASURES.fieldNames())

    return measured(F.col(text) if isinstance(text, str) else text)


def verdict(found: Column, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> tuple[Column, Column]:
    """(base_failed, kept) of a struct of measures."""
    n = found["n_words"]
    failed = (n < LEAST_WORDS) | (100 * found["n_repeat_words"] > 20 * n)
    far = ((n >= CLASS_GUARD) & (found["class_distance"] > class_limit)) | (
        (n >= WORD_GUARD) & (found["word_share"] > word_limit)
    )
    return failed, ~failed & ~far
