"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed with each, in
blocks short enough for the dictionaries to matter throughout a long text; the difference of the two
sizes over their sum says which it resembles. A logistic curve, fitted on labelled rows that took no part
in the dictionaries, turns it into a probability.

The sampled rows' texts are used whole: tasks cut those for the dictionaries into pieces, of which ``PIECES`` at most, the
least by hash, train each; and tasks compress the others, so a number per row reaches the driver.

Null and empty texts get the difference zero. If either class has too few texts for a dictionary, every score
is the share of good rows (0.5 without any). Repeated rows and ties are scored alike; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, land, training_sample

# Labelled rows used, at most, by class: half for the dictionaries, half for the curve.
SAMPLE = {1: 1600, 0: 1600}
# Pieces of the rows for a dictionary that it is trained on, at most: a sample over all of their texts.
PIECES = 8000
DICTIONARY_BYTES = 112_640
BLOCK = 1024
PIECE = 2 * BLOCK
LEVEL = 3
LEAST_TEXTS = 8


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
            )

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) sizes of all blocks; above zero if the text resembles good ones."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        return (bad - good) / (bad + good)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the best logistic curve, by Newton's steps with a light ridge on the slope."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    ridge = np.diag([1e-2, 1e-6])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weights * (y - p)) - ridge @ beta
        step = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + ridge, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def _dictionary(pieces: list[bytes]) -> bytes:
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform to train on: the texts themselves
        return b"\n".join(pieces)[-size:]


def pieces_of(text: str | None) -> list[bytes]:
    """A whole text in pieces, without white space alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return [p for i in range(0, len(data), PIECE) if (p := data[i : i + PIECE]).strip()]


def _flat(good_rows: float, bad_rows: float) -> Model:
    """Without dictionaries: the share of good rows."""
    good = (good_rows + 1) / (good_rows + bad_rows + 2)
    return Model(b"", b"", 0.0, float(np.log(good / (1 - good))))


def curve(good: bytes, bad: bytes, differences: list[float], labels: list[int], shares: dict[int, float]) -> Model:
    """The logistic curve of differences of rows outside the dictionaries.

    ``shares`` are the classes' shares among all labelled rows, which the sample may not have.
    """
    x, y = np.array(differences, float), np.array(labels, float)
    weights = np.where(y == 1, shares[1] / max((y == 1).sum(), 1), shares[0] / max((y == 0).sum(), 1)) * len(y)
    return Model(good, bad, *logistic(x, y, weights))


def fit(texts: list[str], labels: list[int], shares: dict[int, float] | None = None) -> Model:
    """Fit on texts in memory: every other text of a class goes into its dictionary, the rest fit the curve."""
    by = {c: [t for t, label in zip(texts, labels) if label == c] for c in (0, 1)}
    if min(map(len, by.values())) < LEAST_TEXTS:
        return _flat(len(by[1]), len(by[0]))
    shares = shares or {c: len(v) / len(texts) for c, v in by.items()}
    good, bad = (_dictionary([p for t in by[c][::2] for p in pieces_of(t)]) for c in (1, 0))
    sizes = Sizes(good, bad)
    rest = [(sizes.difference(t), c) for c in (0, 1) for t in by[c][1::2]]
    return curve(good, bad, [x for x, _ in rest], [c for _, c in rest], shares)


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sample: dict[int, int] | None = None) -> Model:
    """Fit on at most ``sample[c]`` labelled documents of each class outside the held-out fold, by their whole texts."""
    chosen = training_sample(docs, labels, label, folds, fold, sample or SAMPLE).where("label IN (0, 1) AND text IS NOT NULL")
    # which half a row is in depends on its id alone
    rows = land(chosen.select("label", "text", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0).alias("inside")))
    counts = {(r["label"], r["inside"]): r["count"] for r in rows.groupBy("label", "inside").count().collect()}
    if min(counts.get((c, inside), 0) for c in (0, 1) for inside in (True, False)) < LEAST_TEXTS // 2:
        return _flat(*(sum(n for (c, _), n in counts.items() if c == wanted) for wanted in (1, 0)))

    def cut(batches):
        for frame in batches:
            for label_, text in zip(frame["label"], frame["text"]):
                yield pd.DataFrame({"label": label_, "piece": pieces_of(text)}).astype({"label": "int32", "piece": "object"})

    pieces = rows.where("inside").select("label", "text").mapInPandas(cut, "label int, piece binary")
    found = {}
    for c in (1, 0):
        least = pieces.where(F.col("label") == c).orderBy(F.xxhash64("piece"), "piece").limit(PIECES)
        found[c] = _dictionary([bytes(r["piece"]) for r in least.select("piece").collect()])
    good, bad = found[1], found[0]

    def compare(batches):
        sizes = Sizes(good, bad)
        for frame in batches:
            yield pd.DataFrame({"label": frame["label"], "x": [sizes.difference(t) for t in frame["text"]]})

    rest = rows.where("NOT inside").select("label", "text").mapInPandas(compare, "label int, x double").collect()
    rest.sort()
    return curve(good, bad, [r["x"] for r in rest], [r["label"] for r in rest], _shares(labels, label, folds, fold))


def _shares(labels: DataFrame, label: str, folds: int, fold: int) -> dict[int, float]:
    """Shares of both classes among all labelled rows outside the fold."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id", folds, fold))
    n = {int(r["label"]): r["count"] for r in usable.groupBy(F.col(label).alias("label")).count().collect()}
    total = sum(n.values()) + 2
    return {c: (n.get(c, 0) + 1) / total for c in (0, 1)}


def score(text: Column | str, model: Model) -> Column:
    """Probability that a text is good, from the whole text."""
    slope, offset = model.slope, model.offset

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if slope == 0.0:
            x = np.zeros(len(texts))
        else:
            sizes = _sizes(model)
            x = np.fromiter(map(sizes.difference, texts), float, len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500))))

    return scored(F.col(text) if isinstance(text, str) else text)


_kept: dict[int, Sizes] = {}


def _sizes(model: Model) -> Sizes:
    stamp = zlib.crc32(model.good + model.bad)
    if stamp not in _kept:
        _kept.clear()
        _kept[stamp] = Sizes(model.good, model.bad)
    return _kept[stamp]
