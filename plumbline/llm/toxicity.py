"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams, a document the weighted average of its words. Embeddings and
output layer are trained together in numpy on a bounded sample of labelled rows, so a spelling
never seen in training still shares n-gram vectors with its relatives. A plain average drowns two words
in three hundred, so the model is trained twice: the first one, with equal weights, says how far a word points
to class 1, and the second one averages with weights that grow with that. With two classes the
decision of a trained model is a mean of one number per word, which makes scoring a look-up.

Null and empty texts, and texts without a word, get the score of the bias alone. Without any
labelled row every score is 0.5. Repeated rows and ties are scored alike; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import land, training_sample

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
# Passes over the sample, for each of the two models.
EPOCHS = 6
# Weight of a word that doesn't point to class 1, before squaring; others add their distance in standard deviations.
LEAST_WEIGHT = 1e-3
# Labelled rows the model is fitted on, at most, by class.
SAMPLE = {1: 1000, 0: 3000}
# Words whose value a worker remembers.
KNOWN_WORDS = 150_000

_WORD = re.compile(r"\w+")


def grams_of(word: str) -> list[bytes]:
    """The word and its character n-grams, with marked ends."""
    marked = f"<{word}>"
    if marked.isascii():
        data = marked.encode()
        return [data, *[data[i : i + n] for n in GRAMS for i in range(len(data) - n + 1)]]
    grams = [marked, *[marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]]
    return [g.encode("utf-8", "surrogatepass") for g in grams]


def subwords(word: str) -> np.ndarray:
    """Buckets of the word and its n-grams."""
    return np.array([zlib.crc32(g) % BUCKETS for g in grams_of(word)], dtype=np.int32)


class _Subwords(dict):
    def __missing__(self, word):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        got = self[word] = subwords(word)
        return got


def bag(text: str | None, known: dict, weigh: Callable[[str], float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to one."""
    counts = Counter(_WORD.findall((text or "").lower()))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    grams = [known[w] for w in counts]
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    times = np.fromiter(counts.values(), np.float64, len(grams))
    if weigh is not None:
        times *= [weigh(w) for w in counts]
    weights = np.repeat(times / sizes / times.sum(), sizes)
    buckets, place = np.unique(np.concatenate(grams), return_inverse=True)
    return buckets.astype(np.int32), np.bincount(place, weights).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: the two-class margin of every bucket, and of the bias.

    ``touched`` are the buckets that training met; the margins of the first model weigh words.
    """

    margins: np.ndarray
    bias: float
    touched: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def weights(self) -> tuple[float, float]:
        """Mean and standard deviation of the margins that words are weighed by."""
        known = self.margins[self.touched]
        return (float(known.mean()), float(known.std()) or 1.0) if len(known) else (0.0, 1.0)


@dataclass
class Pair:
    """The model that weighs words, and the one that scores their average."""

    first: Model
    second: Model

    @property
    def bias(self) -> float:
        return self.second.bias


def weight(margin: float, mean: float, spread: float) -> float:
    """What a word counts for in the average, by its margin in the first model."""
    return (LEAST_WEIGHT + max(margin - mean, 0.0) / spread) ** 2


def fit(rows: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], n: int, positive: int, rate: float = 0.3) -> Model:
    """Train embeddings and softmax jointly by stochastic gradients with row-wise step sizes.

    ``rows()`` gives the (buckets, weights, label) of all n rows in a mixed order, ``positive`` of them of class 1. It is
    called for each pass; one row is held at a time.
    """
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    output = rng.normal(0, 0.1, (DIM, 2))
    bias = np.array([0.0, np.log((positive + 1) / (n - positive + 1))])
    seen = np.full(BUCKETS, 1e-8)
    seen_output = 1e-8
    for _ in range(EPOCHS):
        for buckets, weights, label in rows():
            if not len(buckets):
                continue
            hidden = weights @ vectors[buckets]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = output @ error
            seen[buckets] += weights * weights * (back @ back / DIM)
            vectors[buckets] -= (rate * weights / np.sqrt(seen[buckets]))[:, None] * back
            seen_output += (hidden @ hidden) * (error @ error) / (2 * DIM)
            output -= rate * np.outer(hidden, error) / np.sqrt(seen_output)
            bias -= 0.05 * error
    return Model(vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]), np.flatnonzero(seen > 1e-8))


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sample: dict[int, int] | None = None) -> Pair:
    """Fit on at most ``sample[c]`` labelled documents of class c outside the held-out fold.

    The sampled texts are landed, and tasks turn them into bags. Each pass streams the bags from the shared folder in
    an order of its own, so the driver holds a partition of them at a time.
    """
    chosen = land(training_sample(docs, labels, label, folds, fold, sample or SAMPLE))
    counts = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, positive = sum(counts.values()), counts.get(1, 0)

    def fitted(first: Model | None) -> Model:
        bags = land(chosen.select("label", "text").mapInPandas(_bags(first), "label int, buckets binary, weights binary"))

        rows = [
            (np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["weights"], np.float32), r["label"])
            for r in bags.toLocalIterator()
        ]
        return fit(lambda: rows, n, positive)

    first = fitted(None)
    return Pair(first, fitted(first))


def _bags(first: Model | None):
    def bags(batches):
        known, weigh = _Subwords(), None
        if first is not None:
            margins, (mean, spread) = first.margins, first.weights()

            def weigh(word):
                return weight(float(margins[known[word]].mean()), mean, spread)

        for rows in batches:
            pairs = [bag(t, known, weigh) for t in rows["text"]]
            yield pd.DataFrame(
                {
                    "label": rows["label"],
                    "buckets": [a.tobytes() for a, _ in pairs],
                    "weights": [b.tobytes() for _, b in pairs],
                }
            )

    return bags


class _Values(dict):
    """A word's weight times its margin, as real part, and its weight, as imaginary part: one sum adds up both.

    Remembers two generations of KNOWN_WORDS words.
    """

    def __init__(self, model: Pair):
        super().__init__()
        self.first, self.second = model.first.margins.tolist(), model.second.margins.tolist()
        self.mean, self.spread = model.first.weights()
        self.old: dict[str, complex] = {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            crc, first, second = zlib.crc32, self.first, self.second
            places = [crc(g) % BUCKETS for g in grams_of(word)]
            heavy = weight(sum([first[p] for p in places]) / len(places), self.mean, self.spread)
            got = complex(heavy * sum([second[p] for p in places]) / len(places), heavy)
        if len(self) >= KNOWN_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


_values: dict[int, _Values] = {}


def score(text: Column | str, model: Pair) -> Column:
    """Probability of class 1, from the whole text."""
    bias = model.bias
    stamp = zlib.crc32(model.second.margins.tobytes(), zlib.crc32(model.first.margins.tobytes()))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if stamp not in _values:  # kept from task to task of a worker
            _values.clear()
            _values[stamp] = _Values(model)
        values = _values[stamp]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = _WORD.findall(text.lower()) if text else ()
            if words:
                total = sum(map(values.__getitem__, words))
                out[i] = total.real / total.imag
        return pd.Series(1 / (1 + np.exp(-np.clip(out + bias, -500, 500))))

    return scored(F.col(text) if isinstance(text, str) else text)
