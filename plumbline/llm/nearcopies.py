"""Near copies by wide SimHash fingerprints in BK-trees, for the pipeline.

Two texts are near copies if the sets of their ``SHINGLE``-word runs have a similarity (Jaccard) of about 0.8 or more.
A fingerprint has ``BITS`` bits, each the majority of one hash bit over a text's runs; two sets of similarity J differ
in a bit with probability acos(2J / (1 + J)) / pi, so 0.8 means 78 of 512 bits with a deviation of 8. ``RADIUS`` is
above that by 1.25 deviations: nine in ten pairs at 0.8 are linked and nearly all above; of pairs at 0.72 a quarter, at 0.65
one in a hundred.

Candidates: a text's least run under each of ``KEYS`` orders names a shard; texts of similarity J share one with
probability 1 - (1 - J) ^ KEYS. A shard of more than one fingerprint gets a BK-tree, whose children are keyed by their
Hamming distance to the parent; every member follows only the edges within the radius. Only links that join two parts
of a shard are reported. A shard above ``SHARD_ROWS`` is cut into pieces of that size, and each pair of pieces is a
task of its own.

Words are runs without ASCII white space, A-Z lowered. Fewer words than a run are one run; texts without words,
null ones too, are copies of each other. Equal fingerprints are made one before anything else, so copies in any number cost one
row. Of each group the row with the smallest id stays; of several texts of that id in the group the one that hashes least, once. Rows
without an id stay. All columns come out as they were.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import land, texts_of
from plumbline.llm.components import connected_components
from plumbline.llm.simhash import Tree, shard_links

SHINGLE = 5
BITS = 512
RADIUS = 88
KEYS = 4
SHARD_ROWS = 4096
# Words whose hash a worker remembers.
KNOWN_WORDS = 200_000

_SLICE = 255 * 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _mixed(h: np.ndarray, stream: int) -> np.ndarray:
    """The stream-th of many independent-looking hashes of the same things."""
    h = (h + np.uint64((stream + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) & np.uint64((1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of(text: str | None, known: dict) -> np.ndarray:
    """Hashes of a text's distinct runs of words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - SHINGLE + 1, min(len(words), 1))
    runs = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        runs = (runs ^ (runs >> np.uint64(29))) * _ODD + hashes[i : i + n]
    return np.unique(runs)


def fingerprint(runs: np.ndarray) -> bytes:
    """Majority bits over the runs' hashes; a text without runs has no bit set."""
    parts = []
    for stream in range(BITS // 64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(runs), _SLICE):  # a slice at a time: very long texts stay small
            bits = np.unpackbits(_mixed(runs[at : at + _SLICE], stream).view(np.uint8).reshape(-1, 8), axis=1)
            for low in range(0, len(bits), 255):  # sums of 255 bits fit a byte
                ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
        parts.append(np.packbits(2 * ones > len(runs)).tobytes())
    return b"".join(parts)


def shard_keys(runs: np.ndarray) -> np.ndarray:
    """The least run under each of ``KEYS`` orders."""
    if not len(runs):
        return np.zeros(0, np.int64)
    return np.array([_mixed(runs, BITS + k).min() ^ np.uint64(k) for k in range(KEYS)], np.uint64).view(np.int64)


def _prints(batches):
    known = _Words()
    for batch in batches:
        runs = [runs_of(t, known) for t in batch.column("text").to_pylist()]
        keys = [shard_keys(r) for r in runs]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate([*keys, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array([fingerprint(r) for r in runs], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            names=["doc_id", "text_key", "print", "keys"],
        )


def _numbers(prints) -> list[int]:
    return [int.from_bytes(p, "big") for p in prints]


def _links_of(nodes: list[int], prints: list[bytes]) -> list[tuple[int, int]]:
    numbers = _numbers(prints)
    by = dict(zip(numbers, nodes))
    return [(by[a], by[b]) for a, b in shard_links(numbers, RADIUS)]


def _shards(batches):
    """Over rows sorted by shard: links of small shards, members of large ones with the piece they are in."""

    def made(rows, linked):
        shards, a, b, prints = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([linked] * len(rows), pa.bool_()), pa.array(shards, pa.int64()), pa.array(a, pa.int64()),
                pa.array(b, pa.int64()), pa.array(prints, pa.binary()),
            ],
            names=["linked", "shard", "a", "b", "print"],
        )

    def let_go(shard, nodes, prints, piece, last):
        if piece or not last:  # a piece of a large shard
            return made([(shard, n, piece, p) for n, p in zip(nodes, prints)], False)
        return made([(0, a, b, None) for a, b in _links_of(nodes, prints)], True)

    key, nodes, prints, piece = None, [], [], 0
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]]) if len(shards) else np.zeros(1, int)
        alone = np.diff(cuts) == 1
        alone[:1] = alone[-1:] = False  # these may go on in the batch before or after
        ids, values = batch.column("node"), batch.column("print")
        for i in np.flatnonzero(~alone).tolist():
            low, high = int(cuts[i]), int(cuts[i + 1])
            if int(shards[low]) != key:
                if len(nodes) > 1 or piece and nodes:
                    yield let_go(key, nodes, prints, piece, True)
                key, nodes, prints, piece = int(shards[low]), [], [], 0
            for at in range(low, high, SHARD_ROWS):
                nodes += ids.slice(at, min(SHARD_ROWS, high - at)).to_pylist()
                prints += values.slice(at, min(SHARD_ROWS, high - at)).to_pylist()
                while len(nodes) > SHARD_ROWS:
                    yield let_go(key, nodes[:SHARD_ROWS], prints[:SHARD_ROWS], piece, False)
                    nodes, prints, piece = nodes[SHARD_ROWS:], prints[SHARD_ROWS:], piece + 1
    if len(nodes) > 1 or piece and nodes:
        yield let_go(key, nodes, prints, piece, True)


def _pieces(key, frame):
    """The tree of one piece of a large shard, searched by another (or by itself)."""
    one, other = key[1], key[2]
    by: dict[int, int] = {}
    tree, links = Tree(RADIUS), []
    for piece in dict.fromkeys((one, other)):
        rows = frame[frame["piece"] == piece]
        for x, node in zip(_numbers(rows["print"]), rows["node"].tolist()):
            by[x] = node
            links += [(x, y) for y in tree.near(x) if tree.join(x, y)]
            if piece == one:
                tree.add(x)
    return pd.DataFrame([(by[a], by[b]) for a, b in links], columns=["a", "b"], dtype="int64")


def print_links(prints: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints are near: enough to hold every component together."""
    sharded = prints.select("node", "print", F.explode("keys").alias("shard"))
    found = land(
        sharded.repartition("shard")
        .sortWithinPartitions("shard", "node")
        .mapInArrow(_shards, "linked boolean, shard long, a long, b long, print binary")
    )
    small = found.where("linked").select("a", "b")
    large = found.where("NOT linked").select("shard", F.col("a").alias("node"), F.col("b").alias("piece"), "print")
    ends = large.groupBy("shard").agg(F.max("piece").alias("last"))
    # piece i meets every piece j once, as (i, j) with i <= j
    meetings = large.join(ends, "shard").select(
        "shard", "node", "print", "piece", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    )
    met = meetings.groupBy("shard", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"))
    return small.union(met.applyInPandas(_pieces, "a long, b long")).distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, see above."""
    key = F.xxhash64(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = texts_of(docs, id_col, text_col).where("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    rows = texts.mapInArrow(_prints, f"doc_id {kind}, text_key long, print binary, keys array<long>")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    # nodes are numbered once and written: what follows reads the same numbers
    prints = land(rows.groupBy("print").agg(first, F.min("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    parts = connected_components(print_links(prints)).withColumnRenamed("node", "linked_node")
    placed = prints.select("node", "first").join(parts, F.col("node") == F.col("linked_node"), "left")
    chosen = placed.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias("_nc_id"), F.col("first.text_key").alias("_nc_key"))
    kept = docs.join(chosen, (F.col(id_col) == F.col("_nc_id")) & (key == F.col("_nc_key")), "left_semi")
    once = kept.withColumn("_nc_key", key).dropDuplicates([id_col, "_nc_key"]).drop("_nc_key")
    return once.union(docs.where(F.col(id_col).isNull()))
