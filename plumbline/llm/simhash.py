"""SimHash near-dedup: 64-bit fingerprints, linked at few differing bits, found in BK-trees.

A text is lower-cased (A-Z), split into words at ASCII white space and read in 4-word shingles,
repeats included; fewer words are one shingle, no words give fingerprint zero. A bit is set if it is
set in over half of the shingles' XXH64 (seed 42). Fingerprints link at ``RADIUS`` or fewer differing
bits, and documents fall into the components of these links.

How: the bits are cut into seven blocks. At most four blocks can hold four differing bits, so two
linked fingerprints agree on three whole blocks at least: each choice of three blocks and their
value is a shard (35 per fingerprint), and linked fingerprints share one. A shard of more than one
fingerprint gets a BK-tree, whose children are keyed by their Hamming distance to the parent, and
every member follows only the edges within the radius. Only links that join two parts of a shard are
reported, never all pairs. A shard above ``SHARD_ROWS`` is cut into pieces of that size; every piece
has its tree and its task for each other piece that searches it, so large shards spread over tasks and
no task holds more than two pieces.

Fingerprints are made distinct first, so copies in any number cost one. Null and empty texts have
fingerprint zero, linked like any other. A null doc_id takes part with its text, but is never the
smallest of its component; where all are null, so is the component. Columns other than id and text are
not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import land, texts_of
from plumbline.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
SHARD_ROWS = 4096

_BLOCKS = (9, 9, 9, 9, 9, 9, 10)
_KEPT = 3
_SLICE = 1 << 15


def fingerprint_of(text: str | None) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    n = max(len(words) - SHINGLE + 1, 1)
    begin, end = starts[:n].tolist(), (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):  # a slice of hashes at a time: very long texts stay small
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(begin[at : at + _SLICE], end[at : at + _SLICE])), np.uint64
        )
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint_of, texts), np.uint64, len(texts)).view(np.int64))


def fingerprint(text: Column | str) -> Column:
    """The fingerprint as a signed long of the same bits."""
    return _fingerprints(F.col(text) if isinstance(text, str) else text)


def as_hex(column: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _masks() -> list[int]:
    edges = np.concatenate([[0], np.cumsum(_BLOCKS)])
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, _KEPT)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Tree:
    """A BK-tree of fingerprints and the parts of it known to hang together."""

    def __init__(self, radius: int):
        self.radius = radius
        self.root: tuple[int, dict] | None = None
        self.parent: dict[int, int] = {}

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while True:
            d = (x ^ value).bit_count()
            if d == 0:
                return
            if d not in children:
                children[d] = (x, {})
                return
            value, children = children[d]

    def near(self, x: int):
        """Members within the radius."""
        radius = self.radius
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                yield value
            if len(children) <= 2 * radius:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
            else:
                todo += [children[e] for e in range(max(d - radius, 1), d + radius + 1) if e in children]

    def find(self, x: int) -> int:
        top = x
        while (up := self.parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, x: int, y: int) -> bool:
        """Put two fingerprints into one part; true if they were in two."""
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[a] = b
        return a != b


def shard_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that hold the parts of one shard together."""
    tree, links = Tree(radius), []
    for x in members:
        links += [(x, y) for y in tree.near(x) if tree.join(x, y)]
        tree.add(x)
    return links


def _signed(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)


_LINKED, _MEMBER = 0, 1


def _shards(radius: int, shard_rows: int):
    """Over rows sorted by shard: links of small shards, numbered members of large ones."""

    def batch(kind, shard, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(shard), pa.array(a), pa.array(b)], ["kind", "shard", "a", "b"]
        )

    def links_of(members):
        found = _signed(shard_links(members.view(np.uint64).tolist(), radius))
        return batch(_LINKED, np.zeros(len(found), np.int64), np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1]))

    def rows(batches):
        key, held, passed = None, [], 0  # the shard that the last batch ended in, passed: members already let go
        for got in batches:
            shards, prints = (got.column(c).to_numpy() for c in ("shard", "print"))
            if not len(shards):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
            alone = np.diff(cuts) == 1
            alone[[0, -1]] = False
            for i in np.flatnonzero(~alone):
                shard, members = int(shards[cuts[i]]), prints[cuts[i] : cuts[i + 1]]
                if shard != key:
                    if passed:
                        yield from let_go(key, held, passed)
                    elif sum(map(len, held)) > 1:
                        yield links_of(np.concatenate(held))
                    key, held, passed = shard, [], 0
                held.append(members)
                if sum(map(len, held)) > shard_rows:
                    yield from let_go(key, held, passed)
                    passed += sum(map(len, held))
                    held = []
        if passed:
            yield from let_go(key, held, passed)
        elif sum(map(len, held)) > 1:
            yield links_of(np.concatenate(held))

    def let_go(shard, held, passed):
        if held:
            members = np.concatenate(held)
            pieces = (np.arange(len(members)) + passed) // shard_rows
            yield batch(_MEMBER, np.full(len(members), shard, np.int64), members, pieces)

    return rows


def _pieces(radius: int):
    """Over the rows of two pieces of a large shard, the tree of the first and what searches it."""

    def rows(key, frame):
        one, other = key[1], key[2]
        prints = frame["print"].to_numpy().view(np.uint64)
        at = frame["piece"].to_numpy()
        tree, links = Tree(radius), []
        for x in prints[at == one].tolist():
            links += [(x, y) for y in tree.near(x) if tree.join(x, y)]
            tree.add(x)
        if one != other:
            for x in prints[at == other].tolist():
                links += [(x, y) for y in tree.near(x) if tree.join(x, y)]
        found = _signed(links)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return rows


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) of distinct fingerprints (column ``print``): enough links to hold every component together."""
    if not 0 <= radius <= len(_BLOCKS) - _KEPT:
        raise ValueError(f"the blocks find radii up to {len(_BLOCKS) - _KEPT}")
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks())))
    sharded = prints.select("print", F.explode(keys).alias("shard"))
    found = land(
        sharded.repartition("shard")
        .sortWithinPartitions("shard", "print")
        .mapInArrow(_shards(radius, shard_rows), "kind int, shard long, a long, b long")
    )
    small = found.where(F.col("kind") == _LINKED).select("a", "b")
    large = found.where(F.col("kind") == _MEMBER).select("shard", F.col("a").alias("print"), F.col("b").alias("piece"))
    ends = large.groupBy("shard").agg(F.max("piece").alias("last"))
    # piece i meets every piece j once, as (i, j) with i <= j
    meetings = large.join(ends, "shard").select(
        "shard", "print", "piece", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    )
    met = meetings.groupBy("shard", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"))
    return small.union(met.applyInPandas(_pieces(radius), "a long, b long")).distinct()


def fingerprint_components(rows: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(print, component_id, component) of every fingerprint in ``rows`` (doc_id, print), which is read twice.

    ``component`` is the smallest fingerprint linked: two components may share a ``component_id`` if an id has several texts.
    """
    prints = land(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(prints.select("print"), radius, shard_rows))
    placed = prints.join(parts.withColumnRenamed("node", "print"), "print", "left")
    linked = placed.where("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    return (
        placed.where("component IS NULL")
        .select("print", F.col("least").alias("component_id"), F.col("print").alias("component"))
        .union(linked.join(least, "component").select("print", "component_id", "component"))
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, print, component_id), one row per row of ``docs``."""
    rows = land(texts_of(docs, id_col, text_col).select("doc_id", fingerprint("text").alias("print")))
    return rows.join(fingerprint_components(rows, radius, shard_rows), "print").select("doc_id", "print", "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The row of the smallest id of each component, with all its columns.

    Of several texts of that id in the component the one that hashes least stays, once. Rows without an id stay.
    """
    key = F.xxhash64(text_col)
    rows = land(texts_of(docs, id_col, text_col).select("doc_id", fingerprint("text").alias("print"), F.xxhash64("text").alias("text_key")))
    placed = rows.where("doc_id IS NOT NULL").join(fingerprint_components(rows, radius, shard_rows), "print")
    chosen = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select(
        F.col("first.doc_id").alias("_sh_id"), F.col("first.text_key").alias("_sh_key")
    )
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(chosen, (F.col(id_col) == F.col("_sh_id")) & (key == F.col("_sh_key")), "left_semi")
    once = kept.withColumn("_sh_key", key).dropDuplicates([id_col, "_sh_key"]).drop("_sh_key")
    return once.union(docs.where(F.col(id_col).isNull()))
