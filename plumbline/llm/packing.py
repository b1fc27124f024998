"""Packing along a space-filling curve.

Documents are tokenised, projected to a few dimensions (the mean of fixed random vectors of their ids),
and sorted by the Hilbert key of that point, so that neighbours on the curve are alike. Along the curve
all ids, each document's closed by an end id, run into sequences of ``LENGTH`` ids, documents being cut where
a sequence is full. What is left at the end of a task's stretch of the curve becomes sequences whose
lengths are powers of two, so nothing is padded.

Ties of the key are broken by doc_id and text hash: a group of copies is a range like any other and is
divided among tasks. A null or empty text is its end id alone. Repeated rows are packed as often as they
occur. Columns other than id and text are not read. No rows, no pieces.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import land, texts_of

LENGTH = 1024
END_ID = 0
DIMS = 4
BITS = 10


def byte_level_ranks(tokenizer: dict) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE in the tokenizer file format, whose ids follow its merges."""
    model = tokenizer["model"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"] for t in tokenizer.get("added_tokens", ()) if t.get("special")}
    ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"]["".join(m)] for m in merged]
    if order != sorted(order):
        raise ValueError("ids that don't follow the order of the merges")
    return ranks


def added_ids(tokenizer: dict) -> dict[str, int]:
    """Added tokens of a tokenizer file and their ids; they are found in a text before it is split and merged."""
    added = tokenizer.get("added_tokens", ())
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is beside them")
    return {t["content"]: t["id"] for t in added}


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits (one point per row)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the coarsest on
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swapped = (x[0] ^ x[i]) & low
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swapped)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swapped)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flips = np.where(x[-1] & q, flips ^ (q - 1), flips)
        q >>= 1
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level & 1)
    return key


def projection(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """A fixed random vector for every id."""
    return np.random.default_rng(20).normal(size=(vocabulary, dims)).astype(np.float32)


def curve_places(ids: list[np.ndarray], vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents; one without ids lies in the middle."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    sums = np.zeros((len(ids), vectors.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        sums[some] = np.add.reduceat(vectors[np.concatenate([ids[i] for i in some])], starts, axis=0)
    mean = sums / np.maximum(counts, 1)[:, None]
    # means of texts differ little: spread them before cutting the range into cells
    cells = ((np.tanh(4 * mean) + 1) / 2 * (1 << bits)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)


class Tokens:
    """Ids of whole texts: those of added tokens, and of the stretches between them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added
        # where several begin, the longest is taken
        self.ends = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def ids(self, text: str | None) -> np.ndarray:
        text, encode = text or "", self.encoding.encode_ordinary
        if not any(t in text for t in self.added):
            return np.array(encode(text), np.uint32)
        ids = []
        for i, part in enumerate(self.ends.split(text)):
            ids += [self.added[part]] if i % 2 else encode(part)
        return np.array(ids, np.uint32)


_tokens: dict[int, Tokens] = {}


def tokenise(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """(doc_id, text_key, place, ids) with ids as little-endian 16- or 32-bit integers, as the vocabulary needs."""
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    tokenizer = json.loads(data)
    ranks, added = byte_level_ranks(tokenizer), added_ids(tokenizer)
    shipped = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary: a few megabytes at most
    stamp, vocabulary = zlib.crc32(data), max(*ranks.values(), *added.values()) + 1
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def rows(batches):
        if stamp not in _tokens:
            _tokens.clear()
            _tokens[stamp] = Tokens(byte_level_ranks(json.loads(shipped.value)), pattern, added)
        coder, vectors = _tokens[stamp], projection(vocabulary)
        for batch in batches:
            ids = [coder.ids(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(curve_places(ids, vectors)),
                    pa.array([i.astype(kind).tobytes() for i in ids], pa.binary()),
                ],
                ["doc_id", "text_key", "place", "ids"],
            )

    schema = "doc_id long, text_key long, place long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        rows, schema
    ), kind


def _pack(kind: str, length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def rows(batches):
        # a task's sequences are numbered from its own place on the curve
        sequence = TaskContext.get().partitionId() << 40
        used = 0
        tail: list[tuple] = []  # pieces of the sequence that is not yet full

        def table(pieces):
            columns = list(zip(*pieces)) if pieces else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def piece(doc, start, part, total, sequence, offset):
            data = part.tobytes()
            return doc, start, len(part), zlib.crc32(data), total, sequence, offset, data

        for batch in batches:
            done = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.append(np.frombuffer(raw, kind), END_ID).astype("<u4")
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - used]
                    tail.append(piece(doc, start, part, len(ids), sequence, used))
                    start += len(part)
                    used += len(part)
                    if used == length:
                        done += tail
                        tail, used, sequence = [], 0, sequence + 1
            if done:
                yield table(done)
        if not tail:
            return
        # the rest, cut into sequences of falling powers of two
        rest, room, at = [], 1 << (used.bit_length() - 1), 0
        left = used - room
        for doc, start, _, _, total, _, _, data in tail:
            ids = np.frombuffer(data, "<u4")
            while len(ids):
                part, ids = ids[: room - at], ids[room - at :]
                rest.append(piece(doc, start, part, total, sequence, at))
                start += len(part)
                at += len(part)
                if at == room:
                    sequence, at = sequence + 1, 0
                    room = 1 << (left.bit_length() - 1) if left else 0
                    left -= room
        yield table(rest)

    return rows


def pack(
    docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece as little-endian 32-bit integers.
    """
    tokens, kind = tokenise(texts_of(docs, id_col, text_col), tokenizer_path, pattern)
    along = land(tokens).repartitionByRange("place", "doc_id", "text_key").sortWithinPartitions("place", "doc_id", "text_key")
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return along.select("doc_id", "ids").mapInArrow(_pack(kind, length), schema)
