"""Byte-level BPE encoding and decoding.

Encoding: the merges are compiled into a transducer over bytes. A state of the nondeterministic
machine is a pair (token emitted last, node of the vocabulary's byte trie); it may emit the token of
its node and start anew at the root if that token may follow the one emitted last, that is, if the
merges cut the two tokens' joint bytes just there. A cut of a text is the one that the merges make if and
only if all its neighbours fit, so exactly one run ends at the root. The machine is determinised
lazily: a state of the result is the set of live runs with the output each still owes, what all of them
owe alike is emitted at once, and states and arcs are made when a text first needs them. Runs that lead to
no token die, so an output waits for a bounded number of further bytes.

A piece that is a token as a whole is that token. Null and empty texts have no ids. Decoding looks up
the bytes of ids one by one; ``Utf8Stream`` turns them into text as they come, keeping the unfinished
character between calls.

Ids that no token has are refused with an error. Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts_of

# Pieces whose ids a worker remembers, and determinised states it keeps; both start anew when full.
KNOWN_PIECES = 100_000
KNOWN_LENGTH = 64
KNOWN_STATES = 200_000
KNOWN_FITS = 400_000
# Ids decoded at a step.
STEP = 4096
MARKS = tuple(".,;:!?")
# A trie node with so few tokens from it on is looked through for one that may follow.
FEW = 4


NEVER = 1 << 62
RUNS, END = -1, -2


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and a number on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges by their definition: the lowest-ranked neighbours first, leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NEVER))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """Merges as a lazily determinised finite-state transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # the vocabulary's trie: children by byte, the token that ends at a node, and the tokens from
        # there on if they are few
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.few: list[tuple[int, ...] | None] = [None]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.children[node].get(byte)
                if following is None:
                    following = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                    self.few.append(())
                node = following
                if self.few[node] is not None:
                    self.few[node] = (*self.few[node], rank) if len(self.few[node]) < FEW else None
            self.token[node] = rank
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.fits: dict[int, bool] = {}  # by both tokens
        self._reset()

    def _reset(self) -> None:
        if len(self.fits) > KNOWN_FITS:
            self.fits.clear()
        # a state is a table: by byte the next state and what is emitted; its runs; what ends it, if it may
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((-1, 0, ()),))

    def _state(self, runs: tuple) -> dict:
        state = self.states.get(runs)
        if state is None:
            done = [owed for _, node, owed in runs if node == 0]
            state = self.states[runs] = {RUNS: runs, END: done[0] if done else None}
        return state

    def _spine(self, token: int) -> tuple[list, list] | None:
        """While the merges make this token: what stood at its left end, and at its right end, each with
        the rank of the merge that ended it. None if the merges don't make it."""
        known = self.spines.get(token, ())
        if known == ():
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            lefts, rights = [], []
            while len(parts) > 1:
                rank, best = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                if best == 0:
                    lefts.append((parts[0], rank))
                if best == len(parts) - 2:
                    rights.append((parts[-1], rank))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = ([*lefts, (piece, NEVER)], [*rights, (piece, NEVER)]) if len(parts) == 1 else None
            self.spines[token] = known
        return known

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the merges make this token, and right after the last one (-1: at the start).

        They do unless, while both are being made, what stands at the right end of the one and at the
        left end of the other merges before either does so on its own side. Equal ranks go left to right.
        """
        both = last << 32 | token
        known = self.fits.get(both)
        if known is not None:
            return known
        spine = self._spine(token)
        if last < 0 or spine is None:
            known = spine is not None
        else:
            lefts, rights = spine[0], self._spine(last)[1]
            i = j = 0
            while True:
                (one, one_ends), (two, two_ends) = rights[i], lefts[j]
                across = self.ranks.get(one + two, NEVER)
                if across < one_ends and across <= two_ends:
                    known = False
                    break
                if one_ends == two_ends == NEVER:
                    known = True
                    break
                if one_ends <= two_ends:
                    i += 1
                else:
                    j += 1
        self.fits[both] = known
        return known

    def _alive(self, last: int, node: int) -> bool:
        """False if no token from this node on may follow the last one; runs with many ways on count as alive."""
        few = self.few[node]
        if few is None:
            return True
        own, fits, last_bits = self.token[node], self.fits, last << 32
        for token in few:
            if token != own:
                known = fits.get(last_bits | token)
                if known or (known is None and self._may_follow(last, token)):
                    return True
        return False

    def _arc(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        runs = []
        children, tokens, fits = self.children, self.token, self.fits
        for last, node, owed in state[RUNS]:
            following = children[node].get(byte)
            if following is None:
                continue
            if children[following] and self._alive(last, following):
                runs.append((last, following, owed))
            token = tokens[following]
            if token >= 0:
                known = fits.get(last << 32 | token)
                if known or (known is None and self._may_follow(last, token)):
                    runs.append((token, 0, (*owed, token)))
        if not runs:
            raise ValueError("bytes that no tokens cover")
        emitted = runs[0][2]
        for _, _, owed in runs:
            if not emitted or not owed or owed[0] != emitted[0]:
                emitted = ()
                break
            shared = 1
            while shared < len(emitted) and shared < len(owed) and owed[shared] == emitted[shared]:
                shared += 1
            emitted = emitted[:shared]
        if emitted:
            runs = [(last, node, owed[len(emitted) :]) for last, node, owed in runs]
        runs.sort()
        arc = state[byte] = self._state(tuple(runs)), emitted
        return arc

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > KNOWN_STATES:
            self._reset()
        state, out = self.start, []
        for byte in piece:
            state, emitted = state.get(byte) or self._arc(state, byte)
            if emitted:
                out += emitted
        final = state[END]
        if final is None:
            raise ValueError("bytes that no tokens cover")
        return (*out, *final)


class Utf8Stream:
    """Decodes bytes that arrive in any cuts: the unfinished character waits for its rest.

    The state is the number of bytes still due and the range the next one must lie in. Ill-formed bytes
    come out as U+FFFD, one for each longest beginning of a character, or raise if ``strict``.
    """

    def __init__(self, strict: bool = False):
        self.strict = strict
        self.held = b""
        self.due, self.low, self.high = 0, 0x80, 0xBF

    def _bad(self) -> str:
        if self.strict:
            raise ValueError("bytes that are not UTF-8")
        return "�"

    def _lead(self, byte: int) -> str:
        self.low, self.high = 0x80, 0xBF
        if byte < 0x80:
            return chr(byte)
        if 0xC2 <= byte <= 0xDF:
            self.due = 1
        elif 0xE0 <= byte <= 0xEF:
            self.due = 2
            self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
        elif 0xF0 <= byte <= 0xF4:
            self.due = 3
            self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
        else:
            return self._bad()
        self.held = bytes([byte])
        return ""

    def feed(self, data: bytes) -> str:
        if self.due or not data:
            return self._steps(data)
        # whole characters at once; the machine takes the end that may be unfinished, or all if ill-formed
        cut = len(data)
        while cut and len(data) - cut < 3 and data[cut - 1] & 0xC0 == 0x80:
            cut -= 1
        if cut and data[cut - 1] >= 0xC0:
            cut -= 1
        elif cut and data[cut - 1] < 0x80:
            cut = len(data)
        try:
            whole = data[:cut].decode("utf-8")
        except UnicodeDecodeError:
            return self._steps(data)
        return whole + self._steps(data[cut:])

    def _steps(self, data: bytes) -> str:
        out = []
        for byte in data:
            if not self.due:
                out.append(self._lead(byte))
            elif self.low <= byte <= self.high:
                self.held += bytes([byte])
                self.due -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.due:
                    out.append(self.held.decode("utf-8"))
                    self.held = b""
            else:
                self.due, self.held = 0, b""
                out.append(self._bad())
                out.append(self._lead(byte))
        return "".join(out)

    def close(self) -> str:
        rest = self._bad() if self.due else ""
        self.due, self.held = 0, b""
        return rest


# A space before a non-space: no piece of the usual patterns (a space at most, then letters, digits or
# other marks; runs of white space up to their last character) reaches over it, except by starting there.
_GAP = re.compile(r" (?=\S)")


class TokenBytes:
    """The bytes of all tokens, laid end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("ids without a token")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class Recent(dict):
    """What was looked up lately: at most two generations of ``KNOWN_PIECES`` entries.

    When the young generation is full it becomes the old one, and what is asked for again moves back.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_PIECES:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Ids of whole texts: each piece of the pattern goes through the transducer.

    The ids of a stretch from gap to gap are remembered while room lasts. ``gaps=False`` is for patterns
    whose pieces may reach over a gap.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, gaps: bool = True):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.gaps = gaps
        self.letters = self.pattern.findall(" naïve, a.") == [" naïve", ",", " a", "."]
        self.pieces = Recent(self._piece)
        self.stretches = Recent(self._after_space)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode("utf-8"))).tobytes()

    def _after_space(self, stretch: str) -> bytes:
        # letters alone, or with one mark behind them, need no pattern to be taken apart, and are remembered once
        if self.letters:
            if stretch.isalpha():
                return self._piece(" " + stretch)
            if stretch[-1:] in MARKS and stretch[:-1].isalpha():
                return self.stretches[stretch[:-1]] + self.pieces[stretch[-1]]
        return self._ids(" " + stretch)

    def _ids(self, stretch: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(stretch)))

    def encode(self, text: str | None) -> bytes:
        """Ids as 32-bit integers of this machine."""
        if not text:
            return b""
        if not self.gaps:
            return self._ids(text)
        first, *rest = _GAP.split(text)
        return b"".join([self._ids(first), *map(self.stretches.__getitem__, rest)])


_coders: dict[tuple, object] = {}


def _kept(key: tuple, make):
    """What a worker keeps from task to task; one of a kind."""
    if key not in _coders:
        for old in [k for k in _coders if k[0] == key[0]]:
            del _coders[old]
        _coders[key] = make()
    return _coders[key]


def _arrays(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, in ids of the rank file; the file is read on the driver and shipped."""
    with open(ranks_path, "rb") as f:
        data = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary: a few megabytes at most
    stamp = hashlib.sha256(data).hexdigest()

    def rows(batches):
        coder = _kept(("encode", stamp, pattern), lambda: Encoder(parse_ranks(shipped.value), pattern))
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _arrays(ids)], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(rows, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", strict: bool = False) -> DataFrame:
    """(doc_id, decoded): the text of the ids, decoded token by token as they stream in.

    Null ids decode to an empty text.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()
    shipped = rows.sparkSession.sparkContext.broadcast(data)
    stamp = hashlib.sha256(data).hexdigest()

    def texts(batches):
        table = _kept(("decode", stamp), lambda: TokenBytes(parse_ranks(shipped.value)))
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                stream, parts = Utf8Stream(strict), []
                tokens = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                for at in range(0, len(tokens), STEP):
                    parts.append(stream.feed(table.join(tokens[at : at + STEP])))
                out.append("".join([*parts, stream.close()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    chosen = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(texts, f"doc_id {kind}, decoded string")
