"""Secret scans: patterns, then confirmation of encoded candidates by their structure.

Base kinds are found by pattern: ``assign`` (a name such as password or token, and its value),
``access`` (cloud access ids) and ``hex`` (long runs of hex digits). On top of these, every base64 or
hex run is decoded and reported only if what comes out parses: ``der`` (ASN.1 private keys, whose nested
lengths must add up), ``ssh`` (private key files of length-prefixed fields), ``pem`` (an armoured block whose body is one of
these), ``jwt`` (a signed token whose header is a JSON object that names its algorithm). Public keys and certificates are
no secrets. A base64 run is tried as a whole, joined over line ends if its lines are full ones, and from each place in it
where such a key may begin, for as long as its own length says.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and then by kind as
listed in ``KINDS``. Null and empty texts have none. Repeated rows give the same spans each; other columns
are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run either way, so short runs need not be matched
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]{32,}")
# only from where a run begins: a long run without dots is read once
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\n)+)-----END \1-----")

ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
# Lines of an encoder that wraps, and where in a run a key may begin: a sequence of 128 bytes or more.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,76}\r?\n[ \t]*)+[A-Za-z0-9+/]{1,76}={0,2}")
_BEGINS = re.compile(r"MI[GHI]")


def _decode64(run: str) -> bytes | None:
    plain = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER element at a place, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """A private key: a sequence that ends where the data ends, whose elements nest exactly.

    It holds an octet string of 16 bytes or more behind a version number or an algorithm, or five numbers or more, one
    of them long. Public keys are two numbers, or an algorithm and a bit string; certificates end with one.
    """
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or top[1] == top[2]:
        return False
    todo = [(top[1], top[2])]
    own: list[tuple[int, int]] = []  # tags and lengths of what the sequence itself holds
    while todo:
        at, end = todo.pop()
        outermost = not own
        while at < end:
            found = _element(data, at, end)
            if found is None:
                return False
            tag, start, at = found
            if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
                todo.append((start, at))
            if outermost:
                own.append((tag, at - start))
    if not own:
        return False
    secret = any(tag == 0x04 and size >= 16 for tag, size in own[1:]) and own[0][0] in (0x02, 0x30)
    numbers = [size for tag, size in own if tag == 0x02]
    return secret or (len(numbers) >= 5 and max(numbers) >= 16)


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file: length-prefixed fields to the very end. Public keys, which are fields that begin with a
    key type, are no secret."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    data = data[15:]
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if len(fields) == 3 and size < 256:  # the number of keys, not a length
            at += 4
            fields.append(b"")
            continue
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2


def is_signed_token(run: str) -> bool:
    header, _, rest = run.partition(".")
    payload = rest.partition(".")[0]
    decoded = _decode64(header)
    if decoded is None or not decoded.lstrip().startswith(b"{"):
        return False
    try:
        parsed = json.loads(decoded)
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str) and _decode64(payload) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _key_kind(data: bytes | None) -> str | None:
    return None if data is None else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _keys_within(run: str) -> list[tuple[str, int, int]]:
    """Keys that begin within a run: the header says where they must end."""
    out, end = [], 0
    for m in _BEGINS.finditer(run):
        at = m.start()
        if at < end:
            continue
        head = _decode64(run[at : at + 8]) or b""
        if len(head) < 4 or head[0] != 0x30:
            continue
        size = head[2] + 3 if head[1] == 0x81 else int.from_bytes(head[2:4], "big") + 4 if head[1] == 0x82 else 0
        stop = at + -(-size * 4 // 3)
        if size and stop <= len(run) and is_der_key(_decode64(run[at:stop]) or b""):
            out.append(("der", at, stop))
            end = stop
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _ENCODED.finditer(text):
        kind = _key_kind(_decode64(m.group()))
        if kind:
            out.append((kind, *m.span()))
        else:
            out += [(kind, m.start() + a, m.start() + b) for kind, a, b in _keys_within(m.group())]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            kind = _key_kind(_decode64(re.sub(r"\s", "", m.group())))
            if kind:
                out.append((kind, *m.span()))
    for m in _ANY_HEX.finditer(text):
        if m.end() - m.start() & 1 == 0:
            data = bytes.fromhex(m.group())
            kind = _key_kind(data)
            if kind:
                out.append((kind, *m.span()))
    out += [("jwt", *m.span()) for m in _SIGNED.finditer(text) if is_signed_token(m.group())]
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            data = _decode64(re.sub(r"\s", "", m.group(2).replace("\\n", "")))
            if _key_kind(data):
                out.append(("pem", *m.span()))
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    order = {k: i for i, k in enumerate(KINDS)}
    found = {*base_spans(text), *confirmed_spans(text)}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in texts], dtype=object)


def secret_spans(text: Column | str) -> Column:
    """All spans of a text, in order."""
    return _spans(F.col(text) if isinstance(text, str) else text)


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with ``mark`` in place of every stretch that spans cover."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    until = -1
    for _, start, end in spans:
        if start > until:
            if until >= 0:
                out.append(mark)
                at = until
            out.append(text[at:start])
        until = max(until, end)
    return "".join([*out, mark, text[until:]])


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t) for t in texts], dtype=object)


def redacted(text: Column | str) -> Column:
    """The text with its secrets masked; null stays null."""
    return _redacted(F.col(text) if isinstance(text, str) else text)
