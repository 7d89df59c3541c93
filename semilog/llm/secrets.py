"""Secret scans with structural confirmation.

Three base patterns with fixed rules are always reported. Beside them, runs of base64 or hex are decoded and
reported only if what they decode to has the structure of a secret: a DER key whose nested lengths fill their
parents exactly at every depth, an OpenSSH private key whose length-prefixed fields fit, or a signed token whose header
is JSON with an algorithm. Armoured keys (``-----BEGIN ... PRIVATE KEY-----``) are decoded over their lines, be they
broken by line feeds or by escapes, with or without headers; where a header says how the key is encrypted, the body need
only be whole blocks.

A text is first split at white space; runs that can be secrets are long, so nearly all texts need no more than that.
No pattern can walk the same characters twice.

Defined results: a null text has no spans; offsets are code points with the end exclusive; spans are ordered by
start, then kind; repeated rows give equal results; an empty table gives an empty table; other columns stay, and a
column named like an output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm.common import texts_of, with_arrow

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der_key", "openssh_key", "signed_token", "armoured_key")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The shortest run that is looked at: no structure below can be told in fewer characters, the least being a token with
#: the header {"alg":""}, the content {} and no signature.
LEAST_RUN = 19
#: A JSON object starts with a brace or white space, so its base64 with one of these letters.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[CDIe][A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+(?![A-Za-z0-9_-])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}+={0,2}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]{0,30}PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
HEX_RUN = re.compile("(?:0[xX])?((?:[0-9a-fA-F]{2})+)")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and non-overlapping."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if has_long_run(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def has_long_run(text: str) -> bool:
    return len(text) >= LEAST_RUN and max(map(len, text.split()), default=0) >= LEAST_RUN


def decoded(run: str) -> bytes | None:
    """What a run of hex (behind 0x or not) or base64 (either alphabet, padded or not) stands for."""
    try:
        if m := HEX_RUN.fullmatch(run):
            return bytes.fromhex(m[1])
        body = run.rstrip("=").translate(str.maketrans("-_", "+/"))
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end of the content) of the DER item at ``at``, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill the data from ``at`` to ``end``; None if they don't."""
    out = []
    while at < end:
        item = der_item(data, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the data, whose items fill it in turn, at every depth, and hold what keys hold.

    The items are a version and integers or an algorithm (private keys), or an algorithm and a bit string (public
    keys) or an octet string (encrypted private keys), so there is an integer or an inner sequence first, and key
    material of 16 bytes or more.
    """
    top = der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    items = der_items(data, top[1], top[2])
    if items is None or len(items) < 2 or max(e - s for _, s, e in items) < 16:
        return False
    tags = [t for t, *_ in items]
    if not set(tags) <= {0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31, 0xA0, 0xA1}:
        return False
    inner = der_items(data, items[0][1], items[0][2]) if tags[0] == 0x30 else None
    if tags[0] == 0x30:
        fits = tags[1] in (0x03, 0x04) and bool(inner) and inner[0][0] == 0x06
    else:
        fits = tags[0] == 0x02 and (set(tags) == {0x02} or 0x04 in tags)
    todo = [i for i in items if i[0] & 0x20]
    while fits and todo:  # items with items inside
        _, start, end = todo.pop()
        inner = der_items(data, start, end)
        fits = inner is not None
        todo += [i for i in inner or () if i[0] & 0x20]
    return fits


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, key derivation and options as length-prefixed fields, and a key count."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_signed_token(run: str) -> bool:
    """Three parts, the first JSON with an algorithm, the second JSON too."""
    parts = run.split(".")
    for i, part in enumerate(parts[:2]):
        try:
            value = json.loads(decoded(part) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or i == 0 and not isinstance(value.get("alg"), str):
            return False
    return len(parts) == 3


def is_armoured_key(body: str) -> bool:
    """The lines between the marks, after headers: a key, or whole cipher blocks if a header tells the cipher."""
    lines = body.replace("\\r", "\n").replace("\\n", "\n").split("\n")
    headers = [x for x in lines if ":" in x]
    data = decoded("".join("".join(x for x in lines if ":" not in x).split()))
    if not data:
        return False
    if any(x.strip().startswith("DEK-Info:") for x in headers):
        return len(data) >= 16 and len(data) % 8 == 0
    return is_der_key(data) or is_openssh_key(data)


def confirmed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure holds, without overlaps."""
    out = []
    if "-----BEGIN" in text:
        out += [(m.start(), 6, m.end()) for m in ARMOUR.finditer(text) if is_armoured_key(m[2])]
    if has_long_run(text):
        if text.count(".") >= 2:
            out += [(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
        for m in RUN.finditer(text):
            body = decoded(m[0])
            kind = body and (3 if is_der_key(body) else 4 if is_openssh_key(body) else None)
            if kind:
                out.append((m.start(), kind, m.end()))
    kept, reach = [], -1
    for span in sorted(out, key=lambda s: (s[0], -s[2])):
        if span[0] >= reach:
            kept.append(span)
            reach = span[2]
    return kept


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = confirmed(text)
    return base, sorted(base + more) if more else base


def told(own: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (arrays of kind, start, end)."""
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(texts: pa.Array) -> list[pa.Array]:
        found = [spans(t) for t in texts_of(texts)]
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in pair[i]] for pair in found], arrow) for i in (0, 1)]

    return with_arrow(docs, [text_col], [T.StructField("base_spans", T.ArrayType(item)), T.StructField("spans", T.ArrayType(item))], make)


def report(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the digest of the base spans, and all spans."""
    text_of = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(text_of("base_spans").cast("binary"), 256).alias("base_sha256"), text_of("spans").alias("spans"))
