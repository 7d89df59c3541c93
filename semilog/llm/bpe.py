"""BPE encoding and decoding by forced-boundary splitting.

Merges never cross a byte pair that occurs inside no token of the vocabulary. Such pairs are certain cuts:
the fragments between them are encoded on their own and the results are concatenated.

* White space is in no token and the pre-tokenizer drops it, so a text is first cut there; a chunk's ids are
  remembered, as most chunks come again.
* A new chunk is normalised and pre-tokenised by the tokenizer's own rules, and each word is then cut at every
  byte pair that the vocabulary never joins.
* All new fragments of a batch are merged together in numpy: each round finds every fragment's best pair and
  merges all its occurrences, so the number of rounds follows the longest fragment and not the batch.

Defined results: a null text is the empty text and has no ids; repeated rows are encoded alike; an empty table
gives an empty table; other columns stay, and a column named like an output is replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm.common import remembered, texts_of, tokenizer_file, with_arrow

#: Chunks whose ids are remembered in a Python worker, and the longest chunk that is.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 64
#: Python's split() also splits at these four; the tokenizer's white space doesn't have them.
SEPARATORS = re.compile("[\x1c-\x1f]")
UNICODE_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder of one tokenizers file with byte-level BPE and an optional end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}

        self.plain = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b if not suffix else a.removesuffix(suffix) + b] for a, b in merges], np.int64)
        first = np.full(self.size, -1, np.int64)  # the merge that makes a token; a part must come before the whole
        for rank, token in enumerate(made.tolist()):
            if first[token] < 0:
                first[token] = rank
        parts = np.array([max(first[vocab[a]], first[vocab[b]]) for a, b in merges])
        if (parts >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before one that makes its parts")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made

        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            body = token.removesuffix(suffix) if suffix else token
            raw = [back[c] for c in body if c in back]
            self.joined[raw[:-1], raw[1:]] = True
        space = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
        if self.joined[space].any() or self.joined[:, space].any():
            raise ValueError("this vocabulary joins white space to other bytes; it has no certain cut there")

        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or normalisation aren't supported")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = self.library.pre_tokenizer[0]
        self.tokens = [""] * max(self.size, *(i + 1 for i in self.added.values()), 0)
        for token, i in (vocab | self.added).items():
            self.tokens[i] = token
        self.cache: dict[str, bytes] = remembered(f"bpe {path}")
        self.owner = f"bpe {path}"

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges, and the index of the fragment that each belongs to. starts: where fragments begin."""
        fragment = np.zeros(len(symbols), np.int64)
        fragment[starts[1:]] = 1
        fragment = np.cumsum(fragment)
        done_ids, done_fragment, none = [], [], len(self.made)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            same = fragment[:-1] == fragment[1:]
            key = (symbols[:-1] * self.size + symbols[1:])[same]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1][same] = np.where(self.keys[at] == key, self.rank[at], none)
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.append(heads, len(symbols)))
            open_ = np.repeat(best < none, counts)
            if not open_.all():
                done_ids.append(symbols[~open_])
                done_fragment.append(fragment[~open_])
            hit = (rank == np.repeat(best, counts)) & (rank < none)
            where = np.flatnonzero(hit)
            if len(where):  # in a run of overlapping pairs, every second one from the left is merged
                new_run = np.concatenate(([True], np.diff(where) > 1))
                run_start = where[new_run][np.cumsum(new_run) - 1]
                where = where[(where - run_start) % 2 == 0]
                symbols[where] = self.made[rank[where]]
                open_[where + 1] = False
            symbols, fragment = symbols[open_], fragment[open_]
        if not done_ids:
            return symbols, fragment
        ids, owner = np.concatenate(done_ids), np.concatenate(done_fragment)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space, each as little-endian 32-bit integers."""
        if not chunks:
            return []
        normal = self.library.normalizer.normalize_str(" ".join(chunks))
        normal_chunks = normal.split(" ")
        if len(normal_chunks) != len(chunks):
            raise ValueError("normalisation moved white space")
        words = self.words.pre_tokenize_str(normal)
        if not words:
            return [b""] * len(chunks)
        chunk_starts = np.cumsum([0] + [len(c) + 1 for c in normal_chunks[:-1]])
        word_chunk = np.searchsorted(chunk_starts, np.array([w[1][0] for w in words]), side="right") - 1
        raw = [w[0].encode() for w in words]
        lengths = np.array([len(w) for w in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.plain[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        cut = np.concatenate(([True], ~self.joined[data[:-1], data[1:]]))
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        ids, owner = self.merge(symbols, starts)
        fragment_chunk = np.repeat(word_chunk, lengths)[starts]
        edges = np.searchsorted(fragment_chunk[owner], np.arange(len(chunks) + 1))
        packed = ids.astype("<u4").tobytes()
        edges = (edges * 4).tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, packed as little-endian 32-bit integers."""
        if len(remembered(self.owner)) > CACHE_CHUNKS:
            self.cache.clear()
        rows, new, long_ = [], set(), {}
        find = self.cache.get
        for text in texts:
            own = self.pieces(text)
            got = list(map(find, own))
            gaps = [i for i, g in enumerate(got) if g is None] if None in got else ()
            new.update(own[i] for i in gaps)
            rows.append((own, got, gaps))
        new = list(new)
        for start in range(0, len(new), 100_000):
            part = new[start : start + 100_000]
            for chunk, ids in zip(part, self.encode_chunks(part)):
                (self.cache if len(chunk) <= CACHE_CHARS else long_)[chunk] = ids
        for own, got, gaps in rows:
            for i in gaps:
                got[i] = find(own[i]) if len(own[i]) <= CACHE_CHARS else long_[own[i]]
        return [b"".join(got) for _, got, _ in rows]

    def pieces(self, text: str) -> list[str]:
        """Chunks between white space; special tokens stand alone and are in the cache from the start."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        out, last = [], 0
        for m in self.special.finditer(text):
            out += self.split(text[last : m.start()])
            self.cache[m[0]] = np.array([self.added[m[0]]], "<u4").tobytes()
            out.append(m[0])
            last = m.end()
        return out + self.split(text[last:])

    @staticmethod
    def split(text: str) -> list[str]:
        return [c for c in UNICODE_SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()

    def decode(self, packed: bytes) -> str:
        """The text of packed ids as the library's decode() without a decoder gives it: tokens joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    """One for each file and Python worker."""
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens``."""

    def make(texts: pa.Array) -> list[pa.Array]:
        packed = tokenizer(tokenizer_file(vocabulary)).encode(texts_of(texts))
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

    return with_arrow(docs, [text_col], [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], make)


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its packed ids; null ids count as none."""

    def make(ids: pa.Array) -> list[pa.Array]:
        t = tokenizer(tokenizer_file(vocabulary))
        return [pa.array([t.decode(p or b"") for p in ids.to_pylist()], pa.string())]

    return with_arrow(encoded, [ids_col], [T.StructField("decoded", T.StringType())], make)


def round_trip(docs: DataFrame, text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``; one pass through Python instead of two."""

    def make(texts: pa.Array) -> list[pa.Array]:
        t = tokenizer(tokenizer_file(vocabulary))
        packed = t.encode(texts_of(texts))
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(t.decode, packed), pa.string())]

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    return with_arrow(docs, [text_col], fields, make)


def digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the decoded text."""
    made = round_trip(docs.select("doc_id", "text"), "text", vocabulary)
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
