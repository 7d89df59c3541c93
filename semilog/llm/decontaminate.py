"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A benchmark item of n words is looked for in windows of n words. Windows and items are fingerprinted by SimHash over
their word shingles (running sums make a window cost two subtractions). Four blocks of 16 bits index the items'
fingerprints: two fingerprints within ``RADIUS`` bits agree in some block up to ``RADIUS // 4`` bits, so probing each
block with all masks of that weight misses none. Candidates within the radius are verified by the exact weighted
Jaccard similarity of their shingles, each weighted by how often it occurs.

Only windows that share a shingle with an item of their size are fingerprinted. A window without a shared shingle
has similarity 0, so nothing is lost, and texts without any are done after one dictionary look-up per word.

A window of similarity 0.8 or more that is over ``RADIUS`` bits away is missed. Of 12,000 edited passages of 30 to 200
words (sf0.1) with a similarity of 0.8 or more, 3 were over 19 bits away, and 74 over 15.

Words are runs of word characters in lower case, so case and punctuation don't hide a passage. Items with fewer
words than a shingle are one shingle; an item longer than a document meets the whole document.

The benchmark goes to the tasks in parts of at most ``PART_CHARS`` characters, one pass over the documents for each
part, so what is broadcast is bounded at any size of the benchmark.

Defined results: a null or empty text matches nothing, and an item without words is skipped; for each document and
item the most similar window is told (ties: fewest differing bits, then the first); repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm.common import remembered, texts_of, unused, with_arrow

SHINGLE, SIMILARITY, RADIUS, BLOCKS, SEED = 5, 0.8, 19, 4, 42
PART_CHARS = 8_000_000
WORD = re.compile(r"\w+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 200_000
#: Windows of a text that are fingerprinted together; bounds memory for very long texts.
WINDOWS_AT_ONCE = 4096
MATCH = "item_id long, start_char long, end_char long, start_word long, n_words long, differing_bits int, similarity double"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def shingles(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def bits_of(parts: list[str]) -> np.ndarray:
    """One row of 64 votes (0 or 1) for each shingle."""
    hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], ">u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(votes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` shingles."""
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0, dtype=np.int32)])
    set_ = 2 * (sums[size:] - sums[:-size]) > size
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class HammingIndex:
    """Fingerprints found by any block that differs in few bits."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, width = fps, radius, 64 // BLOCKS
        self.masks = np.array([sum(1 << b for b in c) for n in range(radius // BLOCKS + 1) for c in combinations(range(width), n)], np.uint64)
        self.shifts = [np.uint64(width * i) for i in range(BLOCKS)]
        self.low = np.uint64((1 << width) - 1)
        self.tables = []
        for shift in self.shifts:
            key = ((fps >> shift) & self.low).astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << width) + 1))))

    def near(self, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, indexed, differing bits) of all pairs within the radius."""
        found = set()
        for shift, (order, edges) in zip(self.shifts, self.tables):
            key, back = np.unique((queries >> shift) & self.low, return_inverse=True)
            probes = (key[:, None] ^ self.masks[None, :]).astype(np.int64)
            who, mask = np.nonzero(edges[probes + 1] > edges[probes])
            of_key: dict[int, list[np.ndarray]] = {}
            for k, m in zip(who.tolist(), mask.tolist()):
                p = probes[k, m]
                of_key.setdefault(k, []).append(order[edges[p] : edges[p + 1]])
            hits = {k: np.concatenate(v) for k, v in of_key.items()}
            for q, k in enumerate(back.ravel().tolist()):
                if k in hits:
                    found.update((q, int(i)) for i in hits[k])
        if not found:
            return []
        q, i = np.array(sorted(found)).T
        apart = np.bitwise_count(queries[q] ^ self.fps[i])
        ok = apart <= self.radius
        return list(zip(q[ok].tolist(), i[ok].tolist(), apart[ok].tolist()))


class Benchmark:
    """A part of the benchmark, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.shingle, self.similarity = shingle, similarity
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.sizes = np.array([len(w) for _, w in split], np.int64)
        self.mark = uuid.uuid4().hex  # vocabularies of other parts number words differently
        self.number = {w: n + 1 for n, w in enumerate(sorted({w for _, own in split for w in own}))}
        self.counts = [Counter(shingles(w, self.k(len(w)))) for _, w in split]
        by_size: dict[int, list[int]] = {}
        for at, n in enumerate(self.sizes.tolist()):
            by_size.setdefault(n, []).append(at)
        fps = {at: fingerprints(v := bits_of(shingles(w, self.k(len(w)))), len(v))[0] for at, (_, w) in enumerate(split)}
        self.by_size = {n: (np.array(own), HammingIndex(np.array([fps[a] for a in own], np.uint64), radius)) for n, own in by_size.items()}
        # Keys of all shingles by their length, each with the sizes of the items that have it.
        keys: dict[int, dict[int, set[int]]] = {}
        for _, w in split:
            k = self.k(len(w))
            for key in self.rolled(np.array([self.number[x] for x in w], np.uint64), k).tolist():
                keys.setdefault(k, {}).setdefault(key, set()).add(len(w))
        self.keys = {k: (np.array(sorted(own), np.uint64), own) for k, own in keys.items()}

    def k(self, n: int) -> int:
        return min(self.shingle, n)

    @staticmethod
    def rolled(numbers: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(max(0, len(numbers) - k + 1), np.uint64)
        for i in range(k):
            out = out * FACTOR + numbers[i : i + len(out)]
        return out

    def numbers(self, raw: list[str]) -> np.ndarray:
        """Each word's number in the benchmark's vocabulary; 0 for others."""
        known = remembered(f"decontaminate {self.mark}")
        if len(known) > CACHE_WORDS:
            known.clear()
        got = list(map(known.get, raw))
        if None in got:
            for i, n in enumerate(got):
                if n is None:
                    got[i] = known[raw[i]] = self.number.get(raw[i].lower(), 0)
        return np.array(got, np.uint64)

    def hits(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, shingle length, size of an item) for every shingle that the text shares with items."""
        out = []
        for k, (sorted_keys, sizes) in self.keys.items():
            full = numbers != 0
            if len(numbers) < k:
                continue
            run = full[: len(full) - k + 1].copy()
            for i in range(1, k):
                run &= full[i : i + len(run)]
            places = np.flatnonzero(run)
            if not len(places):
                continue
            key = np.zeros(len(places), np.uint64)
            for i in range(k):
                key = key * FACTOR + numbers[places + i]
            at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
            for j in np.flatnonzero(sorted_keys[at] == key).tolist():
                out += [(int(places[j]), k, n) for n in sizes[int(key[j])]]
        return out

    def matches(self, text: str) -> list[tuple]:
        """Best verified window of each item in one text, as in ``MATCH``."""
        raw = WORD.findall(text)
        hits = self.hits(self.numbers(raw)) if raw else []
        if not hits:
            return []
        words = [w.lower() for w in raw]
        wanted: dict[int, list[int]] = {}
        for place, _, n in hits:
            wanted.setdefault(n, []).append(place)
        best: dict[int, tuple] = {}
        for n, places in wanted.items():
            k, size = self.k(n), min(n, len(words))
            if size < k:
                continue
            last = len(words) - size
            reach = np.zeros(last + 2, np.int64)  # windows that hold a shared shingle
            lo = np.clip(np.array(places) + k - size, 0, last)
            hi = np.clip(np.array(places), 0, last)
            np.add.at(reach, lo, 1)
            np.add.at(reach, hi + 1, -1)
            inside = np.cumsum(reach[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
            own, index = self.by_size[n]
            runs = [(at, min(at + WINDOWS_AT_ONCE, b)) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) for at in range(a, b, WINDOWS_AT_ONCE)]
            for a, b in runs:
                parts = shingles(words[a : b - 1 + size], k)
                m = size - k + 1
                for q, i, apart in index.near(fingerprints(bits_of(parts), m)):
                    item = int(own[i])
                    if item in best and best[item][0][:2] == (-1.0, 0):
                        continue  # windows come in order, so none can be better
                    s = weighted_similarity(Counter(parts[q : q + m]), self.counts[item])
                    if s >= self.similarity:
                        rank = (-s, apart, a + q)
                        if item not in best or rank < best[item][0]:
                            best[item] = (rank, size)
        if not best:
            return []
        spots = [m.span() for m in WORD.finditer(text)]
        return [(self.ids[i], spots[start][0], spots[start + n - 1][1], start, n, apart, -s) for i, ((s, apart, start), n) in sorted(best.items())]


def parts_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_chars: int = PART_CHARS):
    """The benchmark in lists of (id, text), each of about ``part_chars`` characters or one item."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = int(total // part_chars) + 1
    for part in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == part).select(F.col(id_col).cast("long"), text).collect()
        yield [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, part_chars: int = PART_CHARS) -> DataFrame:
    """(id, item and the rest of ``MATCH``) for every document and item that are alike."""
    spark, found = docs.sparkSession, None
    item = T.StructType.fromDDL(MATCH)
    arrow = pa.list_(pa.struct([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()]) for f in item.fields]))
    names = [f.name for f in item.fields]
    for items in parts_of(benchmark, text_col=text_col, part_chars=part_chars):
        shared = spark.sparkContext.broadcast(Benchmark(items, shingle, similarity, radius))

        def make(texts: pa.Array, shared=shared) -> list[pa.Array]:
            part = shared.value
            return [pa.array([[dict(zip(names, m)) for m in part.matches(t)] for t in texts_of(texts)], arrow)]

        narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        one = with_arrow(narrow, ["_text"], [T.StructField("m", T.ArrayType(item))], make).select(F.col("_id").alias(id_col), F.explode("m").alias("m")).select(id_col, "m.*")
        found = one if found is None else found.union(one)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose text has a benchmark item; rows stay where they are, in one pass for each part."""
    kept = docs
    for items in parts_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

        def make(texts: pa.Array, shared=shared) -> list[pa.Array]:
            part = shared.value
            return [pa.array([not part.matches(t) for t in texts_of(texts)], pa.bool_())]

        clean = unused(kept, "_clean")
        kept = with_arrow(kept, [text_col], [T.StructField(clean, T.BooleanType())], make).where(F.col(clean)).drop(clean)
    return kept


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark)
