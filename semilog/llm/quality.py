"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with a temperature.

Word vectors: every word has a sparse ternary index vector made from its hash, and its context vector is the sum of
the index vectors of the words around it, over all documents. Words are hashed to ``BUCKETS`` buckets, so the table
of vectors has one size (``BUCKETS`` x ``WIDTH``) at any input; tasks add up integers, and their tables are summed
by block of buckets as streams. Each token counts as two words: its letters, and its shape (case, punctuation,
length, repetition), as junk shows in either.

The network is fitted on the driver on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id;
only rows whose crc32(id as text) mod 3 is not 1 are learned from, and a fifth of them sets the temperature. Inputs
of a score are the text's words alone.

Defined results: a null text is the empty text; it has the zero vector and gets a score too; repeated rows get equal
scores; an empty table gives an empty table; without labels of both kinds every score is the smoothed share of label
1; other columns stay, and a column named like an output is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm.boost import sigmoid
from semilog.llm.common import give_back, remembered, slices, texts_of, unused, with_arrow

BUCKETS, WIDTH, NONZERO, REACH, BLOCK = 1 << 14, 64, 2, 2, 256
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 40, 5
SHAPES = 256
#: Tasks whose tables are summed in the first round.
TOGETHER = 64
CACHE_TOKENS = 200_000
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_pair(token: str) -> int:
    """The two words of a token in one number: bucket of its letters, and shape."""
    core = token.strip(MARKS)
    tail = token[len(token.rstrip(MARKS)) :] if core else token
    case = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() else 3
    marks = 0 if not tail else 1 if tail in (".", ",") else 2 + zlib.crc32(tail[-2:].encode()) % 13
    size = 0 if len(core) < 2 else 1 if len(core) < 6 else 2 if len(core) < 14 else 3
    letters = SHAPES + zlib.crc32(core.lower().encode()) % (BUCKETS - SHAPES)
    return letters * SHAPES + (marks * 4 + case) * 4 + size


def pairs_of(text: str, known: dict[str, int]) -> np.ndarray:
    """The word pairs of a text's tokens; ``known`` remembers those of short tokens."""
    tokens = text.split()
    got = list(map(known.get, tokens))
    if None in got:
        if len(known) > CACHE_TOKENS:
            known.clear()
        for i, pair in enumerate(got):
            if pair is None:
                got[i] = word_pair(tokens[i])
                if len(tokens[i]) <= 64:
                    known[tokens[i]] = got[i]
    return np.array(got, np.int64)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters' bucket and shape of every token of all texts, and the number of tokens of each text."""
    known = remembered("quality")
    rows = [pairs_of(text, known) for text in texts]
    counts = np.array([len(r) for r in rows], np.int64)
    pairs = np.concatenate(rows) if rows else np.empty(0, np.int64)
    letters, shape = pairs // SHAPES, pairs % SHAPES
    shape[1:][pairs[1:] == pairs[:-1]] = SHAPES - 1  # the token before, again
    return letters, shape, counts


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector, from a fixed generator."""
    r = np.random.default_rng(SEED)
    places = np.stack([r.integers(i * WIDTH // NONZERO, (i + 1) * WIDTH // NONZERO, BUCKETS) for i in range(NONZERO)], 1)
    return places, r.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def contexts(texts: list[str]) -> np.ndarray:
    """Sums of index vectors around each bucket's words, as integers, with the number of words in a last column."""
    letters, shape, counts = words_of(texts)
    places, signs = index_vectors()
    out = np.zeros(BUCKETS * WIDTH, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    for d in range(1, REACH + 1):
        same = np.flatnonzero(doc[d:] == doc[:-d])
        for a, b in ((same, same + d), (same + d, same)):
            at, sign = [], []
            for mine, theirs in ((letters, letters), (letters, shape), (shape, shape)):
                row, seen = mine[a] * WIDTH, theirs[b]
                for j in range(NONZERO):
                    at.append(row + places[seen, j])
                    sign.append(signs[seen, j])
            out += np.bincount(np.concatenate(at), np.concatenate(sign), BUCKETS * WIDTH).astype(np.int64)
    n = np.bincount(letters, minlength=BUCKETS) + np.bincount(shape, minlength=BUCKETS)
    return np.concatenate([out.reshape(BUCKETS, WIDTH), n[:, None]], 1)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors from all texts: (BUCKETS, WIDTH), whatever the input's size.

    Tables of ``TOGETHER`` tasks are summed for each block of buckets, and these sums again; every sum is a stream that
    holds one table at most.
    """
    schema = "block int, part int, body binary"

    def packed(tables: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        bodies = pa.array([t.astype("<i8").tobytes() for t in tables.values()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([part] * len(tables), pa.int32()), bodies], names=["block", "part", "body"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for run in slices(batch):
                part = contexts(texts_of(run.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield packed(dict(enumerate(total.reshape(-1, BLOCK, WIDTH + 1))), TaskContext.get().partitionId() // TOGETHER)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                part = np.frombuffer(body, "<i8")
                sums[block] = sums[block] + part if block in sums else part
        yield packed(sums, 0)

    tables = docs.select(text_col).mapInArrow(gather, schema)
    sums = tables.repartition("block", "part").mapInArrow(add, schema)
    blocks = sums.repartition(8, "block").mapInArrow(add, schema).select("block", "body").collect()
    table = np.zeros((BUCKETS // BLOCK, BLOCK, WIDTH + 1), np.int64)
    for block, body in blocks:
        table[block] += np.frombuffer(body, "<i8").reshape(BLOCK, WIDTH + 1)
    table = table.reshape(BUCKETS, WIDTH + 1)
    sums, n = table[:, :WIDTH].astype(float), table[:, WIDTH:].astype(float)
    seen = n[:, 0] > 0
    if seen.any():  # what all words share says nothing about one of them
        sums -= n * (sums.sum(0) / n.sum())
    length = np.sqrt((sums**2).sum(1, keepdims=True))
    vectors = np.where(length > 0, sums / np.maximum(length, 1e-9), 0) * (n / (n + 5))
    places, signs = index_vectors()
    for j in range(NONZERO):  # a word is also its own context
        vectors[np.arange(BUCKETS), places[:, j]] += signs[:, j] * np.where(seen, 0.5, 0.0)
    return vectors.astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """One row per text: the mean vectors of its letters and of its shapes, and the log of its number of tokens."""
    letters, shape, counts = words_of(texts)
    out = np.zeros((len(texts), 2 * WIDTH + 1), np.float32)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        if a < b:
            own, n = np.unique(letters[a:b], return_counts=True)
            out[i, :WIDTH] = n.astype(np.float32) @ vectors[own] / (b - a)
            n = np.bincount(shape[a:b], minlength=SHAPES).astype(np.float32)
            out[i, WIDTH:-1] = n @ vectors[:SHAPES] / (b - a)
            out[i, -1] = np.log1p(b - a)
    return out


class Network:
    """Two layers (tanh, then one logit) with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        r = np.random.default_rng(SEED)
        z = self.scaled(x)
        d = x.shape[1]
        self.w = [r.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        learn = np.flatnonzero(~held)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            for part in np.array_split(r.permutation(learn), max(1, len(learn) // 128)):
                h = np.tanh(z[part] @ self.w[0] + self.w[1])
                error = (sigmoid(h @ self.w[2] + self.w[3]) - y[part]) / len(part)
                back = np.outer(error, self.w[2]) * (1 - h**2)
                grads = [z[part].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        logits, target = self.logits(x[held]), y[held]
        loss = lambda t: -np.mean(np.where(target > 0, np.log(sigmoid(logits / t) + 1e-12), np.log(1 - sigmoid(logits / t) + 1e-12)))
        self.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss) if held.any() else 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def held_out(c: str):
    """Rows that nothing is learned from: crc32 of the id as text, mod 3, is 1. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE):
    """A network from at most ``sample`` labelled documents that aren't held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.avg(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    # The limit bounds the broadcast side to ``sample`` rows of two numbers.
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([row.astype("<f4").tobytes() for row in pooled(texts_of(column), vectors)], pa.binary())]

    rows = with_arrow(texts, ["text"], [T.StructField("pooled", T.BinaryType())], make).select(id_col, "label", "pooled").groupBy(id_col).agg(F.first("label"), F.min("pooled")).collect()
    rows.sort(key=lambda r: r[0])
    y = np.array([float(r[1] >= 0.5) for r in rows])
    if len(set(y.tolist())) < 2:
        return Constant((y.sum() + 1) / (len(y) + 2))
    x = np.stack([np.frombuffer(r[2], "<f4") for r in rows]).astype(float)
    held = np.array([zlib.crc32(f"t{r[0]}".encode()) % 5 == 0 for r in rows])
    return Network(x, y, held)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the calibrated probability that ``label_col`` is 1."""
    vectors = word_vectors(docs, text_col)
    model = train(docs, labels, vectors, id_col, text_col, label_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def make(texts: pa.Array) -> list[pa.Array]:
        table, fitted = shared.value
        return [pa.array(fitted.scores(pooled(texts_of(texts), table).astype(float)), pa.float64())]

    return with_arrow(docs, [text_col], [T.StructField(out, T.DoubleType())], make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    made = score(docs.select("doc_id", "text"), labels)
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score below ``least``."""
    name = unused(docs, "score")
    return score(docs, labels, out=name).where(F.col(name) >= least).drop(name)
