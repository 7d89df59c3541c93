"""Near-duplicates by exact shingle similarity; SimHash links the bulk, shared rare shingles find the rest.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is ``SIMILARITY`` or more. No pair is
lost: with all shingles in one order, two sets that similar share a shingle among the first n - ceil(0.8 n) + 1 of each
(n its size). The order is rare ones first, by counts over all texts in ``CELLS`` cells; any order is right, this one
keeps buckets small.

Candidates come in two rounds: fingerprints within some bits of each other, and every text with ``STARS`` of those that
share a leading shingle with it (the least by as many orders of keys); then all pairs that share one but are not in one
component yet, so that a large group of near copies never meets itself pair by pair. In that join a pair must also stand
the test of places (behind a shared shingle at places i and j of the order, no more than n - i and m - j can be shared)
and of ``SKETCH`` parities (as many bits as differ, as many shingles at least do). Neither drops a similar pair. Every
candidate then passes the parities of its two sets at about a bit for each shingle. What is left is compared
exactly, on sets made again from the texts in question; they are dealt by the second of the pair, in parts of
``TOGETHER`` pairs, and streamed past it.

Defined results: null and empty texts are copies of each other; a text with fewer words than a shingle is one shingle;
texts of the same words are copies; rows that repeat an id stay or go together; rows without an id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm import simhash
from semilog.llm.common import give_back, materialise, slices, texts_of, with_arrow
from semilog.llm.components import smallest_reachable

SIMILARITY, SHINGLE, SEED = 0.8, 5, 42
#: Cells in which shingles are counted, cells of a block, and tasks whose counts are summed in the first round.
CELLS, BLOCK, TASKS = 1 << 18, 1 << 14, 64
#: Cells of the map of keys that are in pairs; only the sets of those are dealt out. Touches speed only.
MARKS = 1 << 23
#: Pairs with one text that a task compares.
TOGETHER = 1024
#: Orders of keys by which a text's partners are chosen in the first round, each a fixed number that keys are mixed with.
STARS = (0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D)
#: Words of 64 parities that the join of the second round compares.
SKETCH = 8
LONGS = T.ArrayType(T.LongType())


def key_of(text: str) -> int:
    """A 64-bit hash of the words; copies have one key."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.encode().lower().split()), SEED)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, SHINGLE, SEED).astype(np.uint64))


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def cell_counts(texts: DataFrame) -> np.ndarray:
    """How often shingles of each cell occur, over all texts (column ``text``), each text counting a shingle once."""
    schema = "block int, part int, body binary"

    def packed(sums: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        bodies = pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), bodies], names=["block", "part", "body"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for run in slices(batch):
                sets = [shingle_set(t) for t in texts_of(run.column(0))]
                total += np.bincount((np.concatenate(sets) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield packed(dict(enumerate(total.reshape(-1, BLOCK))), TaskContext.get().partitionId() // TASKS)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                part = np.frombuffer(body, "<i8")
                sums[block] = sums[block] + part if block in sums else part
        yield packed(sums, 0)

    first = texts.select("text").mapInArrow(gather, schema).repartition("block", "part").mapInArrow(add, schema)
    out = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for block, body in first.repartition(8, "block").mapInArrow(add, schema).select("block", "body").collect():
        out[block] += np.frombuffer(body, "<i8")
    return out.ravel()


def parity(own: np.ndarray, size: int = 0) -> bytes:
    """A bit for each of ``size`` cells (of the set's own number if 0): whether it holds an odd number of shingles."""
    size = size or 1 << max(6, (len(own) - 1).bit_length())
    counts = np.bincount((own >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Shingles that two sets don't share, at least: parities of unequal size are folded to the smaller one."""
    x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    n, m = 8 * len(a), 8 * len(b)
    if n < m:
        x, y, n, m = y, x, m, n
    while n > m:
        n >>= 1
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ y).bit_count()


def profiles(texts: DataFrame, similarity: float) -> DataFrame:
    """id, key, fp, n, parity, sketch and the leading shingles (of which two similar sets share one) of every row."""
    shared = texts.sparkSession.sparkContext.broadcast(cell_counts(texts))

    def make(column: pa.Array) -> list[pa.Array]:
        counts = shared.value
        keys, fps, sizes, parities, sketches, leading = [], [], [], [], [], []
        for t in texts_of(column):
            hashes = simhash.shingle_hashes(t, SHINGLE, SEED)
            own = np.unique(hashes.astype(np.uint64))
            keys.append(key_of(t))
            fps.append(simhash.voted(hashes) if len(hashes) else 0)
            sizes.append(len(own))
            parities.append(parity(own))
            sketches.append(np.frombuffer(parity(own, 64 * SKETCH), "<i8"))
            first = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
            leading.append(own[np.lexsort((own, counts[(own % np.uint64(CELLS)).astype(np.int64)]))[:first]].view(np.int64))
        return [signed(keys), signed(fps), pa.array(sizes, pa.int32()), pa.array(parities, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(leading, pa.list_(pa.int64()))]

    fields = [T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("parity", T.BinaryType()), T.StructField("sketch", LONGS), T.StructField("leading", LONGS)]
    return with_arrow(texts, ["text"], fields, make).drop("text")


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those distinct pairs (u, v) of keys that their sets' sizes and parities allow to be similar."""
    side = lambda k, n, p: sketches.select(F.col("key").alias(k), F.col("n").alias(n), F.col("parity").alias(p))
    fits = (F.col("n") >= similarity * F.col("m") - 1e-9) & (F.col("m") >= similarity * F.col("n") - 1e-9)
    both = pairs.where("u != v").distinct().join(side("u", "n", "p"), "u").join(side("v", "m", "q"), "v").where(fits)
    most = (1 - similarity) / (1 + similarity)

    def make(n: pa.Array, m: pa.Array, p: pa.Array, q: pa.Array) -> list[pa.Array]:
        rows = zip(n.to_pylist(), m.to_pylist(), p.to_pylist(), q.to_pylist())
        return [pa.array([apart(a, b) <= most * (x + y) + 1e-9 for x, y, a, b in rows], pa.bool_())]

    return with_arrow(both, ["n", "m", "p", "q"], [T.StructField("_ok", T.BooleanType())], make).where("_ok").select("u", "v")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those distinct pairs (u, v) of keys whose sets are similar; ``pairs`` is a written table."""
    cells = pairs.select(F.explode(F.array("u", "v")).alias("k")).select(F.pmod("k", F.lit(MARKS)).cast("int").alias("c")).distinct().toPandas()["c"]
    bits = np.zeros(MARKS, bool)
    bits[cells.to_numpy(np.int64)] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for run in slices(batch):
                plain = texts_of(run.column(0))
                keys = np.array([key_of(t) for t in plain], np.uint64)
                cell = (keys % np.uint64(MARKS)).astype(np.int64)
                used = np.flatnonzero((marks[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).tolist()
                if used:
                    made = pa.array([shingle_set(plain[i]).view(np.int64) for i in used], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[used].view(np.int64)), made], names=["key", "shingles"])
        give_back()

    used = texts.select("text").mapInArrow(sets, "key long, shingles array<bigint>").groupBy("key").agg(F.first("shingles").alias("shingles"))
    parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)).alias("parts"))
    dealt = pairs.join(parts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    wanted = dealt.select(F.col("u").alias("key"), "u", "v", "part").union(dealt.select(F.col("v").alias("key"), F.lit(None).cast("long").alias("u"), "v", "part").distinct())
    met = used.join(wanted, "key").select("v", "part", "u", "shingles").repartition("v", "part").sortWithinPartitions("v", "part", F.asc_nulls_first("u"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.int64)
        for batch in batches:
            us, vs = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            found = []
            for i, u in enumerate(us):
                other = values[ends[i] : ends[i + 1]]
                if u is None:  # the one that the rows after it meet
                    own = other.copy()
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                    found.append((u, vs[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return met.mapInArrow(compare, "u long, v long")


def links(rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """Links (u, v) between keys that connect all similar sets. ``rows`` are written profiles of ``texts``."""
    sketches = materialise(rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("sketch").alias("sketch")), "sketches")
    of_fp = sketches.groupBy("fp").agg(F.min("key").alias("first"))
    same = sketches.join(of_fp, "fp").where("key != first").select(F.col("key").alias("u"), F.col("first").alias("v"))
    near = simhash.near_pairs(materialise(of_fp.select("fp"), "fps"), radius)
    named = lambda k, c: of_fp.select(F.col("fp").alias(k), F.col("first").alias(c))
    near = near.withColumnsRenamed({"u": "x", "v": "y"}).join(named("x", "u"), "x").join(named("y", "v"), "y").select("u", "v")

    held = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("leading").alias("leading")).select("key", "n", F.posexplode("leading").alias("at", "s"))
    orders = [F.min(F.col("key").bitwiseXOR(F.lit(x))).alias(f"h{i}") for i, x in enumerate(STARS)]
    heads = held.groupBy("s").agg(*orders, F.max("key").alias("last")).where("h0 < last").drop("last")
    held = materialise(held.join(heads, "s"), "leading")
    chosen = held.groupBy("key").agg(*[F.min(f"h{i}").alias(f"h{i}") for i in range(len(STARS))])
    stars = chosen.select(F.col("key").alias("u"), F.explode(F.array(*[F.col(f"h{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(STARS)])).alias("v"))
    first = materialise(plausible(same.union(near).union(stars), sketches, similarity), "candidates")
    found = materialise(similar(first, texts, similarity), "links")

    roots = smallest_reachable(found).withColumnsRenamed({"u": "key", "v": "root"})
    held = held.join(roots, "key", "left").select("s", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    mixed = held.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    words = [F.element_at("sketch", i + 1).alias(f"p{i}") for i in range(SKETCH)]
    held = materialise(held.join(mixed, "s").join(sketches.select("key", *words), "key"), "mixed")
    other = held.select("s", *[F.col(c).alias(f"o_{c}") for c in held.columns if c != "s"])
    n, m, shared = F.col("n"), F.col("o_n"), similarity / (1 + similarity)
    fits = (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9) & (F.least(n - F.col("at"), m - F.col("o_at")) >= shared * (n + m) - 1e-9)
    differing = sum(F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"o_p{i}"))) for i in range(SKETCH))
    apart_at_most = (1 - similarity) / (1 + similarity) * (n + m) + 1e-9
    rest = held.join(other, "s").where((F.col("key") < F.col("o_key")) & (F.col("root") != F.col("o_root")) & fits & (differing <= apart_at_most))
    rest = rest.select(F.col("key").alias("u"), F.col("o_key").alias("v"))
    rest = materialise(plausible(rest, sketches, similarity).join(first, ["u", "v"], "left_anti"), "others")
    return found.union(materialise(similar(rest, texts, similarity), "other-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: of each group the document with the smallest id stays."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialise(profiles(texts, similarity), "profiles")
    roots = smallest_reachable(links(rows, texts, similarity, radius)).select(F.col("u").alias("key"), F.col("v").alias("root"))
    rooted = materialise(rows.select("id", "key").join(roots, "key", "left").select("id", F.coalesce("root", "key").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    stays = rooted.join(least, "root").groupBy("id").agg(F.max(F.col("id") == F.col("least")).alias("stays"))
    gone = materialise(stays.where(~F.col("stays")).select(F.col("id").alias(id_col)), "near-copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
