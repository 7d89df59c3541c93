"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: a text is lower-cased (A-Z), cut at ASCII white space into words and shingled; each shingle's XXH64
votes on 64 bits. Shingle byte ranges and the votes come from numpy over a whole text.

Comparison: distinct fingerprints are dealt into cells by the population counts of their two halves. Two
fingerprints within the radius have counts that differ by at most the radius in sum, so a cell meets only the cells
that near; all others are skipped unseen. Where a cell has many fingerprints, it is dealt over several tasks, each of
which holds about ``CELL_ROWS`` of its own and lets the others pass, ``OTHERS_AT_ONCE`` at a time. Both sides are sorted
by the counts of their eight bytes and cut into tiles; a pair of tiles whose counts lie further apart than the radius is
skipped, and the others are compared exactly: numpy exclusive-or and bit counts.

A task merges what it finds, so it emits at most one link for each fingerprint it holds and never the pairs of a
group. Components of the links are found in rounds over DataFrames; copies (equal fingerprints) count once there.

Defined results: a null or empty text has fingerprint zero, which links like any other; a text with fewer words
than a shingle is one shingle; rows that repeat get equal results; a null id is kept, and a component whose ids are
all null has a null id; an empty table gives an empty table; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm.common import materialise, texts_of, with_arrow
from semilog.llm.components import smallest_reachable

SEED, RADIUS, SHINGLE = 42, 4, 4
#: Fingerprints of one cell that a task owns, and rows and columns of a tile.
CELL_ROWS, TILE_ROWS, TILE_COLUMNS = 65_536, 128, 2_048
#: Visiting fingerprints that a task holds beside its own.
OTHERS_AT_ONCE = 1 << 18
#: Hashes that are unpacked to bits at once; bounds memory for very long texts.
VOTES_AT_ONCE = 1 << 16


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hash of each shingle of a text, in order; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, ">u8")
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(body[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], ">u8")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text."""
    return voted(shingle_hashes(text, shingle, seed))


def voted(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES_AT_ONCE):
        part = hashes[at : at + VOTES_AT_ONCE]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed 64-bit integer."""

    def make(texts: pa.Array) -> list[pa.Array]:
        made = np.array([fingerprint(t, shingle, seed) for t in texts_of(texts)], np.uint64)
        return [pa.array(made.view(np.int64))]

    return with_arrow(docs, [text_col], [T.StructField("fp", T.LongType())], make)


def half_counts(c: str) -> list:
    """Population counts of the high and the low half of column ``c``."""
    return [F.bit_count(F.shiftrightunsigned(c, 32)), F.bit_count(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]


def byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)


class Merged:
    """Labels of fingerprints; linked ones get the same, the smallest."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        differ = la != lb
        if not differ.any():
            return
        pairs = np.unique(np.stack([la[differ], lb[differ]], 1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        old = np.array(list(parent), np.int64)
        new = np.array([root(x) for x in parent], np.int64)
        order = np.argsort(old)
        old, new = old[order], new[order]
        at = np.minimum(np.searchsorted(old, self.label), len(old) - 1)
        hit = old[at] == self.label
        self.label[hit] = new[at[hit]]


def boxes(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest byte counts of each tile."""
    heads = np.arange(0, len(counts), size)
    return np.minimum.reduceat(counts, heads), np.maximum.reduceat(counts, heads)


def sort_by_counts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = byte_counts(fps)
    order = np.lexsort(counts.T[::-1])
    return fps[order], counts[order]


class Linker:
    """A task's own fingerprints and what links them, as others pass."""

    def __init__(self, own: np.ndarray, radius: int = RADIUS):
        self.radius = radius
        self.own, counts = sort_by_counts(own)
        self.lo, self.hi = boxes(counts, TILE_ROWS)
        self.label = np.arange(len(own))

    def meet(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): a link for each of ``others`` that is near one of the own, of which several may become one by it."""
        n = len(self.own)
        others, counts = sort_by_counts(others)
        merged = Merged(np.concatenate([self.label, np.arange(n, n + len(others))]))
        lo_b, hi_b = boxes(counts, TILE_COLUMNS)
        for i in range(len(self.lo)):
            lo, hi, rows = self.lo[i], self.hi[i], self.own[i * TILE_ROWS : (i + 1) * TILE_ROWS]
            apart = np.maximum(np.maximum(lo - hi_b, lo_b - hi), 0).sum(1)
            for j in np.flatnonzero(apart <= self.radius).tolist():
                first = j * TILE_COLUMNS
                # Inside the tile, rows of the columns' side that are too far from the whole row tile go too.
                c = counts[first : first + TILE_COLUMNS]
                near = np.flatnonzero(np.maximum(np.maximum(lo - c, c - hi), 0).sum(1) <= self.radius)
                if len(near):
                    a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ others[first + near][None, :]) <= self.radius)
                    if len(a):
                        merged.link(i * TILE_ROWS + a, n + first + near[b])
        self.label = merged.label[:n]
        moved = np.flatnonzero(merged.label[n:] < n)
        return real_links(others[moved], self.own[merged.label[n + moved]])

    def between_own(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.own)))
        return real_links(self.own[moved], self.own[self.label[moved]])


def real_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return a[a != b], b[a != b]


def near_pairs(distinct: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS, at_once: int = OTHERS_AT_ONCE) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all those within ``radius`` bits."""
    high, low = half_counts("fp")
    celled = distinct.select("fp", high.alias("h"), low.alias("l"))
    # At most 33 x 33 cells, whatever the input.
    parts = celled.groupBy("h", "l").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("parts"))
    steps = [(dh, dl) for dh in range(-radius, radius + 1) for dl in range(-radius, radius + 1) if abs(dh) + abs(dl) <= radius and (dh, dl) >= (0, 0)]
    offsets = F.array(*[F.struct(F.lit(dh).alias("dh"), F.lit(dl).alias("dl")) for dh, dl in steps])
    cell = lambda h, l: h * 33 + l  # noqa: E731, E741
    owned = celled.join(F.broadcast(parts), ["h", "l"]).select(cell(F.col("h"), F.col("l")).alias("cell"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("own"), "fp")
    visiting = celled.select("fp", F.explode(offsets).alias("o"), "h", "l").select("fp", (F.col("h") - F.col("o.dh")).alias("h"), (F.col("l") - F.col("o.dl")).alias("l"))
    visiting = visiting.join(F.broadcast(parts), ["h", "l"]).select(cell(F.col("h"), F.col("l")).alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("own"), "fp")
    dealt = owned.union(visiting).repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("own"))

    def told(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, others, linker = None, [], [], None

        def pass_by() -> Iterator[pa.RecordBatch]:
            nonlocal linker, others
            if own and others:
                linker = linker or Linker(np.concatenate(own), radius)
                yield told(linker.meet(np.concatenate(others)))
            others = []

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal linker, own
            yield from pass_by()
            if linker:
                yield told(linker.between_own())
            own, linker = [], None

        for batch in batches:
            keys = batch.column(0).to_numpy() * (1 << 31) + batch.column(1).to_numpy()
            mine = batch.column(2).to_numpy(zero_copy_only=False)
            fps = batch.column(3).to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    yield from finish()
                    key = keys[a]
                if mine[a]:
                    own.append(fps[a:b][mine[a:b]])
                others.append(fps[a:b][~mine[a:b]])
                if sum(map(len, others)) >= at_once:
                    yield from pass_by()
        yield from finish()

    return dealt.select(F.col("cell").cast("long"), F.col("part").cast("long"), "own", "fp").mapInArrow(run, "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` its id, ``fp`` and ``component_id``: the smallest id that links reach."""
    narrow = materialise(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle, seed).select("id", "fp"), "fingerprints")
    distinct = materialise(narrow.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = smallest_reachable(near_pairs(distinct.select("fp"), radius))
    rooted = distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return narrow.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    made = components(docs)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 5, seed: int = SEED) -> DataFrame:
    """``docs`` without near-duplicates: of each group the document with the smallest id stays.

    Rows that repeat an id are one document and stay or go together; rows without an id all stay. The ids that go are
    written first, so Spark knows their size when it chooses how to take them out.
    """
    found = components(docs, id_col, text_col, radius, shingle, seed)
    stays = found.groupBy(id_col).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays"))
    gone = materialise(stays.where(~F.col("stays")).select(id_col), "near-copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
