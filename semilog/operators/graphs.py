"""Graph operators: closure, shortest paths, and counts of cyclic patterns without their binary joins' intermediates.

Edges are DataFrames whose first two columns are the ends; a third is a weight where one is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.lang import tree as t
from semilog.lang.checker import check
from semilog.plans import distributed
from semilog.storage import written

#: The largest sieve, 32 MB, and the pairs that are made at a time.
SIEVE_BITS, CHUNK = 28, 1 << 20


def ends(edges: DataFrame) -> DataFrame:
    a, b = edges.columns[:2]
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(u, v) for every path of one edge or more."""
    return distributed.closure(ends(edges)).select(F.col("c0").alias("u"), F.col("c1").alias("v"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(u, v, w): the least total weight over paths of one edge or more; a negative cycle is an error."""
    spark, (a, b, w) = edges.sparkSession, edges.columns[:3]
    var = lambda *n: tuple(map(t.Var, n))
    edge, path = [t.Predicate(p, (("int",), ("int",)), t.Annotation("trop")) for p in ("edge", "path")]
    rules = [
        t.Rule(t.Atom("path", var("X", "Y")), (t.Literal(t.Atom("edge", var("X", "Y"))),)),
        t.Rule(t.Atom("path", var("X", "Z")), (t.Literal(t.Atom("path", var("X", "Y"))), t.Literal(t.Atom("edge", var("Y", "Z"))))),
    ]
    checked = check(t.Program([t.Item(x) for x in (edge, path, *rules)]))
    run = distributed.Run(spark, checked, bound={"edge": edges.select(a, b, w)})
    return run.go()["path"].select(F.col("c0").alias("u"), F.col("c1").alias("v"), "w")


def numbered(edges: DataFrame) -> DataFrame:
    """The ends as integers, as they are or as numbers given to them."""
    e = ends(edges)
    if all(isinstance(f.dataType, T.IntegralType) for f in e.schema.fields):
        return e.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    node = written(e.select("u").union(e.select("v")).distinct().select("u", F.monotonically_increasing_id().alias("i")), "nodes")
    with_u = e.join(node.select("u", F.col("i").alias("iu")), "u")
    return with_u.join(node.select(F.col("u").alias("v"), F.col("i").alias("iv")), "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"))


def oriented(e: DataFrame) -> DataFrame:
    """Undirected edges once each, without loops, from the end of lower degree to the higher one (ties by id), with the
    number of directed edges that way (``f``) and back (``g``).

    No node has more than about sqrt(2 |E|) edges that leave it then, so a hub's neighbours are never gathered in one
    row, and lists stay short at any skew.
    """
    along = F.col("u") < F.col("v")
    e = e.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), along.cast("bigint").alias("f"), (~along).cast("bigint").alias("g"))
    e = written(e.groupBy("u", "v").agg(F.sum("f").alias("f"), F.sum("g").alias("g")), "edges")
    degree = e.select(F.col("u").alias("n")).union(e.select("v")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    both = e.join(degree.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    forward = F.struct(F.col("du"), F.col("u")) < F.struct(F.col("dv"), F.col("v"))
    swap = lambda a, b, c: F.when(forward, F.col(a)).otherwise(F.col(b)).alias(c)
    return written(both.select(swap("u", "v", "u"), swap("v", "u", "v"), swap("f", "g", "f"), swap("g", "f", "g")), "oriented")


def closing(e: DataFrame) -> DataFrame:
    """Oriented edges that can close a triangle, whose lower end is pointed at: (a, b) by id, ``low`` and ``high`` by
    degree, and the numbers of directed edges from a to b (``f``) and back (``g``)."""
    kept = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    swap = lambda x, y: F.when(F.col("u") < F.col("v"), F.col(x)).otherwise(F.col(y))
    return written(kept.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("u").alias("low"), F.col("v").alias("high"), swap("f", "g").alias("f"), swap("g", "f").alias("g")), "closing")


def places(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a sieve for each pair."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    mask = np.uint64((1 << bits) - 1)
    return x & mask, (x >> np.uint64(32)) & mask


def sieve(edges: DataFrame) -> tuple[np.ndarray, int]:
    """A bit set of bounded size that holds all pairs (a, b), and few others; and the power of two of its size."""
    bits = min(SIEVE_BITS, max(10, (16 * edges.count()).bit_length()))

    def marks(batches):
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mark"])

    found = edges.select("a", "b").mapInArrow(marks, "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("mark").to_numpy().view(np.uint64)
    return words, bits


def closed(lists: DataFrame, keys: list[str], edges: DataFrame, fits=None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a list's nodes that an edge of ``edges`` joins: the list's keys, ``a`` < ``b`` with their ``f`` and ``g``
    as ``fa``, ``ga``, ``fb``, ``gb``, and the edge's columns.

    ``lists`` has ``out``, an array of (v, f, g) in order. Pairs are made in the task that holds the list and go through
    a sieve there, so hardly more of them are shuffled than there are edges to meet. ``fits`` tests pairs further.
    """
    words, bits = sieve(edges)
    shared = lists.sparkSession.sparkContext.broadcast(words)
    names = ["a", "b", "fa", "ga", "fb", "gb"]

    def pairs(batches):
        words = shared.value
        for batch in batches:
            out = batch.column(batch.schema.get_field_index("out"))
            off = out.offsets.to_numpy().astype(np.int64)
            flat, off = out.flatten(), off - off[0]
            v, f, g = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            after = np.repeat(off[1:], np.diff(off)) - np.arange(len(v)) - 1
            total, i = np.concatenate([[0], np.cumsum(after)]), 0
            while i < len(v):
                j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, "right")) - 1)
                left = np.repeat(np.arange(i, j), after[i:j])
                right = left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - total[i], after[i:j])
                p, q = places(v[left], v[right], bits)
                on = lambda x: (words[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1)
                kept = (on(p) & on(q)).astype(bool)
                left, right, i = left[kept], right[kept], j
                row = pa.array(np.searchsorted(off, left, "right") - 1)
                if len(left):
                    own = [batch.column(batch.schema.get_field_index(k)).take(row) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (v[left], v[right], f[left], g[left], f[right], g[right]))], [*keys, *names])

    schema = ", ".join([f"{k} long" for k in keys] + [f"{n} long" for n in names])
    found = lists.where(F.size("out") > 1).select(*keys, "out").mapInArrow(pairs, schema)
    return (found if fits is None else found.where(fits)).join(edges, ["a", "b", *on])


def gathered(e: DataFrame, keys: list[str]) -> DataFrame:
    return e.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "f", "g"))).alias("out"))


def count_triangles(edges: DataFrame) -> DataFrame:
    """One row ``n``: triangles of the undirected graph."""
    e = oriented(numbered(edges))
    return closed(gathered(e, ["u"]), ["u"], closing(e).select("a", "b")).agg(F.count(F.lit(1)).alias("n"))


def count_4cliques(edges: DataFrame) -> DataFrame:
    """One row ``n``: sets of four nodes that are all joined."""
    e = oriented(numbered(edges))
    last = closing(e).select("a", "b", "low", "high")
    # A triangle (u, low, high) becomes a clique with another of the same u and low whose ends are joined.
    triangles = closed(gathered(e, ["u"]), ["u"], last).select("u", "low", F.col("high").alias("v"), F.lit(0).cast("bigint").alias("f"), F.lit(0).cast("bigint").alias("g"))
    return closed(gathered(triangles, ["u", "low"]), ["u", "low"], last.select("a", "b")).agg(F.count(F.lit(1)).alias("n"))


def binary_plan_intermediate(edges: DataFrame) -> DataFrame:
    """One row ``n``: rows that a plan of two-way joins would hold between its joins, the sum of squared degrees."""
    e = ends(edges).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    degree = e.select(F.col("u").alias("n")).union(e.select("v")).groupBy("n").count()
    return degree.agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)).cast("bigint").alias("n"))


def directed_triangles(edges: DataFrame) -> DataFrame:
    """One row ``n``: pairs of edges (a, b), (b, c), repeats counted, whose (a, c) is an edge."""
    return hcube_triangles(edges, 1)


def hash_partition(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``df`` dealt to ``k`` partitions by the hash of its keys; no row is lost or repeated."""
    return df.repartition(k, *keys)


def partitioned_join(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The equi-join of both sides dealt alike, partition by partition."""
    return hash_partition(left, keys, k).join(hash_partition(right, keys, k), keys)


def hcube_triangles(edges: DataFrame, p: int = 2) -> DataFrame:
    """One row ``n``: directed triangles by one shuffle to ``p``^3 cells.

    A cell is named by the hashes of a triangle's nodes: the one of lowest degree, then the others by id. Each edge goes
    to the ``p`` cells that agree with its two ends, for each of the three roles, and every triangle is whole in exactly
    one cell, where it counts for each of the directions that its edges have. Loops make triangles with any edge at them.
    """
    every = numbered(edges)
    e = oriented(every)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("bigint")
    cell = lambda x, y, z: (x * p + y) * p + z
    others = F.sequence(F.lit(0).cast("bigint"), F.lit(p - 1).cast("bigint"))
    roles = F.array_distinct(F.concat(F.transform(others, lambda i: cell(part("u"), part("v"), i)), F.transform(others, lambda i: cell(part("u"), i, part("v")))))
    last = closing(e).select("a", "b", "f", "g", F.explode(F.transform(others, lambda i: cell(i, part("a"), part("b")))).alias("cell"))
    lists = gathered(e.withColumn("cell", F.explode(roles)), ["cell", "u"])
    found = closed(lists, ["cell", "u"], last, F.col("cell") == cell(part("u"), part("a"), part("b")), ("cell",))
    there = lambda c: (F.col(c) > 0).cast("bigint")
    ways = [("fa", "f", "fb"), ("fb", "g", "fa"), ("ga", "fb", "f"), ("f", "gb", "ga"), ("gb", "fa", "g"), ("g", "ga", "gb")]
    own = found.select(sum((F.col(x) * F.col(y) * there(z) for x, y, z in ways), F.lit(0).cast("bigint")).alias("n"))
    loops = written(every.where("u = v").groupBy("u").agg(F.count(F.lit(1)).alias("l")), "loops")
    at = lambda c: e.join(loops.withColumnRenamed("u", c), c).select(((F.col("f") + F.col("g")) * F.col("l") + F.col("f") * F.col("g")).alias("n"))
    sums = own.union(loops.select((F.col("l") * F.col("l")).alias("n"))).union(at("u")).union(at("v"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
