"""Structural terms: interning, subsumption, and points-to analysis with field terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semilog import api
from semilog.storage import written


class DepthExceeded(ValueError):
    """A term is deeper than the table takes."""


class TermTable:
    """Hash-consing: equal terms get one number; a compound's arguments are numbers."""

    def __init__(self, max_depth: int = 64):
        self.max_depth = max_depth
        self.numbers: dict[tuple, int] = {}
        self.depths: list[int] = []
        self.hits = 0

    def add(self, key: tuple, depth: int) -> int:
        found = self.numbers.get(key)
        if found is not None:
            self.hits += 1
            return found
        if depth > self.max_depth:
            raise DepthExceeded(f"depth {depth} is over {self.max_depth}")
        self.numbers[key] = len(self.depths)
        self.depths.append(depth)
        return self.numbers[key]

    def constant(self, value) -> int:
        return self.add(("", value), 0)

    def compound(self, functor: str, args: Iterable[int]) -> int:
        args = tuple(args)
        return self.add((functor, *args), 1 + max((self.depths[a] for a in args), default=0))

    def intern(self, value) -> int:
        """A whole value, inside out."""
        return self.compound(value[0], [self.intern(a) for a in value[1:]]) if isinstance(value, tuple) else self.constant(value)

    def depth(self, number: int) -> int:
        return self.depths[number]

    def stats(self) -> dict[str, int]:
        return {"terms": len(self.depths), "hits": self.hits}


def subsumes(general, specific, env: dict | None = None) -> bool:
    """Whether variables (``("?", name)``) of ``general`` can be replaced to give ``specific``."""
    env = {} if env is None else env
    if isinstance(general, tuple) and general[0] == "?":
        return env.setdefault(general[1], specific) == specific
    if isinstance(general, tuple):
        return isinstance(specific, tuple) and specific[0] == general[0] and len(specific) == len(general) and all(subsumes(g, s, env) for g, s in zip(general[1:], specific[1:]))
    return type(general) is type(specific) and general == specific


def insert_maximal(store: list, new) -> bool:
    """Adds a term unless one of the store subsumes it; terms that it subsumes go. Whether it was added."""
    if any(subsumes(old, new) for old in store):
        return False
    store[:] = [old for old in store if not subsumes(new, old)] + [new]
    return True


def intern_dense(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with dense numbers ``id`` from 0 in their order.

    Values are range-partitioned, sorted and written; a value's number is its place in its partition plus the sizes of
    the partitions before, a table of one row for each partition.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(values.repartitionByRange("value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("part"), place.alias("place")), "interned")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    return placed.join(F.broadcast(starts), "part").select("value", (F.col("start") + F.col("place")).alias("id"))


POINTS_TO = """
domain var. domain obj. domain fld.
@terms.
pred addr_of(var, obj): Bool.
pred copy(var, var): Bool.
pred store(var, fld, var): Bool.
pred load(var, var, fld): Bool.
pred pt(var, obj): Bool.
pred fpt(term obj, obj): Bool.
pt(P, O) :- addr_of(P, O).
pt(P, O) :- copy(P, Q), pt(Q, O).
fpt(field(O, F), V) :- store(P, F, Q), pt(P, O), pt(Q, V).
pt(P, V) :- load(P, Q, F), pt(Q, O), fpt(field(O, F), V).
"""


def points_to(addr_of: DataFrame, copy: DataFrame, store: DataFrame, load: DataFrame) -> dict[str, DataFrame]:
    """Inclusion-based points-to sets of variables (``pt``) and of object fields (``fpt``, whose first column is the
    term ``field(object, field)``)."""
    program = api.compile(POINTS_TO)
    for name, df in (("addr_of", addr_of), ("copy", copy), ("store", store), ("load", load)):
        program.bind(name, df)
    relations = program.frames(addr_of.sparkSession)
    return {"pt": relations["pt"], "fpt": relations["fpt"]}
