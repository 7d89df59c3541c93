"""Plans of conjunctive queries: acyclic or not, orders of variables by cost, and contraction.

A query is a list of atoms ``(relation, variables)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semilog.storage import written

QueryAtom = tuple[str, tuple[str, ...]]

#: Sizes that are taken for relations and domains without statistics.
UNKNOWN_ROWS, UNKNOWN_VALUES = 1000, 1
#: Variables up to which all orders are weighed.
EXHAUSTIVE = 8


@dataclass
class Statistics:
    rows: dict[str, int] = field(default_factory=dict)
    values: dict[str, int] = field(default_factory=dict)


@dataclass
class Decomposition:
    """join_tree: (atom, its parent or None) in the order of removal; cyclic_core: atoms that can't be removed."""

    acyclic: bool
    width: int
    cyclic_core: list[int]
    join_tree: list[tuple[int, int | None]]


def variables(query: list[QueryAtom]) -> list[str]:
    return sorted({v for _, vs in query for v in vs})


def decompose(query: list[QueryAtom]) -> Decomposition:
    """Removes ears: atoms whose shared variables lie within one other atom."""
    left, tree = dict(enumerate(set(vs) for _, vs in query)), []
    while True:
        for i, own in left.items():
            others = {j: vs for j, vs in left.items() if j != i}
            shared = {v for v in own if any(v in vs for vs in others.values())}
            parent = next((j for j, vs in others.items() if shared <= vs), None)
            if parent is not None or not shared:
                tree.append((i, parent))
                break
        else:
            break
        del left[tree[-1][0]]
    return Decomposition(not left, max(1, len(left)), list(left), tree)


def prefix_size(bound: frozenset[str], query: list[QueryAtom], stats: Statistics) -> int:
    """About how many bindings of these variables there are: the join of the atoms that they cover, and for other
    variables their whole domain."""
    size, times = 1, {}
    for name, vs in query:
        if set(vs) <= bound:
            size *= stats.rows.get(name, UNKNOWN_ROWS)
            for v in vs:
                times[v] = times.get(v, 0) + 1
    domain = lambda v: max(1, stats.values.get(v, UNKNOWN_VALUES))
    shrink = 1
    for v, n in times.items():
        shrink *= domain(v) ** (n - 1)
    size = max(1, size // shrink)
    for v in bound - set(times):
        size *= domain(v)
    return size


def order(query: list[QueryAtom], stats: Statistics) -> tuple[list[str], int]:
    """The variables in the order with the least sum of prefix sizes, and that sum.

    A prefix's size hangs on its set alone, so the best order comes from a table over sets; with more than
    ``EXHAUSTIVE`` variables each step takes the cheapest next one.
    """
    names = variables(query)
    if len(names) > EXHAUSTIVE:
        out: list[str] = []
        cost = 0
        while rest := [v for v in names if v not in out]:
            best = min(rest, key=lambda v: (prefix_size(frozenset([*out, v]), query, stats), v))
            out.append(best)
            cost += prefix_size(frozenset(out), query, stats)
        return out, cost
    table: dict[frozenset[str], tuple[int, list[str]]] = {frozenset(): (0, [])}
    for n in range(len(names)):
        for bound in [b for b in table if len(b) == n]:
            cost, way = table[bound]
            for v in names:
                if v not in bound:
                    new = bound | {v}
                    found = (cost + prefix_size(new, query, stats), [*way, v])
                    if new not in table or found < table[new]:
                        table[new] = found
    cost, way = table[frozenset(names)]
    return way, cost


def join_order(atoms: dict[int, set[str]], sizes: dict[int, int], first: int | None = None) -> list[int]:
    """Places of atoms in the order in which to join them, from ``first`` or the smallest on.

    Atoms whose variables are all bound come at once, as they only take rows away; so in a cyclic query an edge that
    closes a cycle is tested before anything else is joined. Then comes the smallest that shares a variable; one that
    shares none comes last. Ties go by place.
    """
    out, bound, left = [], set(), dict(atoms)
    while left:
        if not out and first is not None:
            i = first
        else:
            i = min(left, key=lambda j: (not left[j] <= bound, bool(out) and not left[j] & bound, sizes[j], j))
        out.append(i)
        bound |= left.pop(i)
    return out


@dataclass
class Contraction:
    order: list[str]
    width: int


def contraction(query: list[QueryAtom]) -> Contraction:
    """Elimination of the variable with the fewest neighbours first (ties by name); neighbours become a clique."""
    near = {v: set() for v in variables(query)}
    for _, vs in query:
        for v in vs:
            near[v] |= set(vs) - {v}
    out, width = [], 0
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        own = near.pop(v)
        width = max(width, len(own) + 1)
        for u in own:
            near[u] |= own - {u}
            near[u].discard(v)
        out.append(v)
    return Contraction(out, width)


@dataclass
class Plan:
    decomposition: Decomposition
    order: list[str]
    cost: int
    contraction_width: int


def plan(query: list[QueryAtom], stats: Statistics | None = None) -> Plan:
    way, cost = order(query, stats or Statistics())
    return Plan(decompose(query), way, cost, contraction(query).width)


def measured(factor: DataFrame, times: str) -> tuple[int, dict[str, int]]:
    """A factor's rows, and about how many values each of its variables has."""
    own = [c for c in factor.columns if c != times]
    found = factor.agg(F.count(F.lit(1)), *(F.approx_count_distinct(F.col(f"`{c}`")) for c in own)).first()
    return found[0], {c: max(1, n) for c, n in zip(own, found[1:])}


def joined_size(a: tuple[int, dict[str, int]], b: tuple[int, dict[str, int]]) -> tuple[int, dict[str, int]]:
    """About how many rows and values the join of two measured factors has, if keys meet evenly."""
    rows, shared = a[0] * b[0], a[1].keys() & b[1].keys()
    distinct = lambda x: min(max(1, x[0]), math.prod(x[1][c] for c in shared))
    rows //= max(distinct(a), distinct(b))
    values = {**a[1], **b[1]} | {c: min(a[1][c], b[1][c]) for c in shared}
    return rows, {c: max(1, min(n, rows)) for c, n in values.items()}


def contract_count(query: list[QueryAtom], relations: dict[str, DataFrame]) -> DataFrame:
    """One row ``n``: the size of the query's join with all repeats, without making the join.

    Variables are eliminated one by one: the factors that have it are joined, multiplicities multiplied, and summed
    over it before the next step. The next variable is the one whose join has the fewest rows by the factors' measured
    sizes, as a variable with few values would pair almost everything (ties as in ``contraction``).
    """
    times = "#times"  # no variable's name
    factors: list[tuple[DataFrame, tuple[int, dict[str, int]]]] = []

    def keep(df: DataFrame) -> None:
        df = written(df, "factor")
        factors.append((df, measured(df, times)))

    for name, vs in query:
        df = relations[name]
        cols = {}
        for c, v in zip(df.columns, vs):
            if v in cols:
                df = df.where(F.col(cols[v]) == F.col(c))
            cols.setdefault(v, c)
        keep(df.select(*(F.col(c).alias(v) for v, c in cols.items())).groupBy(*cols).agg(F.count(F.lit(1)).alias(times)))
    multiplied = lambda a, b, keys: (a.withColumnRenamed(times, "#left").join(b, keys) if keys else a.withColumnRenamed(times, "#left").crossJoin(b)).withColumn(times, F.col("#left") * F.col(times)).drop("#left")

    def chain(v: str) -> tuple[int, list[int]]:
        """The most rows that a step of the variable's join has, and the order of its factors: smallest joins first."""
        left = {i: size for i, (_, size) in enumerate(factors) if v in size[1]}
        first = min(left, key=lambda i: (left[i][0], i))
        way, now, most = [first], left.pop(first), 0
        while left:
            i = min(left, key=lambda j: (joined_size(now, left[j])[0], j))
            now = joined_size(now, left.pop(i))
            way.append(i)
            most = max(most, now[0])
        return most, way

    todo = contraction(query).order
    while todo:
        ways = {v: chain(v) for v in todo}
        v = min(todo, key=lambda x: (ways[x][0], todo.index(x)))
        todo.remove(v)
        own = [factors[i][0] for i in ways[v][1]]
        factors = [f for i, f in enumerate(factors) if i not in ways[v][1]]
        joined = own[0]
        for f in own[1:]:
            joined = multiplied(joined, f, [c for c in f.columns if c in joined.columns and c != times])
        rest = [c for c in joined.columns if c not in (times, v)]
        total = F.coalesce(F.sum(times), F.lit(0)).cast("bigint").alias(times)
        keep(joined.groupBy(*rest).agg(total) if rest else joined.agg(total))
    out = factors[0][0]
    for f, _ in factors[1:]:  # one row each by now
        out = multiplied(out, f, [])
    return out.select(F.col(times).alias("n"))
