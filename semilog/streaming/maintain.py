"""Relations kept up to date under inserts and deletes.

``Maintained`` holds a program's relations as DataFrames. An insert joins only what is new. A delete first takes out
all that some derivation may have drawn from the deleted facts, then derives again what has other support.

A plain transitive closure is not followed edge by edge: pairs through changed edges are joined end to end with pairs
that are there, so a change passes over the closure a fixed number of times, however long its paths are.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilog.errors import Unsupported
from semilog.lang.checker import Checked, aggregates
from semilog.plans.distributed import Run, closure
from semilog.storage import written

#: Parts of a relation that are kept apart before they are written as one table.
COMPACT = 8


class Maintained:
    """A Bool program without negation and aggregates above changing facts; facts are DataFrames by predicate."""

    def __init__(self, spark: SparkSession, checked: Checked, facts: dict[str, DataFrame]):
        if any(d.annotation.kind != "bool" for d in checked.decls.values()):
            raise Unsupported("maintenance takes Bool programs")
        self.monotone = not any(b.negated for r in checked.rules for b in r.body) and not any(aggregates(r.head) for r in checked.rules)
        self.run = Run(spark, checked, bound=facts)
        self.spark, self.checked = spark, checked
        self.facts = {p: written(functools.reduce(DataFrame.union, self.run.given(p)).distinct(), f"facts-{p}") for p in checked.decls if self.run.given(p)}
        self.relations = self.run.go()
        self.run.bags.clear()  # facts change from here on
        self.apart: dict[str, int] = {}
        edges = {x[0]: self.run.closure_of(x, [r for r in checked.rules if r.head.pred in x]) for x in checked.layers}
        self.edges = {p: e for p, e in edges.items() if e is not None}
        for p in checked.decls:
            self.relations[p] = written(self.relations[p].distinct(), p)

    def shaped(self, pred: str, df: DataFrame) -> DataFrame:
        names = self.run.keys(pred)
        return df.toDF(*names).select(*(F.col(c).cast(self.relations[pred].schema[c].dataType) for c in names)).distinct()

    def append(self, name: str, old: DataFrame, new: DataFrame) -> DataFrame:
        """Both; parts stay where they are, so a change costs its own size and only rarely the relation's."""
        self.apart[name] = self.apart.get(name, 0) + 1
        if self.apart[name] <= COMPACT:
            return old.union(new)
        self.apart[name] = 0
        return written(old.union(new), name)

    def closures(self) -> dict[str, str]:
        """Predicates that are the plain closure of another, by now without facts of their own."""
        return {p: e for p, e in self.edges.items() if p not in self.facts}

    def insert(self, pred: str, rows: DataFrame) -> None:
        """Adds facts and all that follows."""
        new = self.shaped(pred, rows)
        if pred in self.facts:
            new = written(new.join(self.facts[pred], self.run.keys(pred), "left_anti"), pred)
            self.facts[pred] = self.append(f"facts-{pred}", self.facts[pred], new)
        else:
            new = self.facts[pred] = written(new, f"facts-{pred}")
        self.again() if not self.monotone else self.grow({pred: new})

    def grow(self, delta: dict[str, DataFrame]) -> None:
        """Adds rows, then what rules derive from them, until nothing is new.

        Rows of a closure are new, and complete for the edges of before.
        """
        self.run.relations = self.relations
        closures = self.closures()
        while delta:
            fresh = {}
            for p, df in delta.items():
                new = written(df if p in closures else df.join(self.relations[p], self.run.keys(p), "left_anti"), p)
                if not new.isEmpty():
                    fresh[p] = new
                    self.relations[p] = self.append(p, self.relations[p], new)
            found: dict[str, list[DataFrame]] = {}
            for r in self.checked.rules:
                for i, b in enumerate(r.body):
                    if b.atom.pred in fresh and r.head.pred not in closures:
                        found.setdefault(r.head.pred, []).append(self.run.derived(r, {i: fresh[b.atom.pred]}))
            delta = {p: functools.reduce(DataFrame.union, parts).distinct() for p, parts in found.items()}
            delta |= {p: gained(self.relations[p], fresh[e], p) for p, e in closures.items() if e in fresh}

    def delete(self, pred: str, rows: DataFrame) -> None:
        """Takes facts out, and all that has no other support."""
        gone = written(self.shaped(pred, rows), pred)
        if pred not in self.facts:
            return
        keys = self.run.keys(pred)
        gone = written(gone.join(self.facts[pred], keys, "left_semi"), pred)
        self.facts[pred] = written(self.facts[pred].join(gone, keys, "left_anti"), f"facts-{pred}")
        self.apart[f"facts-{pred}"] = 0
        if not self.monotone:
            self.again()
            return
        # All derivations over the old relations that touch what went.
        self.run.relations = self.relations
        out, delta, closures = {p: None for p in self.relations}, {pred: gone}, self.closures()
        self.apart = {name: n for name, n in self.apart.items() if not name.startswith("out-")}
        while delta:
            found: dict[str, list[DataFrame]] = {}
            for p, df in delta.items():
                out[p] = df if out[p] is None else self.append(f"out-{p}", out[p], df)
            for r in self.checked.rules:
                for i, b in enumerate(r.body):
                    if b.atom.pred in delta and r.head.pred not in closures:
                        found.setdefault(r.head.pred, []).append(self.run.derived(r, {i: delta[b.atom.pred]}))
            lost = {p: led(self.relations[p], onward(delta[e], self.relations[p])).distinct() for p, e in closures.items() if e in delta}
            delta = {}
            for p in [*found, *lost]:
                new = lost[p] if p in lost else functools.reduce(DataFrame.union, found[p]).distinct().join(self.relations[p], self.run.keys(p), "left_semi")
                new = written(new if out[p] is None else new.join(out[p], self.run.keys(p), "left_anti"), p)
                if not new.isEmpty():
                    delta[p] = new
        left = dict(self.relations)
        for p, df in out.items():
            if df is not None:
                left[p] = written(self.relations[p].join(df, self.run.keys(p), "left_anti"), p)
                self.apart[p] = 0
        self.relations = self.run.relations = left
        # What went but is a fact, or follows from what is left, comes back with all that follows from it.
        back: dict[str, DataFrame] = {}
        for p, df in out.items():
            if df is None:
                continue
            if p in closures:
                back[p] = regained(left[p], left[closures[p]], df, p)
                continue
            parts = [self.facts[p].join(df, self.run.keys(p), "left_semi")] if p in self.facts else []
            parts += [self.run.derived(r).join(df, self.run.keys(p), "left_semi") for r in self.checked.rules if r.head.pred == p]
            if parts:
                back[p] = written(functools.reduce(DataFrame.union, parts).distinct(), p)
        self.grow(back)

    def again(self) -> None:
        """From scratch: deletions under negation or aggregates may add and take out."""
        run = Run(self.spark, self.bare(), bound=self.facts)
        self.relations = {p: written(df.distinct(), p) for p, df in run.go().items()}
        self.run.relations = self.relations

    def bare(self) -> Checked:
        """The program without inline facts; the tables hold them."""
        c = self.checked
        return Checked(c.decls, c.rules, [], [], c.queries, c.inputs, c.layers, c.recursive, c.terms)


# --- a transitive closure under changes of its edges; all have columns c0, c1


def through(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ``a`` and ``b``, end to end; repeats included."""
    return a.select("c0", F.col("c1").alias("mid")).join(b.select(F.col("c0").alias("mid"), "c1"), "mid").select("c0", "c1")


def onward(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """An edge, and perhaps a pair behind it."""
    return written(edges.union(through(edges, pairs)).distinct(), "onward")


def led(pairs: DataFrame, ways: DataFrame) -> DataFrame:
    """A way, and perhaps a pair before it; repeats included."""
    return ways.union(through(pairs, ways))


def gained(pairs: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """What ``new`` edges add to the closure ``pairs``.

    From its first new edge on, a path is a chain of hops: a new edge and perhaps a pair. The closure of the hops
    doubles its reach every round and has no pairs but these; before them, a pair may lead to the first new edge.
    """
    return led(pairs, closure(onward(new, pairs), name)).distinct().join(pairs, ["c0", "c1"], "left_anti")


def regained(pairs: DataFrame, edges: DataFrame, out: DataFrame, name: str) -> DataFrame:
    """The pairs of ``out`` that the ``edges`` still have, where ``pairs`` are those of which no path is cut.

    If a pair's path is cut, so is one of every pair that leads there and on: along a path of edges to a node, ``out``
    comes first and ``pairs`` last. Where it changes, an edge and perhaps a pair make a pair of ``out``; what leads
    there is again a pair, or a shorter path of this form.
    """
    some = edges.join(out.select("c0").distinct(), "c0", "left_semi")
    base = written(some.union(through(some, pairs)).distinct().join(out, ["c0", "c1"], "left_semi"), name)
    return base if base.isEmpty() else closure(led(pairs, base), name)


def follow(maintained: Maintained, pred: str, stream: DataFrame, checkpoint: str, kind: str | None = None):
    """A stream's batches as inserts of a predicate, each maintained before the next; starts a query that ends with
    the data that is there. ``kind`` names a column that says ``insert`` or ``delete`` of each row.

    A batch that is run again after a failure inserts or deletes the same set rows, which changes nothing more.
    """

    def step(batch: DataFrame, _: int) -> None:
        cols = [c for c in batch.columns if c != kind]
        for what, act in (("delete", maintained.delete), ("insert", maintained.insert)):
            rows = batch if kind is None and what == "insert" else batch.where(F.col(kind) == what) if kind else None
            if rows is not None:
                rows = rows.select(*cols)
                if not rows.isEmpty():
                    act(pred, rows)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
