"""Evaluation over DataFrames.

A rule's body is a chain of equi-joins on shared variables, ordered anew each round by the sizes that relations then
have; negations are anti-joins after them, and the head is a projection; Catalyst plans each round. Recursion is a loop on the driver over the strongly connected components,
semi-naive: a round joins only what the last one added. What a round adds is written to the shared folder, so the
lineage stays short, an executor's loss costs a task and not the loop, and Spark knows the size of each side when it
chooses a join.

Relations have columns ``c0``, ``c1``, ... (``unit`` if they have none), and one more by the run's mode:

* ``plain``: ``w`` for Trop predicates (null stands for infinity, so min and + need no cases);
* ``worlds``: ``world`` for predicates that depend on soft facts: one run covers all worlds;
* ``proofs``: ``pf``, one row for each minimal proof (an ordered array of signed leaves).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.errors import EvalError, NegativeWeightCycle, NonIntegerAggregand, NotBool, Overflow, ProofBudget, SoftAggregate, TooManySoftFacts, Unsupported
from semilog.functions import circuits
from semilog.functions import proofs as pf
from semilog.lang import tree as t
from semilog.lang.checker import Checked, aggregates
from semilog.plans import encoding as en
from semilog.plans import planner
from semilog.plans.local import ordered
from semilog.storage import written

#: Soft facts whose worlds are enumerated; beyond, capture proofs.
MAX_SOFT = 20
#: Deltas that are kept apart before they are written as one table.
COMPACT = 8
#: Parts of each key's rows, and keys for each partition from which on a join needs none.
SALTS, MANY_KEYS = 64, 16
#: Rounds after which the number of values is counted for the cap on Trop recursion.
COUNT_AFTER = 8


def columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)] or ["unit"]


def bytes_of(df: DataFrame) -> int:
    """The planner's estimate; of a written table its size as it is."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Run:
    """One evaluation of a checked program. ``bound`` has the DataFrames of predicates filled from outside.

    A bound frame's columns are the predicate's arguments in order, then the weight of a Trop predicate, or the
    probability of a soft one, whose rows are numbered as leaves behind the program's own; ``leaves`` has their p.
    """

    def __init__(self, spark: SparkSession, checked: Checked, mode: str = "plain", bound: dict[str, DataFrame] | None = None, soft_bound: dict[str, DataFrame] | None = None, budget: int = pf.BUDGET):
        self.spark, self.checked, self.mode, self.budget = spark, checked, mode, budget
        self.bound, self.soft_bound = bound or {}, soft_bound or {}
        self.arity = {p: len(d.args) for p, d in checked.decls.items()}
        self.trop = mode == "plain" and any(d.annotation.kind == "trop" for d in checked.decls.values())
        if mode != "plain" and any(d.annotation.kind == "trop" for d in checked.decls.values()):
            raise NotBool("a program with Trop predicates has no probabilities")
        self.kinds = self.infer()
        self.dropped: list[DataFrame] = []
        self.soft_preds = self.soft_closure()
        self.numbered = {} if mode == "plain" else {p: self.with_leaves(df, i) for i, (p, df) in enumerate(self.soft_bound.items())}
        if mode == "worlds":
            if self.soft_bound:
                raise TooManySoftFacts("soft facts of DataFrames have no worlds; capture proofs")
            if len(checked.soft) > MAX_SOFT:
                raise TooManySoftFacts(f"{len(checked.soft)} soft facts; worlds are enumerated up to {MAX_SOFT}")
            self.worlds = spark.range(1 << len(checked.soft)).select(F.col("id").alias("world"))
        self.relations: dict[str, DataFrame] = {}
        self.bags: dict[str, tuple[int, DataFrame]] = {}
        self.known: dict[tuple, bool] = {}
        self.folds = True

    # --- relations from outside

    def with_leaves(self, df: DataFrame, at: int) -> DataFrame:
        """A soft frame, written, with a number for each row as ``leaf``."""
        own, n = len(self.checked.soft), len(self.soft_bound)
        return written(df.withColumn("leaf", F.monotonically_increasing_id() * n + (own + at + 1)), "leaves")

    @property
    def leaves(self) -> DataFrame:
        """(leaf, p) of all soft facts."""
        own = self.spark.createDataFrame([(i + 1, float(s.p)) for i, s in enumerate(self.checked.soft)], "leaf long, p double")
        return functools.reduce(DataFrame.union, [df.select("leaf", F.col(f"`{df.columns[-2]}`").cast("double").alias("p")) for df in self.numbered.values()], own)

    def infer(self) -> dict[str, list[str]]:
        given: dict[str, list[set[str]]] = {p: [set() for _ in range(n)] for p, n in self.arity.items()}
        rows = [(p, a) for p, a, _ in self.checked.facts]
        rows += [(s.pred, s.args) for s in self.checked.soft] if self.mode != "plain" else []
        for pred, args in rows:
            for i, v in enumerate(args):
                given[pred][i].add(en.kind_of(v))
        for source in (self.bound, self.soft_bound):
            for pred, df in source.items():
                for i, f in enumerate(df.schema.fields[: self.arity[pred]]):
                    if isinstance(f.dataType, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
                        given[pred][i].add(en.INT)
                    elif isinstance(f.dataType, T.StringType):
                        given[pred][i].add(en.SYM)
                    else:
                        raise EvalError(f"`{pred}`: a column of type {f.dataType.simpleString()} can't be bound; cast it to bigint or string")
        return en.infer(self.arity, given, self.checked.rules)

    def soft_closure(self) -> set[str]:
        if self.mode == "plain":
            return set()
        out = {s.pred for s in self.checked.soft} | set(self.soft_bound)
        while more := {r.head.pred for r in self.checked.rules if any(b.atom.pred in out for b in r.body)} - out:
            out |= more
        return out

    def extra(self, pred: str) -> list[str]:
        """The columns besides arguments."""
        if self.mode == "plain":
            return ["w"] if self.checked.kind(pred) == "trop" else []
        if self.mode == "worlds":
            return ["world"] if pred in self.soft_preds else []
        return ["pf"]

    def schema(self, pred: str) -> str:
        kinds = [f"c{i} {en.SPARK_TYPE[k]}" for i, k in enumerate(self.kinds[pred])] or ["unit int"]
        return ", ".join(kinds + [{"w": "w bigint", "world": "world bigint", "pf": "pf array<bigint>"}[x] for x in self.extra(pred)])

    def frame(self, pred: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, self.schema(pred))

    def given(self, pred: str) -> list[DataFrame]:
        """The predicate's facts, inline and bound."""
        out = []
        store = lambda args: tuple(en.store(v, k) for v, k in zip(args, self.kinds[pred])) or (0,)
        facts = [(store(a), w) for p, a, w in self.checked.facts if p == pred]
        if facts:
            if self.mode == "worlds" and pred in self.soft_preds:
                plain = self.spark.createDataFrame([a for a, _ in facts], ", ".join(self.schema(pred).split(", ")[:-1]))
                out.append(plain.crossJoin(self.worlds))
            else:
                tail = {"w": lambda w: (w,), "pf": lambda w: ([],)}
                out.append(self.frame(pred, [a + (tail[self.extra(pred)[0]](w) if self.extra(pred) else ()) for a, w in facts]))
        if pred in self.bound:
            df = self.bound[pred]
            cols = [en.convert(F.col(f"`{f.name}`").cast("bigint") if isinstance(f.dataType, T.IntegralType) else F.col(f"`{f.name}`"), en.INT if isinstance(f.dataType, T.IntegralType) else en.SYM, k).alias(c) for f, k, c in zip(df.schema.fields, self.kinds[pred], columns(self.arity[pred]))]
            if self.extra(pred) == ["w"]:
                cols.append(F.col(f"`{df.columns[self.arity[pred]]}`").cast("bigint").alias("w"))
            df = df.select(*cols)
            if self.extra(pred) == ["pf"]:
                df = df.withColumn("pf", F.array().cast("array<bigint>"))
            if self.extra(pred) == ["world"]:
                df = df.crossJoin(self.worlds)
            out.append(df)
        if self.mode == "plain":
            return out
        soft = [(i, s) for i, s in enumerate(self.checked.soft) if s.pred == pred]
        if soft and self.mode == "proofs":
            out.append(self.frame(pred, [store(s.args) + ([i + 1],) for i, s in soft]))
        elif soft:
            leaves = self.spark.createDataFrame([store(s.args) + (i,) for i, s in soft], ", ".join(self.schema(pred).split(", ")[:-1]) + ", leaf int")
            out.append(leaves.crossJoin(self.worlds).where(F.expr("(shiftright(world, leaf) & 1) = 1")).drop("leaf"))
        if pred in self.soft_bound:
            df = self.numbered[pred]
            cols = [en.convert(F.col(f"`{f.name}`").cast("bigint") if isinstance(f.dataType, T.IntegralType) else F.col(f"`{f.name}`"), en.INT if isinstance(f.dataType, T.IntegralType) else en.SYM, k).alias(c) for f, k, c in zip(df.schema.fields, self.kinds[pred], columns(self.arity[pred]))]
            out.append(df.select(*(cols or [F.lit(0).alias("unit")]), F.array("leaf").alias("pf")))
        return out

    # --- one rule

    def read_as_bag(self, rule: t.Rule, positive: list[int], source: dict[int, DataFrame]) -> int | None:
        """The body's atom whose facts are read with their repeats: the largest.

        Repeats of one atom multiply bindings by no more than the file holds them, and its distinct rows needn't be
        shuffled for; repeats of two would multiply each other. Aggregates read sets.
        """
        own = [i for i in positive if i not in source and rule.body[i].atom.pred in self.bags]
        if aggregates(rule.head) or not own:
            return None
        return max(own, key=lambda i: (self.bags[rule.body[i].atom.pred][0], -i))

    def storages(self, rule: t.Rule) -> dict[str, str]:
        """How each variable is stored in the rule."""
        seen: dict[str, set[str]] = {}
        for b in rule.body:
            if not b.negated:
                for i, a in enumerate(b.atom.args):
                    kind = self.kinds[b.atom.pred][i]
                    for v in t.variables(a):
                        seen.setdefault(v, set()).add(kind if isinstance(a, t.Var) else en.TAG)
        return {v: next(iter(k)) if len(k) == 1 else en.TAG for v, k in seen.items()}

    def matched(self, atom: t.Atom, df: DataFrame, storages: dict[str, str], place: int) -> DataFrame:
        """The atom's rows with a column ``v_<name>`` for each variable, and its annotation as ``x_<place>``."""
        bound: dict[str, Column] = {}
        tests: list[Column] = []

        def walk(term: t.Term, c: Column, kind: str) -> None:
            if isinstance(term, t.Var):
                own = en.convert(c, kind, storages[term.name])
                if term.name in bound:
                    tests.append(bound[term.name] == own)
                else:
                    bound[term.name] = own
            elif isinstance(term, t.Compound):
                if kind != en.TAG:
                    tests.append(F.lit(False))
                    for v in t.variables(term):
                        bound.setdefault(v, F.lit(None).cast("string"))
                    return
                tests.append(en.functor_is(c, term.functor, len(term.args)))
                for i, a in enumerate(term.args):
                    walk(a, en.part(c, i), en.TAG)
            else:
                value = en.literal(t.ground(term), kind)
                tests.append(F.lit(False) if value is None else c == value)

        for i, a in enumerate(atom.args):
            walk(a, F.col(f"c{i}"), self.kinds[atom.pred][i])
        if tests:
            df = df.where(functools.reduce(lambda a, b: a & b, tests))
        cols = [c.alias(f"v_{v}") for v, c in bound.items()]
        extra = self.extra(atom.pred)
        if extra == ["world"]:
            cols.append(F.col("world"))
        elif extra:
            cols.append(F.col(extra[0]).alias(f"x_{place}"))
        return df.select(*(cols or [F.lit(0).alias(f"u_{place}")]))

    # --- heads of variables that no atom has together: they may have far more rows than the tables

    def fans_out(self, rule: t.Rule) -> bool:
        """Whether the rule is a plain join of flat atoms whose head no single atom covers."""
        atoms = [b.atom for b in rule.body if not b.negated]
        flat = all(not isinstance(a, t.Compound | t.Agg) for x in (rule.head, *atoms) for a in x.args)
        plain = self.mode == "plain" and not any(self.extra(x.pred) for x in (rule.head, *atoms))
        return flat and plain and not any(set(t.atom_variables(rule.head)) <= set(t.atom_variables(x)) for x in atoms)

    def determines(self, pred: str, given: list[int], rest: list[int]) -> bool:
        """Whether rows of a relation that agree in the columns ``given`` agree in ``rest``."""
        key = (pred, tuple(given), tuple(rest))
        if key not in self.known:
            df = self.bags[pred][1] if pred in self.bags else self.relations[pred]
            own = F.struct(*(f"c{i}" for i in rest))
            two = df.groupBy(*(f"c{i}" for i in given)).agg(F.min(own).alias("a"), F.max(own).alias("b"))
            self.known[key] = two.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
        return self.known[key]

    def determined(self, names: set[str], rule: t.Rule) -> set[str]:
        """The variables that follow from ``names`` by the relations as they are."""
        out, more = set(names), True
        while more:
            more = False
            for b in rule.body:
                own = {v: i for i, a in reversed(list(enumerate(b.atom.args))) for v in t.variables(a)}
                given, rest = [own[v] for v in own if v in out], [own[v] for v in own if v not in out]
                if not b.negated and given and rest and self.determines(b.atom.pred, sorted(given), sorted(rest)):
                    out |= own.keys()
                    more = True
        return out

    def joined(self, rule: t.Rule, source: dict[int, DataFrame], apart: bool = False) -> tuple[DataFrame, dict[str, str], list[str]]:
        """The body's bindings: variables, ``world`` if any, and the names of annotation columns.

        ``apart``: all atoms are read as sets, and what fans out is dealt to many tasks.
        """
        storages = self.storages(rule)
        first = next(iter(source), None)
        plan = ordered(rule.body, first)
        positive = [i for i in plan if not rule.body[i].negated]
        if len(positive) > 2:  # two are joined in either order
            sizes = {i: bytes_of(source.get(i, self.relations.get(rule.body[i].atom.pred))) for i in positive}
            positive = planner.join_order({i: set(t.atom_variables(rule.body[i].atom)) for i in positive}, sizes, first)
        wanted = set(t.atom_variables(rule.head)) | {v for i in plan if rule.body[i].negated for v in t.atom_variables(rule.body[i].atom)}
        if aggregates(rule.head):
            wanted |= set(storages)  # aggregates fold over full bindings
        df, notes = None, []
        bag = None if apart else self.read_as_bag(rule, positive, source)
        for at, i in enumerate(positive):
            atom = rule.body[i].atom
            own = self.matched(atom, self.bags[atom.pred][1] if i == bag else source.get(i, self.relations.get(atom.pred)), storages, i)
            if self.extra(atom.pred) not in ([], ["world"]):
                notes.append(f"x_{i}")
            if df is None:
                df = own
                continue
            shared = [c for c in own.columns if c in df.columns and not c.startswith(("x_", "u_"))]
            later = wanted | {v for j in positive[at + 1 :] for v in t.atom_variables(rule.body[j].atom)}
            new = [c for c in own.columns if c not in shared]
            if not shared:
                df = df.crossJoin(own)
            elif all(c.startswith("u_") or c.startswith("v_") and c[2:] not in later for c in new):
                if i not in source and atom.pred in self.bags:  # repeats on this side change nothing
                    own = self.matched(atom, self.bags[atom.pred][1], storages, i)
                df = df.join(own, shared, "left_semi")
            elif apart and not self.follows(atom, {c[2:] for c in shared}):
                df = spread(df, own, shared)
            else:
                df = df.join(own, shared)
        if df is None:
            df = self.spark.range(1).select(F.lit(0).alias("u_"))
        for i in plan:
            if rule.body[i].negated:
                df, more = self.without(df, rule.body[i].atom, storages, i)
                notes += more
        return df, storages, notes

    def follows(self, atom: t.Atom, names: set[str]) -> bool:
        """Whether an atom has one row at most for each value of these variables."""
        given = [i for i, a in enumerate(atom.args) if names & set(t.variables(a))]
        return self.determines(atom.pred, given, [i for i in range(len(atom.args)) if i not in given])

    def without(self, df: DataFrame, atom: t.Atom, storages: dict[str, str], place: int) -> tuple[DataFrame, list[str]]:
        """``df`` under ``not atom``."""
        relation = self.bags[atom.pred][1] if atom.pred in self.bags else self.relations[atom.pred]
        tests = [F.lit(True)]
        for i, a in enumerate(atom.args):
            kind = self.kinds[atom.pred][i]
            mine = F.col(f"n_c{i}") if not isinstance(a, t.Var) or storages[a.name] == kind else en.convert(F.col(f"n_c{i}"), kind, en.TAG)
            if isinstance(a, t.Var):
                theirs = F.col(f"v_{a.name}")
                tests.append(mine == (theirs if storages[a.name] == kind else en.convert(theirs, storages[a.name], en.TAG)))
            elif isinstance(a, t.Compound):
                built, have = self.built(a, storages)
                tests.append(en.convert(F.col(f"n_c{i}"), kind, en.TAG) == en.convert(built, have, en.TAG))
            else:
                value = en.literal(t.ground(a), kind)
                tests.append(F.lit(False) if value is None else mine == value)
        other = relation.select(*(F.col(c).alias(f"n_{c}") for c in relation.columns))
        if self.extra(atom.pred) == ["world"]:
            if "world" not in df.columns:
                df = df.crossJoin(self.worlds)
            tests.append(F.col("world") == F.col("n_world"))
        match = functools.reduce(lambda a, b: a & b, tests)
        if not atom.args and len(tests) == 1:
            other = other.limit(1)  # a relation without arguments: is there a row at all
        if self.mode != "proofs":
            return df.join(other, match, "left_anti"), []
        keys = [f"n_{c}" for c in columns(len(atom.args))]
        absent = opposite_of(self.budget)(F.collect_list("n_pf"))
        grouped = other.groupBy(*keys).agg(absent.alias("n_not"))
        if not atom.args:
            grouped = grouped.limit(1)
        df = df.join(grouped, match, "left").withColumn(f"x_{place}", F.explode(F.coalesce("n_not", F.array(F.array().cast("array<bigint>"))))).drop(*keys, "n_not")
        return df, [f"x_{place}"]

    def built(self, term: t.Term, storages: dict[str, str]) -> tuple[Column, str]:
        if isinstance(term, t.Var):
            return F.col(f"v_{term.name}"), storages[term.name]
        if isinstance(term, t.Compound):
            parts = [self.built(a, storages) for a in term.args]
            return en.construct(term.functor, [en.convert(c, k, en.TAG) for c, k in parts]), en.TAG
        value = t.ground(term)
        return F.lit(value), en.kind_of(value)

    def annotation(self, pred: str, df: DataFrame, notes: list[str]) -> list[Column]:
        if self.mode == "worlds":
            return [F.col("world")] if pred in self.soft_preds else []
        if self.mode == "proofs":
            union = functools.reduce(F.array_union, map(F.col, notes), F.array().cast("array<bigint>"))
            return [F.array_sort(union).alias("pf")]
        if self.checked.kind(pred) != "trop":
            return []
        return [functools.reduce(lambda a, b: a + b, map(F.col, notes), F.lit(0).cast("bigint")).alias("w")]

    def derived(self, rule: t.Rule, source: dict[int, DataFrame] | None = None, apart: bool = False) -> DataFrame:
        """The rows that a rule derives, repeats included.

        ``apart``: without repeats, which costs a pass over all rows only where the head leaves a variable open.
        """
        df, storages, notes = self.joined(rule, source or {}, apart)
        once = apart and {c[2:] for c in df.columns if c.startswith("v_")} <= self.determined(set(t.atom_variables(rule.head)), rule)
        pred = rule.head.pred
        if self.mode == "worlds" and pred in self.soft_preds and "world" not in df.columns:
            df = df.crossJoin(self.worlds)
        if aggregates(rule.head):
            return self.aggregated(rule, df, storages)
        cols, deep = [], []
        for i, (a, want) in enumerate(zip(rule.head.args, self.kinds[pred])):
            c, have = self.built(a, storages)
            cols.append(en.convert(c, have, want).alias(f"c{i}"))
            if isinstance(a, t.Compound):
                deep.append(f"c{i}")
        out = df.select(*(cols or [F.lit(0).alias("unit")]), *self.annotation(pred, df, notes))
        if self.mode == "proofs":
            out = out.where(~F.exists("pf", lambda x: F.array_contains("pf", -x)))
        if deep:
            fits = functools.reduce(lambda a, b: a & b, [en.depth(F.col(c)) <= self.checked.max_depth for c in deep])
            self.dropped.append(out.where(~fits))
            out = out.where(fits)
        return out.distinct() if apart and not once else out

    def aggregated(self, rule: t.Rule, df: DataFrame, storages: dict[str, str]) -> DataFrame:
        """An aggregate over the distinct bindings of all of the body's variables."""
        agg, pred = aggregates(rule.head)[0], rule.head.pred
        if agg.op == "prob_or":
            raise Unsupported("prob_or is reserved")
        if self.trop and (self.checked.kind(pred) == "trop" or any(self.checked.kind(b.atom.pred) == "trop" for b in rule.body)):
            raise Unsupported(f"an aggregate of `{pred}` can't read or fill Trop relations")
        if self.mode == "proofs":
            for p in {b.atom.pred for b in rule.body}:
                if not self.relations[p].where(F.size("pf") > 0).isEmpty():
                    raise SoftAggregate(f"an aggregate of `{pred}` reads soft tuples of `{p}`")
        world = [c for c in ("world",) if c in df.columns]
        full = df.select(*[c for c in df.columns if c.startswith("v_")], *world)
        if self.mode == "proofs":  # else all atoms are sets and all of their variables are kept
            full = full.distinct()
        cols, keys, place = [], [], None
        for i, (a, want) in enumerate(zip(rule.head.args, self.kinds[pred])):
            if isinstance(a, t.Agg):
                place = i
                continue
            c, have = self.built(a, storages)
            cols.append(en.convert(c, have, want).alias(f"c{i}"))
            keys.append(f"c{i}")
        value = F.col(f"v_{agg.var}")
        if agg.op == "count":
            fold = F.count(F.lit(1))
        else:
            if storages[agg.var] == en.TAG:
                value = F.when(value.rlike("^-?[0-9]+$"), value.cast("bigint")).otherwise(F.raise_error(F.lit(NOT_INTEGER)).cast("bigint"))
            elif storages[agg.var] == en.SYM:
                value = F.raise_error(F.lit(NOT_INTEGER)).cast("bigint")
            fold = {"sum": F.sum, "min": F.min, "max": F.max}[agg.op]("_value")
            full = full.withColumn("_value", value)
        grouped = full.select(*cols, *world, *(["_value"] if agg.op != "count" else [F.lit(1).alias("_one")])).groupBy(*keys, *world).agg(fold.alias("_fold"), F.count(F.lit(1)).alias("_n"))
        out = [F.col("_fold").cast("bigint") if i == place else F.col(f"c{i}") for i in range(len(rule.head.args))]
        out = [en.convert(c, en.INT, k) if i == place else c for i, (c, k) in enumerate(zip(out, self.kinds[pred]))]
        extra = [F.array().cast("array<bigint>").alias("pf")] if self.mode == "proofs" else world
        return grouped.where("_n > 0").select(*(c.alias(f"c{i}") for i, c in enumerate(out)), *extra)

    # --- sums of derivations

    def keys(self, pred: str) -> list[str]:
        return columns(self.arity[pred]) + (["world"] if self.extra(pred) == ["world"] else [])

    def added(self, pred: str, parts: list[DataFrame]) -> DataFrame:
        """One row for each tuple (each minimal proof, in mode proofs)."""
        every = functools.reduce(DataFrame.union, parts) if parts else self.frame(pred, [])
        if self.extra(pred) == ["w"]:
            return every.groupBy(*self.keys(pred)).agg(F.min("w").alias("w"))
        every = every.distinct()
        return self.pruned(pred, every) if self.mode == "proofs" else every

    def pruned(self, pred: str, df: DataFrame) -> DataFrame:
        """Minimal proofs, of bounded predicates the likeliest."""
        keys = self.keys(pred)
        if pred not in self.soft_preds:  # certain tuples have one empty proof
            return df
        other = df.select(*(F.col(c).alias(f"o_{c}") for c in df.columns))
        within = (F.size("o_pf") < F.size("pf")) & (F.size(F.array_except("o_pf", "pf")) == 0)
        match = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"o_{k}") for k in keys], within)
        kept = df.join(other, match, "left_anti")
        k = self.checked.modes.get(pred)
        if k is not None:
            order = Window.partitionBy(*keys).orderBy(F.desc("_p"), F.asc("pf"))
            kept = self.weighed(pred, kept).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_p", "_n")
        return kept

    def weighed(self, pred: str, df: DataFrame) -> DataFrame:
        """``df`` with ``_p``, the product of its proof's leaves."""
        if not self.numbered:
            p = F.array(*[F.lit(float(s.p)) for s in self.checked.soft])
            factor = lambda w, x: w * F.when(x > 0, F.get(p, F.abs(x).cast("int") - 1)).otherwise(1 - F.get(p, F.abs(x).cast("int") - 1))
            return df.withColumn("_p", F.aggregate("pf", F.lit(1.0), factor))
        keys = [*self.keys(pred), "pf"]
        each = df.select(*keys, F.explode_outer("pf").alias("_x")).withColumn("leaf", F.abs("_x")).join(self.leaves, "leaf", "left")
        factor = F.when(F.col("_x").isNull(), 1.0).when(F.col("_x") > 0, F.col("p")).otherwise(1 - F.col("p"))
        return each.groupBy(*keys).agg(F.product(factor).alias("_p"))

    # --- layers

    def go(self) -> dict[str, DataFrame]:
        try:
            for layer in self.checked.layers:
                self.layer(layer)
            return self.relations
        except PySparkException as e:
            raise told(e) from e

    def layer(self, layer: list[str]) -> None:
        own = [r for r in self.checked.rules if r.head.pred in layer]
        looping = [r for r in own if any(b.atom.pred in layer for b in r.body)]
        used = {b.atom.pred for r in self.checked.rules for b in r.body}
        if (edge := self.closure_of(layer, own)) is not None and self.mode == "plain":
            if self.extra(edge):
                self.relations[layer[0]] = cheapest(self.relations[edge], layer[0], lambda: self.universe() + 2)
            else:
                self.relations[layer[0]] = closure(self.relations[edge], layer[0])
            return
        if (edge := self.generation_of(layer, own)) is not None:
            found = same_generation(self, edge, layer[0], own)
            self.relations[layer[0]] = written(found, layer[0]) if any(b.atom.pred == layer[0] for r in self.checked.rules if r not in own for b in r.body) else found
            return
        base = {}
        for p in layer:
            rules = [r for r in own if r.head.pred == p and r not in looping]
            apart = len(rules) == 1 and not looping and not self.given(p) and self.fans_out(rules[0])
            parts = self.given(p) + [self.derived(r, apart=apart) for r in rules]
            derived = any(r.head.pred == p for r in own)
            base[p] = parts[0] if apart else self.added(p, parts)
            if parts and not derived and self.mode == "plain" and not self.extra(p):
                bag = functools.reduce(DataFrame.union, parts)
                self.bags[p] = bytes_of(bag), bag
            if looping or derived and p in used:
                base[p] = written(base[p], p)
        self.relations.update(base)
        if not looping:
            return
        if self.mode == "proofs":
            self.saturate(layer, own, base)
            return
        self.semi_naive(layer, looping, base)

    def closure_of(self, layer: list[str], rules: list[t.Rule]) -> str | None:
        """The edge relation, if the layer is the plain transitive closure of one, or its cheapest paths."""
        if self.mode != "plain" or len(layer) != 1 or len(rules) != 2 or self.arity[layer[0]] != 2 or self.given(layer[0]):
            return None
        p = layer[0]
        shapes = {(r.head.args, tuple((b.atom.pred == p, b.atom.args, b.negated) for b in r.body)): r for r in rules}
        base = next((r for r in rules if len(r.body) == 1), None)
        step = next((r for r in rules if len(r.body) == 2), None)
        if not base or not step or len(shapes) != 2:
            return None
        var = lambda *names: tuple(map(t.Var, names))
        x, y = (a.name if isinstance(a, t.Var) else None for a in base.head.args)
        edge = base.body[0]
        if None in (x, y) or x == y or edge.negated or edge.atom.pred == p or edge.atom.args != var(x, y) or self.extra(edge.atom.pred) != self.extra(p):
            return None
        a, b = step.body
        if a.negated or b.negated or {a.atom.pred, b.atom.pred} not in ({p, edge.atom.pred}, {p}):
            return None
        names = [v.name if isinstance(v, t.Var) else None for v in (*a.atom.args, *b.atom.args)]
        if None in names or names[1] != names[2] or len({names[0], names[1], names[3]}) != 3 or step.head.args != var(names[0], names[3]):
            return None
        return edge.atom.pred if self.kinds[edge.atom.pred] == self.kinds[p] else None

    def generation_of(self, layer: list[str], rules: list[t.Rule]) -> str | None:
        """The parent relation, if the layer is ``p(X, Y) :- e(P, X), e(P, Y). p(X, Y) :- e(A, X), p(A, B), e(B, Y).``"""
        p = layer[0]
        if self.mode != "plain" or not self.folds or len(layer) != 1 or len(rules) != 2 or self.arity[p] != 2 or self.extra(p) or self.given(p):
            return None
        base, step = sorted(rules, key=lambda r: len(r.body))
        atoms = [b.atom for r in rules for b in r.body]
        flat = all(isinstance(a, t.Var) for x in (base.head, step.head, *atoms) for a in x.args) and not any(b.negated for r in rules for b in r.body)
        names = {a.pred for a in atoms} - {p}
        if not flat or len(base.body) != 2 or len(step.body) != 3 or len(names) != 1 or self.arity[(e := names.pop())] != 2 or self.extra(e) or en.TAG in self.kinds[e]:
            return None
        pairs = lambda r, name: [tuple(v.name for v in b.atom.args) for b in r.body if b.atom.pred == name]
        x, y = (v.name for v in base.head.args)
        parents = dict((c, a) for a, c in pairs(base, e))
        if x == y or parents.keys() != {x, y} or parents[x] != parents[y] or parents[x] in (x, y):
            return None
        x, y = (v.name for v in step.head.args)
        parents = dict((c, a) for a, c in pairs(step, e))
        if x == y or len(pairs(step, p)) != 1 or parents.keys() != {x, y} or pairs(step, p) != [(parents[x], parents[y])] or len({x, y, *parents.values()}) != 4:
            return None
        return e

    def semi_naive(self, layer: list[str], rules: list[t.Rule], base: dict[str, DataFrame]) -> None:
        parts = {p: [base[p]] for p in layer}
        delta, rounds, cap = dict(base), 1, None
        capped = self.trop and any(self.checked.kind(r.head.pred) == "trop" for r in rules)
        while True:
            made: dict[str, list[DataFrame]] = {p: [] for p in layer}
            for r in rules:
                for i, b in enumerate(r.body):
                    if not b.negated and b.atom.pred in delta:
                        made[r.head.pred].append(self.derived(r, {i: delta[b.atom.pred]}))
            delta = {}
            for p, found in made.items():
                if found:
                    new = written(self.fresh(p, self.added(p, found)), p)
                    if not new.isEmpty():
                        delta[p] = new
            if not delta:
                break
            for p, new in delta.items():
                parts[p].append(new)
                every = functools.reduce(DataFrame.union, parts[p])
                if len(parts[p]) > COMPACT:
                    every = written(self.added(p, [every]), p)
                    parts[p] = [every]
                self.relations[p] = every
            rounds += 1
            if capped and rounds > COUNT_AFTER:
                cap = cap or self.universe() + 2
                if rounds > cap:
                    raise NegativeWeightCycle("weights still fall after more rounds than there are values")
        for p in layer:
            if self.extra(p) == ["w"] and len(parts[p]) > 1:  # rounds that lowered a weight left the old one
                self.relations[p] = written(self.added(p, [self.relations[p]]), p)

    def fresh(self, pred: str, new: DataFrame) -> DataFrame:
        """Rows of ``new`` that the relation lacks, or that lower a weight."""
        old = self.relations[pred]
        if self.extra(pred) != ["w"]:
            return new.join(old, self.keys(pred), "left_anti")
        old = old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns))
        no_worse = F.col("w").isNull() | (F.col("o_w").isNotNull() & (F.col("o_w") <= F.col("w")))
        match = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"o_{k}") for k in self.keys(pred)], no_worse)
        return new.join(old, match, "left_anti")

    def universe(self) -> int:
        """Distinct values of all facts."""
        parts = []
        for p in self.checked.decls:
            for df in self.given(p):
                parts += [df.select(en.convert(F.col(f"c{i}"), k, en.TAG).alias("v")) for i, k in enumerate(self.kinds[p])]
        return functools.reduce(DataFrame.union, parts).distinct().count() if parts else 0

    def saturate(self, layer: list[str], rules: list[t.Rule], base: dict[str, DataFrame]) -> None:
        """Proofs through recursion: all rules over the pruned state, until no tuple's proofs change."""
        while True:
            state = {}
            for p in layer:
                parts = [self.relations[p]] + [self.derived(r) for r in rules if r.head.pred == p]
                state[p] = written(self.added(p, parts), p)
                if p in self.soft_preds:
                    most = state[p].groupBy(*self.keys(p)).count().agg(F.max("count")).first()[0] or 0
                    if most > self.budget:
                        raise ProofBudget(f"a tuple of `{p}` has {most} minimal proofs, the budget is {self.budget}; declare it Prov_k")
            same = all(self.relations[p].join(state[p], state[p].columns, "left_anti").isEmpty() and state[p].join(self.relations[p], state[p].columns, "left_anti").isEmpty() for p in layer)
            self.relations.update(state)
            if same:
                return

    def incomplete(self) -> bool:
        """Whether a derivation was too deep."""
        return any(not d.isEmpty() for d in self.dropped)


NOT_INTEGER = "an aggregate met a value that is no integer"


def told(e: PySparkException) -> Exception:
    """Spark's error as the engine's."""
    text = str(e)
    if NOT_INTEGER in text:
        return NonIntegerAggregand(NOT_INTEGER)
    if "ARITHMETIC_OVERFLOW" in text:
        return Overflow("an integer leaves 64 bits")
    return e


def cheapest(edges: DataFrame, name: str, cap: Callable[[], int]) -> DataFrame:
    """Least weights of paths, in as many rounds as the most steps of a cheapest path have doublings.

    ``found`` has for each pair the least weight of up to ``m`` steps and the fewest steps that reach it; ``far`` are
    those of exactly ``m``. The first m steps of a cheapest path of m + 1 to 2 m steps are in ``far`` (a cheaper or
    shorter way there would make the path cheaper or shorter), the rest in ``found``; so each round is one join, and
    one in which no weight falls is the last. Null is infinity.
    """
    a, b, w = edges.columns[:3]
    worth = lambda c, d: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("w"), F.col(d).alias("d"))
    best = lambda df: df.groupBy("c0", "c1").agg(F.min(worth("w", "d")).alias("x")).select("c0", "c1", F.col("x")["w"].alias("w"), F.col("x")["d"].alias("d"))
    found = written(best(edges.select(F.col(a).alias("c0"), F.col(b).alias("c1"), F.col(w).alias("w"), F.lit(1).cast("bigint").alias("d"))), name)
    parts, far, m, most, lowered = [found], found, 1, None, False
    while True:
        every = functools.reduce(DataFrame.union, parts)
        if lowered:
            every = written(best(every), name)
            parts, lowered = [every], False
        start = far.select("c0", F.col("c1").alias("mid"), F.col("w").alias("w1"))
        steps = best(start.join(every.select(F.col("c0").alias("mid"), "c1", F.col("w").alias("w2"), "d"), "mid").select("c0", "c1", (F.col("w1") + F.col("w2")).alias("w"), (F.col("d") + m).alias("d")))
        old = every.select(F.col("c0").alias("o0"), F.col("c1").alias("o1"), F.col("w").alias("ow"), F.lit(True).alias("had"))
        told = steps.join(old, (F.col("c0") == F.col("o0")) & (F.col("c1") == F.col("o1")), "left")
        new = written(told.where("had is null or (w is not null and (ow is null or w < ow))").select("c0", "c1", "w", "d", F.coalesce("had", F.lit(False)).alias("had")), name)
        count, fell = new.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("had"), F.lit(False))).first()
        if not count:
            return every.select("c0", "c1", "w")
        m, lowered = m * 2, fell
        if m > COUNT_AFTER:
            most = most or cap()
            if m > 2 * most:
                raise NegativeWeightCycle("weights still fall after more steps than there are values")
        parts.append(new.select("c0", "c1", "w", "d"))
        if len(parts) > COMPACT and not lowered:
            parts = [written(functools.reduce(DataFrame.union, parts), name)]
        far = new.where(F.col("d") == m).select("c0", "c1", "w", "d")


def same_generation(run: Run, edge: str, name: str, rules: list[t.Rule]) -> DataFrame:
    """The same-generation relation over classes of nodes: pairs of classes, with their members put in at the end.

    Children of the same set of parents have the same rows, so they become one class; children of the same set of
    classes then do too, until no classes meet any more. A class's number is its smallest node. The program is run over
    the classes, and as each node is in one class, no pair comes twice.
    """
    a, b = run.relations[edge].columns[:2]
    edges = written(run.relations[edge].select(F.col(a).alias("c0"), F.col(b).alias("c1")).where("c0 is not null and c1 is not null").distinct(), name)
    maps: list[DataFrame] = []
    n = edges.select("c1").distinct().count()
    while n:
        sets = written(edges.groupBy("c1").agg(F.array_sort(F.collect_list("c0")).alias("above")), name)
        to = written(sets.join(sets.groupBy("above").agg(F.min("c1").alias("class")), "above").select(F.col("c1").alias("node"), "class"), name)
        fewer = to.select("class").distinct().count()
        if fewer == n:
            break
        maps.append(to)
        left = edges.join(to.where("node = class").select(F.col("node").alias("c1")), "c1", "left_semi")
        up = to.select(F.col("node").alias("c0"), F.col("class").alias("up"))
        edges, n = written(left.join(up, "c0", "left").select(F.coalesce("up", "c0").alias("c0"), "c1").distinct(), name), fewer
    sub = Run(run.spark, Checked({p: run.checked.decls[p] for p in (edge, name)}, rules, [], [], [], [], [[edge], [name]], {name}, False), bound={edge: edges})
    sub.folds = False
    pairs = sub.go()[name]
    if not maps:
        return pairs
    members = maps[-1]
    for to in reversed(maps[:-1]):
        members = to.join(members.select(F.col("node").alias("class"), F.col("class").alias("top")), "class").select("node", F.col("top").alias("class"))
    members = written(members, name)
    left = members.select(F.col("node").alias("x"), F.col("class").alias("c0")).join(pairs, "c0").select("x", "c1")
    return spread(left, members.select(F.col("node").alias("y"), F.col("class").alias("c1")), ["c1"]).select(F.col("x").alias("c0"), F.col("y").alias("c1"))


def spread(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The equi-join of two sides that have many rows of a key each.

    Where there are few keys, each one's rows of the larger side are dealt to parts, and the smaller side goes to all
    of them; so the rows that come out are made in many tasks, however few rows go in.
    """
    small, large = sorted((right, left), key=bytes_of)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = small.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    salts = min(SALTS, -(-MANY_KEYS * parts // max(1, n)))
    if salts == 1:
        return large.repartition(parts, *keys).join(small, keys).select(*left.columns, *(c for c in right.columns if c not in keys))
    large = large.withColumn("_part", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")).repartition(parts, *keys, "_part")
    small = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # A merge: the hash table of a broadcast side would hold all parts in each task.
    return large.join(small.hint("merge"), [*keys, "_part"]).select(*left.columns, *(c for c in right.columns if c not in keys))


def closure(edges: DataFrame, name: str = "closure") -> DataFrame:
    """Transitive closure in as many rounds as the longest shortest path has doublings.

    ``found`` has every pair with its distance, up to ``m`` steps; ``far`` those at exactly ``m``. A pair at a distance
    from m + 1 to 2 m is one of ``far`` and one of ``found``, end to end; so each round is one join, and a pair is
    derived once for each middle on its shortest paths.
    """
    a, b = edges.columns[:2]
    found = written(edges.select(F.col(a).alias("c0"), F.col(b).alias("c1")).distinct().withColumn("d", F.lit(1)), name)
    parts, far, m = [found], found, 1
    while True:
        every = functools.reduce(DataFrame.union, parts)
        steps = far.select("c0", F.col("c1").alias("mid")).join(every.select(F.col("c0").alias("mid"), "c1", "d"), "mid").groupBy("c0", "c1").agg((F.min("d") + m).cast("int").alias("d"))
        new = written(steps.join(every, ["c0", "c1"], "left_anti").select("c0", "c1", "d"), name)
        if new.isEmpty():
            return every.select("c0", "c1")
        parts.append(new)
        if len(parts) > COMPACT:
            parts = [written(functools.reduce(DataFrame.union, parts), name)]
        m *= 2
        far = new.where(F.col("d") == m)


def opposite_of(budget: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<array<bigint>>")
    def opposite(column: pd.Series) -> pd.Series:
        return column.map(lambda own: [sorted(p) for p in pf.opposite(pf.minimal(frozenset(int(v) for v in p) for p in own), budget)])

    return opposite


def marginals(run: Run, pred: str) -> DataFrame:
    """Tuples of a predicate with their probability ``p``, from worlds or from proofs."""
    relation, keys = run.relations[pred], columns(run.arity[pred])
    p = [s.p for s in run.checked.soft]
    if run.mode == "worlds":
        if pred not in run.soft_preds:
            return relation.withColumn("p", F.lit(1.0))
        weight = F.lit(1.0)
        for i, x in enumerate(p):
            weight = weight * F.when(F.expr(f"(shiftright(world, {i}) & 1) = 1"), F.lit(x)).otherwise(F.lit(1 - x))
        return relation.groupBy(*keys).agg(F.sum(weight).alias("p")).where("p > 0")

    if run.numbered:
        return counted(run, relation, keys)

    @F.pandas_udf("double")
    def count(column: pd.Series) -> pd.Series:
        return column.map(lambda own: circuits.compile_exact([[int(v) for v in x] for x in own]).count(p)).astype(float)

    return relation.groupBy(*keys).agg(F.collect_list("pf").alias("pf")).select(*keys, count("pf").alias("p"))


def lifted_marginals(spark: SparkSession, checked: Checked, pred: str, bound: dict[str, DataFrame]) -> DataFrame | None:
    """Marginals of a predicate whose tuples each hang on one binding of the soft atoms' variables; else None.

    The soft part of the body is solved in worlds on its own variables, and the certain part is joined with the
    probabilities; so no row of the result is made once for each world.
    """
    own = [r for r in checked.rules if r.head.pred == pred]
    used = any(b.atom.pred == pred for r in checked.rules for b in r.body)
    given = pred in bound or any(f[0] == pred for f in checked.facts) or any(x.pred == pred for x in checked.soft)
    if len(own) != 1 or used or given or checked.kind(pred) != "bool":
        return None
    (rule,) = own
    run = Run(spark, checked, "worlds", bound)
    flat = all(not b.negated for b in rule.body) and all(not isinstance(a, t.Compound | t.Agg) for x in (rule.head, *(b.atom for b in rule.body)) for a in x.args)
    soft = [b for b in rule.body if b.atom.pred in run.soft_preds]
    hard = [b for b in rule.body if b.atom.pred not in run.soft_preds]
    if not flat or not soft or not hard or any(en.TAG in run.kinds[b.atom.pred] for b in rule.body):
        return None
    certain = {v for b in hard for v in t.atom_variables(b.atom)}
    shared = sorted({v for b in soft for v in t.atom_variables(b.atom)} & (certain | set(t.atom_variables(rule.head))))
    chances, result, p = "#chances", "#result", t.Var("#p")
    decl = lambda name, n: t.Predicate(name, (("int",),) * n, t.Annotation("bool"))
    args = tuple(map(t.Var, shared))
    part = Checked({**{k: d for k, d in checked.decls.items() if k != pred}, chances: decl(chances, len(args))}, [r for r in checked.rules if r is not rule] + [t.Rule(t.Atom(chances, args), tuple(soft))], checked.facts, checked.soft, [], [], [[chances if k == pred else k for k in layer] for layer in checked.layers], checked.recursive, checked.terms)
    run = Run(spark, part, "worlds", bound)
    run.go()
    found = marginals(run, chances)
    tables = {b.atom.pred: run.relations[b.atom.pred].select(*columns(run.arity[b.atom.pred])) for b in hard if run.arity[b.atom.pred]}
    tables[chances] = written(found.select(*(columns(len(args)) if args else []), F.col("p").cast("string").alias("p")), "chances")
    head = t.Atom(result, (*rule.head.args, *args, p))
    joint = t.Rule(head, (*(b for b in hard if run.arity[b.atom.pred]), t.Literal(t.Atom(chances, (*args, p)))))
    if any(not run.arity[b.atom.pred] for b in hard):
        return None
    decls = {**{k: checked.decls[k] for k in tables if k != chances}, chances: decl(chances, len(args) + 1), result: decl(result, len(head.args))}
    last = Run(spark, Checked(decls, [joint], [], [], [], [], [*([k] for k in tables), [result]], set(), False), bound=tables)
    for k in tables:
        last.layer([k])
    if not set(shared) <= last.determined(set(t.atom_variables(rule.head)), t.Rule(rule.head, tuple(hard))):
        return None
    last.layer([result])
    n = len(rule.head.args)
    return last.relations[result].select(*(F.col(f"c{i}") for i in range(n)), F.col(f"c{n + len(args)}").cast("double").alias("p"))


def counted(run: Run, relation: DataFrame, keys: list[str]) -> DataFrame:
    """Tuples with ``p``, where leaves' probabilities are a table: each tuple gets those of its own proofs."""
    used = relation.select(*keys, F.explode("pf").alias("x")).select(*keys, F.abs("x").alias("leaf")).distinct().join(run.leaves, "leaf")
    chances = used.groupBy(*keys).agg(F.collect_list(F.struct("leaf", "p")).alias("chances"))
    both = relation.groupBy(*keys).agg(F.collect_list("pf").alias("pf")).join(chances, keys, "left")

    @F.pandas_udf("double")
    def count(proofs: pd.Series, leaves: pd.Series) -> pd.Series:
        out = []
        for own, known in zip(proofs, leaves):
            known = [] if known is None else list(known)
            place = {int(x["leaf"]): i + 1 for i, x in enumerate(known)}
            renamed = [[place[abs(int(v))] * (1 if v > 0 else -1) for v in x] for x in own]
            out.append(circuits.compile_exact(renamed).count([float(x["p"]) for x in known]))
        return pd.Series(out, dtype=float)

    return both.select(*keys, count("pf", "chances").alias("p"))


def world_gradients(run: Run, pred: str) -> DataFrame:
    """Tuples with ``p`` and ``grad`` from all worlds: a world's weight, and its derivative by every leaf."""
    relation, keys, p = run.relations[pred], columns(run.arity[pred]), [s.p for s in run.checked.soft]
    if pred not in run.soft_preds:
        return relation.select(*keys, F.lit(1.0).alias("p"), F.array(*[F.lit(0.0) for _ in p]).cast("array<double>").alias("grad"))
    on = [F.expr(f"(shiftright(world, {i}) & 1) = 1") for i in range(len(p))]
    factors = [F.when(c, F.lit(float(x))).otherwise(F.lit(float(1 - x))) for c, x in zip(on, p)]
    product = lambda parts: functools.reduce(lambda a, b: a * b, parts, F.lit(1.0))
    slopes = [F.when(c, 1.0).otherwise(-1.0) * product(factors[:i] + factors[i + 1 :]) for i, c in enumerate(on)]
    sums = relation.groupBy(*keys).agg(F.sum(product(factors)).alias("p"), *[F.sum(x).alias(f"g{i}") for i, x in enumerate(slopes)])
    return sums.select(*keys, "p", F.array(*[f"g{i}" for i in range(len(p))]).alias("grad"))


def gradients(run: Run, pred: str) -> DataFrame:
    """Tuples with ``p`` and ``grad``, the derivative by every leaf's probability, from captured proofs."""
    keys = columns(run.arity[pred])
    p = [s.p for s in run.checked.soft]

    @F.pandas_udf("struct<p double, grad array<double>>")
    def both(column: pd.Series) -> pd.DataFrame:
        made = [circuits.count_and_gradient([[int(v) for v in x] for x in own], p) for own in column]
        return pd.DataFrame({"p": [m[0] for m in made], "grad": [m[1] for m in made]})

    return run.relations[pred].groupBy(*keys).agg(F.collect_list("pf").alias("pf")).select(*keys, both("pf").alias("g")).select(*keys, "g.*")


def proof_lists(run: Run, pred: str) -> DataFrame:
    """Tuples with ``proofs``, an ordered array of ordered arrays."""
    keys = columns(run.arity[pred])
    return run.relations[pred].groupBy(*keys).agg(F.array_sort(F.collect_list("pf")).alias("proofs"))
