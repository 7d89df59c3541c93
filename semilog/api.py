"""Programs: compile, fill, evaluate on one machine or over DataFrames, and ask."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.asp import solve as asp
from semilog.asp.ground import Constraint
from semilog.errors import EvalError
from semilog.functions import circuits
from semilog.functions import proofs as pf
from semilog.lang import codec
from semilog.lang import tree as t
from semilog.lang.checker import Checked, check
from semilog.lang.diagnostics import ProgramError
from semilog.lang.reader import read
from semilog.plans import distributed, encoding, local, worlds
from semilog.sources import files
from semilog.sources import models as mdl

#: Rows up to which a program without bound DataFrames is run in this process.
LOCAL_ROWS = 200_000

wmc = circuits.count
wmc_grad = circuits.count_and_gradient


class Program:
    """A checked program with its facts."""

    def __init__(self, checked: Checked):
        self.checked = checked
        self.bound: dict[str, DataFrame] = {}
        self.soft_bound: dict[str, DataFrame] = {}

    # --- facts from outside

    def load_inputs(self, base: str = ".") -> Program:
        """Facts of the program's ``input`` files."""
        files.load_inputs(self.checked, base)
        return self

    def attach_models(self, models: dict[str, Callable[[], Iterable]]) -> Program:
        """Soft facts of neural predicates' models, each a callable that gives ``(pred, args, p)``."""
        mdl.attach_models(self.checked, models)
        return self

    def bind(self, pred: str, df: DataFrame) -> Program:
        """A predicate's tuples from a DataFrame of any size: its arguments in order, then a Trop predicate's weight.

        One more column of fractions, of a Bool predicate, is the probability of each row as a soft fact of its own.
        """
        decl = self.decl(pred)
        trop = decl.annotation.kind == "trop"
        wanted = len(decl.args) + trop
        if not trop and len(df.columns) == wanted + 1 and isinstance(df.schema.fields[-1].dataType, T.FractionalType):
            self.soft_bound[pred] = df
        elif len(df.columns) == wanted:
            self.bound[pred] = df
        else:
            raise EvalError(f"`{pred}` needs {wanted} columns, not {len(df.columns)}")
        return self

    def bind_file(self, spark: SparkSession, pred: str, path: str) -> Program:
        """A predicate's tuples from files of any size, checked as they are read."""
        return self.bind(pred, files.scan(spark, path, self.decl(pred)))

    def decl(self, pred: str) -> t.Predicate:
        if pred not in self.checked.decls:
            raise ValueError(f"unknown predicate `{pred}`")
        return self.checked.decls[pred]

    @property
    def outside(self) -> dict[str, DataFrame]:
        """The bound DataFrames, soft ones included."""
        return {**self.bound, **self.soft_bound}

    # --- on one machine

    def eval(self) -> dict[str, list[tuple]]:
        """Every predicate's rows, ordered; a Trop predicate's end with the weight (``inf`` for infinity).

        Soft facts don't count here.
        """
        if self.outside:
            raise EvalError("DataFrames are bound; use frames()")
        engine = local.plain(self.checked, budget_rows=LOCAL_ROWS * 10)
        return {p: ordered_rows(r.rows, self.checked.kind(p) == "trop") for p, r in engine.db.items()}

    def pattern(self, pred: str, pattern) -> tuple:
        decl = self.decl(pred)
        pattern = tuple([None] * len(decl.args) if pattern is None else pattern)
        if len(pattern) != len(decl.args):
            raise ValueError(f"`{pred}` has {len(decl.args)} arguments, the pattern {len(pattern)}")
        return pattern

    def prob_query(self, pred: str, pattern=None) -> list[tuple[tuple, float]]:
        """Matching tuples with their probability; None in the pattern is open.

        Where DataFrames are bound the program runs over them, and the matching tuples are collected.
        """
        if self.soft_bound:
            run, pattern = self.run(self.session, "proofs"), self.pattern(pred, pattern)
            return [(row, r.p) for row, r in self.collected(run, pred, distributed.marginals(run, pred), pattern) if r.p > 0]
        return [(row, p) for row, p, _ in self.graded(pred, pattern) if p > 0]

    def grad_query(self, pred: str, pattern=None) -> list[tuple[tuple, float, list[float]]]:
        """Matching tuples with probability and gradient by every soft fact."""
        return self.graded(pred, pattern)

    def graded(self, pred: str, pattern) -> list[tuple[tuple, float, list[float]]]:
        pattern = self.pattern(pred, pattern)
        if self.outside:
            return self.graded_frames(pred, pattern)
        if pred in self.checked.modes:
            worlds.guard(self.checked, False)
            p = [s.p for s in self.checked.soft]
            found = {row: circuits.count_and_gradient(own, p) for row, own in local.proofs(self.checked).db[pred].rows.items()}
        else:
            found = worlds.marginals(self.checked)[pred]
        rows = [row for row in found if all(x is None or x == v and type(x) is type(v) for x, v in zip(pattern, row))]
        return [(row, *found[row]) for row in sorted(rows, key=row_key)]

    @property
    def session(self) -> SparkSession:
        return next(iter(self.outside.values())).sparkSession

    def collected(self, run: distributed.Run, pred: str, df: DataFrame, pattern=None) -> list[tuple[tuple, Row]]:
        """Rows of a predicate that match a pattern, each behind its tuple, in order."""
        kinds = run.kinds[pred]
        for i, value in enumerate(pattern or ()):
            if value is not None:
                own = encoding.literal(value, kinds[i])
                df = df.where(F.lit(False) if own is None else F.col(f"c{i}") == own)
        rows = [(tuple(encoding.load(r[f"c{i}"], k) for i, k in enumerate(kinds)), r) for r in df.collect()]
        return sorted(rows, key=lambda x: row_key(x[0]))

    def graded_frames(self, pred: str, pattern: tuple) -> list[tuple[tuple, float, list[float]]]:
        if self.soft_bound:
            raise EvalError("gradients by soft facts of DataFrames aren't listed; use marginal_frame()")
        captured = pred in self.checked.modes or len(self.checked.soft) > distributed.MAX_SOFT
        run = self.run(self.session, "proofs" if captured else "worlds")
        made = (distributed.gradients if captured else distributed.world_gradients)(run, pred)
        return [(row, r.p, list(r.grad)) for row, r in self.collected(run, pred, made, pattern)]

    def provenance(self) -> dict[str, list[tuple[tuple, list[list[int]]]]]:
        """Every predicate's tuples with their minimal proofs (signed literals; soft fact i is i + 1)."""
        if self.outside:
            run = self.run(self.session, "proofs")
            return {p: [(row, sorted(sorted(x) for x in r.proofs)) for row, r in self.collected(run, p, distributed.proof_lists(run, p))] for p in self.checked.decls}
        worlds.guard(self.checked, False)
        db = local.proofs(self.checked).db
        return {p: [(row, pf.lists(r.rows[row])) for row in sorted(r.rows, key=row_key)] for p, r in db.items()}

    def prob_facts(self) -> list[tuple[str, tuple, float]]:
        return [(s.pred, s.args, s.p) for s in self.checked.soft]

    def queries(self) -> list[tuple[str, str, tuple]]:
        """(kind, predicate, pattern) of the program's queries."""
        return [(q.kind, q.atom.pred, tuple(t.ground(a) if isinstance(a, t.Const | t.Int) else None for a in q.atom.args)) for q in self.checked.queries]

    # --- over DataFrames

    def run(self, spark: SparkSession, mode: str = "plain") -> distributed.Run:
        """A finished distributed run: mode ``plain``, ``worlds`` or ``proofs``."""
        run = distributed.Run(spark, self.checked, mode, self.bound, self.soft_bound)
        run.go()
        return run

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Every predicate as a DataFrame (columns c0, c1, ..., and w for Trop, null for infinity).

        Without bound DataFrames a small program is run in this process, which spares a Spark job for each round; one
        that grows beyond ``LOCAL_ROWS`` rows is run over DataFrames.
        """
        if not self.outside:
            try:
                return self.local_frames(spark, local.plain(self.checked, budget_rows=LOCAL_ROWS))
            except local.TooLarge:
                pass
        return self.run(spark).relations

    def local_frames(self, spark: SparkSession, engine: local.Engine) -> dict[str, DataFrame]:
        run = distributed.Run(spark, self.checked)
        out = {}
        for p, r in engine.db.items():
            rows = [tuple(encoding.store(v, k) for v, k in zip(row, run.kinds[p])) or (0,) for row in r.rows]
            if run.extra(p):
                rows = [(*row, None if w == math.inf else w) for row, w in zip(rows, r.rows.values())]
            out[p] = run.frame(p, rows)
        return out

    def marginal_frame(self, spark: SparkSession, pred: str) -> DataFrame:
        """Tuples with ``p``, by capture for predicates with provenance and over all worlds otherwise."""
        mode = "proofs" if self.soft_bound or pred in self.checked.modes or len(self.checked.soft) > distributed.MAX_SOFT else "worlds"
        if mode == "worlds" and (found := distributed.lifted_marginals(spark, self.checked, pred, self.bound)) is not None:
            return found
        return distributed.marginals(self.run(spark, mode), pred)


def row_key(row: tuple):
    return [(2, 0, t.show(v)) if isinstance(v, tuple) else (1, v, "") if type(v) is int else (0, 0, v) for v in row]


def ordered_rows(rows: dict, trop: bool) -> list[tuple]:
    return [(*row, float("inf") if rows[row] == math.inf else rows[row]) if trop else row for row in sorted(rows, key=row_key)]


def compile(source: str) -> Program:  # noqa: A001
    """A program from source text; raises ``ProgramError`` with all diagnostics."""
    program, found = read(source)
    if found:
        raise ProgramError(found, source)
    return Program(check(program, source))


def compile_json(text: str) -> Program:
    """A program from its JSON."""
    return Program(check(codec.from_json(text)))


def asp_models(source: str, constraints: Iterable[Constraint] = ()) -> list[list[tuple[str, tuple]]]:
    """The stable models of an ``@asp`` program, ordered."""
    program, found = read(source)
    if found:
        raise ProgramError(found, source)
    check(t.Program([t.Item(t.Pragma("asp")), *(i for i in program.items if i.node != t.Pragma("asp"))]), source)
    return asp.solve(program.nodes(t.Rule), [f.atom for f in program.nodes(t.Fact)], list(constraints))
