"""Values in columns.

A column that holds only integers is a bigint, one that holds only symbols a string, and any other a string of JSON
that tells kinds apart: ``5``, ``"a"``, ``["f",5,"a"]``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from semilog.lang import tree as t

INT, SYM, TAG = "int", "sym", "tag"
SPARK_TYPE = {INT: "bigint", SYM: "string", TAG: "string"}


def tagged(value) -> str:
    """A value as its JSON."""
    return json.dumps(to_lists(value), ensure_ascii=False, separators=(",", ":"))


def to_lists(value):
    return [value[0], *map(to_lists, value[1:])] if isinstance(value, tuple) else value


def from_lists(value):
    return (value[0], *map(from_lists, value[1:])) if isinstance(value, list) else value


def untagged(text: str):
    return from_lists(json.loads(text))


def store(value, kind: str):
    return tagged(value) if kind == TAG else value


def load(value, kind: str):
    return untagged(value) if kind == TAG else value


def kind_of(value) -> str:
    return INT if type(value) is int else SYM if type(value) is str else "term"


def storage(kinds: set[str]) -> str:
    return INT if kinds == {INT} else SYM if kinds <= {SYM} else TAG


def quoted(c: Column) -> Column:
    """A symbol's JSON, the same as ``tagged`` gives."""
    text = F.to_json(F.array(c))
    return F.substring(text, 2, F.length(text) - 2)


def convert(c: Column, have: str, want: str) -> Column:
    if have == want:
        return c
    if want == TAG:
        return c.cast("string") if have == INT else quoted(c)
    if have == TAG:  # values of other kinds can't be there, as a join with a column of this kind has shown
        return c.try_cast("bigint") if want == INT else F.try_variant_get(F.try_parse_json(c), "$", "string")
    raise ValueError(f"a {have} column can't be read as {want}")


def literal(value, kind: str) -> Column | None:
    """A constant as it stands in a column of that kind; None if it can't be in there."""
    if kind == TAG:
        return F.lit(tagged(value))
    return F.lit(value) if kind_of(value) == kind else None


def construct(functor: str, args: list[Column]) -> Column:
    """A compound's JSON from tagged arguments."""
    return F.concat(F.lit(f'["{functor}",'), F.concat_ws(",", *args), F.lit("]"))


def functor_is(c: Column, functor: str, arity: int) -> Column:
    """Whether a tagged value is a compound of that functor and arity."""
    return (F.json_array_length(c) == arity + 1) & c.startswith(f'["{functor}",')


def part(c: Column, i: int) -> Column:
    """The tagged value of a compound's argument."""
    return F.to_json(F.variant_get(F.try_parse_json(c), f"$[{i + 1}]", "variant"))


def depth(c: Column) -> Column:
    """Nesting of a tagged value: the most brackets open at once outside of strings."""
    marks = F.regexp_replace(F.regexp_replace(c, r'"(\\.|[^"\\])*"', ""), r"[^\[\]]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["open"] + F.when(mark == "[", 1).when(mark == "]", -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step, lambda s: s["most"])


def infer(arity: dict[str, int], given: dict[str, list[set[str]]], rules: list[t.Rule]) -> dict[str, list[str]]:
    """The storage of every predicate's columns, from the kinds that facts and inputs bring and rules carry on."""
    kinds = {p: [set(k) for k in given.get(p, [set()] * n)] for p, n in arity.items()}
    every = {INT, SYM, "term"}

    def of_var(rule: t.Rule, name: str) -> set[str]:
        seen = [kinds[b.atom.pred][i] for b in rule.body if not b.negated for i, a in enumerate(b.atom.args) if isinstance(a, t.Var) and a.name == name]
        if not seen:
            return every
        common = reduce(lambda a, b: a & b, seen)
        return common if common else set().union(*seen)

    changed = True
    while changed:
        changed = False
        for rule in rules:
            for i, a in enumerate(rule.head.args):
                new = {INT} if isinstance(a, t.Int) else {SYM} if isinstance(a, t.Const) else {"term"} if isinstance(a, t.Compound) else {INT} if isinstance(a, t.Agg) and a.op == "count" else of_var(rule, a.var if isinstance(a, t.Agg) else a.name)
                if isinstance(a, t.Agg):
                    new = {INT}
                if not new <= kinds[rule.head.pred][i]:
                    kinds[rule.head.pred][i] |= new
                    changed = True
    return {p: [storage(k) for k in own] for p, own in kinds.items()}
