"""Syntax tree of a program, and values.

Values at run time are plain Python: ``str`` for symbols, ``int`` for integers, and ``(functor, *args)`` tuples for
compound terms.
"""

from __future__ import annotations

from dataclasses import dataclass, field

VERSION = "0.1.0"
DEFAULT_TOP_K = 3

#: A run-time value.
Value = str | int | tuple


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    name: str


@dataclass(frozen=True)
class Int:
    value: int


@dataclass(frozen=True)
class Agg:
    op: str
    var: str


@dataclass(frozen=True)
class Compound:
    functor: str
    args: tuple[Term, ...]


Term = Var | Const | Int | Agg | Compound


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[Term, ...]


@dataclass(frozen=True)
class Literal:
    atom: Atom
    negated: bool = False


@dataclass(frozen=True)
class Annotation:
    """``bool``, ``trop``, ``prov`` or ``prov_k`` with its bound."""

    kind: str
    k: int | None = None

    def coerces_to(self, other: Annotation) -> bool:
        return self.kind == "bool" or self.kind == other.kind or (self.kind, other.kind) == ("prov", "prov_k")


@dataclass(frozen=True)
class Domain:
    name: str


@dataclass(frozen=True)
class Predicate:
    """args: ``("domain", name)``, ``("int",)`` or ``("term", name)``."""

    name: str
    args: tuple[tuple[str, ...], ...]
    annotation: Annotation
    effects: tuple[str, ...] = ()
    model: str | None = None


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Literal, ...]


@dataclass(frozen=True)
class Fact:
    atom: Atom
    weight: int | None = None
    prob: float | None = None


@dataclass(frozen=True)
class Input:
    pred: str
    path: str


@dataclass(frozen=True)
class Query:
    """kind: ``plain``, ``prob`` or ``grad``."""

    kind: str
    atom: Atom


@dataclass(frozen=True)
class Pragma:
    name: str


@dataclass
class Item:
    """A statement with its place in the source and the comments before it."""

    node: Domain | Predicate | Rule | Fact | Input | Query | Pragma
    span: tuple[int, int] = (0, 0)
    comments: list[str] = field(default_factory=list)
    blank_before: bool = False

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Item) and self.node == other.node


@dataclass
class Program:
    items: list[Item]
    trailing: list[str] = field(default_factory=list)

    def nodes(self, kind: type) -> list:
        return [i.node for i in self.items if isinstance(i.node, kind)]


def variables(term: Term) -> list[str]:
    """Names of variables in order, repeats included."""
    if isinstance(term, Var):
        return [term.name]
    if isinstance(term, Agg):
        return [term.var]
    if isinstance(term, Compound):
        return [v for a in term.args for v in variables(a)]
    return []


def atom_variables(atom: Atom) -> list[str]:
    return [v for a in atom.args for v in variables(a)]


def ground(term: Term) -> Value:
    """The value of a term without variables."""
    if isinstance(term, Const):
        return term.name
    if isinstance(term, Int):
        return term.value
    if isinstance(term, Compound):
        return (term.functor, *map(ground, term.args))
    raise ValueError(f"{term} isn't ground")


def show(value: Value) -> str:
    """A value as text; a compound as ``f(a, b)``."""
    return f"{value[0]}({', '.join(map(show, value[1:]))})" if isinstance(value, tuple) else str(value)


def depth(value: Value) -> int:
    return 1 + max((depth(a) for a in value[1:]), default=0) if isinstance(value, tuple) else 0
