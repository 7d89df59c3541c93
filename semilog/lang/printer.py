"""Prints a syntax tree as source text; reading that gives the tree again."""

from __future__ import annotations

from semilog.lang import tree as t
from semilog.lang.reader import ANNOTATIONS

NAMES = {v: k for k, v in ANNOTATIONS.items()}


def term(x: t.Term) -> str:
    if isinstance(x, t.Var | t.Const):
        return x.name
    if isinstance(x, t.Int):
        return str(x.value)
    if isinstance(x, t.Agg):
        return f"{x.op}<{x.var}>"
    return f"{x.functor}({', '.join(map(term, x.args))})"


def atom(a: t.Atom) -> str:
    return f"{a.pred}({', '.join(map(term, a.args))})"


def number(p: float) -> str:
    """A float that the reader takes: digits on both sides of the point."""
    text = repr(p)
    if "e" in text or "." not in text:
        text = f"{p:.20f}".rstrip("0")
        text += "0" if text.endswith(".") else ""
    return text


def node(n) -> str:
    if isinstance(n, t.Domain):
        return f"domain {n.name}."
    if isinstance(n, t.Predicate):
        args = ", ".join("int" if a[0] == "int" else f"term {a[1]}" if a[0] == "term" else a[1] for a in n.args)
        if n.model is not None:
            return f'neural {n.name}({args}) from model "{n.model}".'
        kind = NAMES[n.annotation.kind] + (f"({n.annotation.k})" if n.annotation.kind == "prov_k" else "")
        return f"pred {n.name}({args}): {' '.join([kind, *n.effects])}."
    if isinstance(n, t.Rule):
        return f"{atom(n.head)} :- {', '.join(('not ' if b.negated else '') + atom(b.atom) for b in n.body)}."
    if isinstance(n, t.Fact):
        head = f"{n.weight} :: " if n.weight is not None else f"{number(n.prob)} :: " if n.prob is not None else ""
        return f"{head}{atom(n.atom)}."
    if isinstance(n, t.Input):
        return f'input {n.pred} from "{n.path}".'
    if isinstance(n, t.Query):
        return f"{'?' if n.kind == 'plain' else f'?{n.kind} '}{atom(n.atom)}."
    return f"@{n.name}."


def print_program(program: t.Program) -> str:
    lines = []
    for item in program.items:
        if item.blank_before and lines:
            lines.append("")
        lines += [*item.comments, node(item.node)]
    return "".join(f"{line}\n" for line in [*lines, *program.trailing])
