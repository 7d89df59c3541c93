"""Results as text."""

from __future__ import annotations

import math

from semilog.functions import circuits
from semilog.functions import proofs as pf
from semilog.lang import tree as t
from semilog.lang.checker import Checked
from semilog.plans.local import Engine


class InternOrder:
    """Orders values as symbols first (by first appearance in the program), then integers, then terms."""

    def __init__(self, checked: Checked):
        self.at: dict[str, int] = {}
        for pred, args, *_ in [*checked.facts, *((s.pred, s.args) for s in checked.soft)]:
            for a in args:
                self.note(a)
        for r in checked.rules:
            for a in (r.head, *(b.atom for b in r.body)):
                for x in a.args:
                    if isinstance(x, t.Const):
                        self.note(x.name)

    def note(self, value) -> None:
        if isinstance(value, tuple):
            for a in value[1:]:
                self.note(a)
        elif type(value) is str:
            self.at.setdefault(value, len(self.at))

    def key(self, value):
        if type(value) is str:
            return (0, self.at.get(value, len(self.at)), value)
        if type(value) is int:
            return (1, value, "")
        return (2, t.depth(value), t.show(value))

    def rows(self, rows) -> list[tuple]:
        return sorted(rows, key=lambda r: tuple(map(self.key, r)))


def number(x: float) -> str:
    """The shortest text of a float; whole numbers without a point."""
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else repr(x)


def fits(args: tuple, query: t.Query) -> bool:
    """Whether a tuple has the query's ground symbols and integers; all other places are open."""
    return len(args) == len(query.atom.args) and all(not isinstance(a, t.Const | t.Int) or t.ground(a) == v and type(v) is type(t.ground(a)) for a, v in zip(query.atom.args, args))


def line(pred: str, args: tuple) -> str:
    return f"{pred}({', '.join(map(t.show, args))})"


def relations(checked: Checked, engine: Engine) -> str:
    """All relations by name; with plain queries, only what they ask for. Weights of Trop predicates stand behind."""
    order = InternOrder(checked)
    asked = [q for q in checked.queries if q.kind == "plain"]
    out = []
    for pred in sorted(engine.db):
        own = [q for q in asked if q.atom.pred == pred]
        if asked and not own:
            continue
        for row in order.rows(engine.db[pred].rows):
            if own and not any(fits(row, q) for q in own):
                continue
            w = engine.db[pred].rows[row]
            out.append(line(pred, row) + (f" = {'inf' if w == math.inf else w}" if checked.kind(pred) == "trop" else "") + "\n")
    return "".join(out) + status(checked, engine)


def status(checked: Checked, engine: Engine) -> str:
    """Says that derivations were too deep, if some were."""
    return f"% status: Sound (possibly incomplete) — {engine.dropped} derivation(s) dropped at depth bound {checked.max_depth}\n" if engine.dropped else ""


def marginal(checked: Checked, pred: str, row: tuple, p: float) -> str:
    d = checked.decls[pred].annotation
    return f"{number(p)} :: {line(pred, row)}" + (f"  (lower bound, top-{d.k})" if d.kind == "prov_k" else "") + "\n"


def soft_fact(checked: Checked, leaf: int) -> str:
    s = checked.soft[leaf]
    return f"{number(s.p)} :: {line(s.pred, s.args)}"


def proof(checked: Checked, own: pf.Proof) -> str:
    """A proof's soft facts joined by ∧; ⊤ if there are none, ¬ before absent ones."""
    return " ∧ ".join(("¬" if x < 0 else "") + f"[{soft_fact(checked, abs(x) - 1)}]" for x in sorted(own, key=lambda x: (abs(x), x < 0))) or "⊤"


def pedigrees(checked: Checked, engine: Engine) -> str:
    """Every tuple with its probability, and the proofs of those that have provenance."""
    order, p, out = InternOrder(checked), [s.p for s in checked.soft], []
    for pred in sorted(engine.db):
        for row in order.rows(engine.db[pred].rows):
            own = engine.db[pred].rows[row]
            out.append(f"{line(pred, row)}\n" if frozenset() in own else marginal(checked, pred, row, circuits.compile_exact(own).count(p)))
            if pred in checked.modes:
                out += [f"  ⇐ {proof(checked, frozenset(x))}\n" for x in pf.lists(own)]
    out += [f"% status: lower bound (Prov_k) — {pred}: top-{k} proofs per tuple\n" for pred, k in sorted(checked.modes.items()) if k is not None]
    return "".join(out)


def gradient(checked: Checked, grad: list[float]) -> str:
    """One line for each soft fact, with its model if it has one."""
    out = []
    for i, s in enumerate(checked.soft):
        model = checked.decls[s.pred].model
        out.append(f"  ∂/∂[{soft_fact(checked, i)}] = {number(grad[i])}" + (f'  (→ model "{model}")' if model else "") + "\n")
    return "".join(out)
