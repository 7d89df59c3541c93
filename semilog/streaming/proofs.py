"""Proofs kept up to date under inserts and deletes of soft facts."""

from __future__ import annotations

from semilog.errors import Unsupported
from semilog.functions import proofs as pf
from semilog.lang.checker import Checked, Soft
from semilog.plans import local


class MaintainedProofs:
    """Minimal proofs of all tuples. Deleted leaves keep their number, so proofs stay comparable."""

    def __init__(self, checked: Checked):
        if checked.terms or any(b.negated for r in checked.rules for b in r.body):
            raise Unsupported("proofs are maintained for programs without negation and terms")
        self.checked, self.gone = checked, set()
        self.engine = local.proofs(checked)

    def proofs(self, pred: str) -> dict[tuple, pf.Proofs]:
        return dict(self.engine.db[pred].rows)

    def insert_soft(self, pred: str, args: tuple, p: float) -> int:
        """Adds a soft fact and all proofs that use it; gives its leaf."""
        self.checked.soft.append(Soft(pred, tuple(args), p))
        self.engine.algebra.p.append(p)
        leaf = len(self.checked.soft) - 1
        self.resume([(pred, tuple(args), frozenset([frozenset([leaf + 1])]))])
        return leaf

    def delete_soft(self, leaf: int) -> None:
        """Takes out all proofs that use a leaf; bounded predicates fill up with the next likeliest."""
        if leaf in self.gone or not 0 <= leaf < len(self.checked.soft):
            raise ValueError(f"no soft fact {leaf}")
        self.gone.add(leaf)
        for relation in self.engine.db.values():
            for row, own in list(relation.rows.items()):
                kept = frozenset(x for x in own if leaf + 1 not in x)
                if kept:
                    relation.rows[row] = kept
                else:
                    del relation.rows[row]
            relation.indexes.clear()
        self.resume([])

    def resume(self, start: list[tuple]) -> None:
        """Runs all rules over the present state until no proofs change."""
        for m in start:
            self.engine.merge(*m)
        for layer in self.checked.layers:
            rules = [r for r in self.checked.rules if r.head.pred in layer]
            self.engine.naive(rules, set(layer), 0)
        return None
