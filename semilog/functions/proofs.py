"""Proofs in disjunctive normal form.

A proof is a frozenset of signed literals (leaf + 1, negative for the absence of that soft fact); a set of proofs is
kept minimal: no proof holds both a literal and its opposite, and none contains another.
"""

from __future__ import annotations

from collections.abc import Iterable

from semilog.errors import ProofBudget

Proof = frozenset[int]
Proofs = frozenset[Proof]

CERTAIN: Proofs = frozenset([frozenset()])
NONE: Proofs = frozenset()
BUDGET = 10_000


def contradicts(proof: Proof) -> bool:
    return any(-x in proof for x in proof)


def minimal(proofs: Iterable[Proof]) -> Proofs:
    """Without contradictions and without proofs that contain another."""
    kept: list[Proof] = []
    for p in sorted({frozenset(p) for p in proofs}, key=len):
        if not contradicts(p) and not any(k <= p for k in kept):
            kept.append(p)
    return frozenset(kept)


def either(a: Proofs, b: Proofs) -> Proofs:
    return a if a == b or not b else b if not a else minimal([*a, *b])


def both(a: Proofs, b: Proofs, budget: int = BUDGET) -> Proofs:
    if a == CERTAIN:
        return b
    if b == CERTAIN:
        return a
    made = minimal(x | y for x in a for y in b)
    return within(made, budget)


def within(proofs: Proofs, budget: int) -> Proofs:
    if len(proofs) > budget:
        raise ProofBudget(f"a tuple has {len(proofs)} minimal proofs, the budget is {budget}; declare its predicate Prov_k")
    return proofs


def opposite(a: Proofs, budget: int = BUDGET) -> Proofs:
    """Proofs that none of ``a`` holds."""
    out: Proofs = CERTAIN
    for p in sorted(a, key=sorted):
        out = within(minimal(x | {-lit} for x in out for lit in p), budget)
    return out


def weight(proof: Iterable[int], p: list[float]) -> float:
    out = 1.0
    for lit in sorted(proof, key=abs):
        out *= p[lit - 1] if lit > 0 else 1 - p[-lit - 1]
    return out


def best(proofs: Proofs, k: int, p: list[float]) -> Proofs:
    """The ``k`` likeliest proofs; ties by their literals."""
    return frozenset(sorted(proofs, key=lambda x: (-weight(x, p), sorted(x)))[:k])


def lists(proofs: Proofs) -> list[list[int]]:
    """Ordered lists, for output."""
    return sorted(sorted(p, key=lambda x: (abs(x), x < 0)) for p in proofs)
