"""Circuits of proofs: exact compilation, weighted counts and gradients."""

from __future__ import annotations

from collections import Counter

from semilog.errors import BadProbability, CircuitBudget
from semilog.functions import proofs as pf

MAX_NODES = 1 << 20


class Circuit:
    """Nodes in topological order: ("lit", literal), ("and", a, b), ("or", a, b), ("true",), ("false",)."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.at: dict[tuple, int] = {}
        self.root = 0

    def add(self, *node) -> int:
        found = self.at.get(node)
        if found is None:
            found = self.at[node] = len(self.nodes)
            self.nodes.append(node)
        return found

    def leaf(self, i: int) -> int:
        return self.add("lit", i + 1)

    def neg_leaf(self, i: int) -> int:
        return self.add("lit", -i - 1)

    def all_of(self, parts: list[int]) -> int:
        out = self.add("true") if not parts else parts[0]
        for p in parts[1:]:
            out = self.add("and", out, p)
        return out

    def any_of(self, parts: list[int]) -> int:
        out = self.add("false") if not parts else parts[0]
        for p in parts[1:]:
            out = self.add("or", out, p)
        return out

    def finish(self, root: int) -> Circuit:
        self.root = root
        return self

    def values(self, p: list[float]) -> list[float]:
        out: list[float] = []
        for kind, *x in self.nodes:
            if kind == "lit":
                out.append(p[x[0] - 1] if x[0] > 0 else 1 - p[-x[0] - 1])
            elif kind == "and":
                out.append(out[x[0]] * out[x[1]])
            elif kind == "or":
                out.append(out[x[0]] + out[x[1]])
            else:
                out.append(1.0 if kind == "true" else 0.0)
        return out

    def count(self, p: list[float]) -> float:
        """The weighted model count; disjuncts must exclude each other."""
        return self.values(p)[self.root]

    def gradient(self, p: list[float]) -> list[float]:
        """The count's derivative by every leaf's probability, in one pass backwards."""
        value, back, out = self.values(p), [0.0] * len(self.nodes), [0.0] * len(p)
        back[self.root] = 1.0
        for i in range(len(self.nodes) - 1, -1, -1):
            kind, *x = self.nodes[i]
            if kind == "lit":
                out[abs(x[0]) - 1] += back[i] if x[0] > 0 else -back[i]
            elif kind == "and":
                back[x[0]] += back[i] * value[x[1]]
                back[x[1]] += back[i] * value[x[0]]
            elif kind == "or":
                back[x[0]] += back[i]
                back[x[1]] += back[i]
        return out


def given(proofs: pf.Proofs, lit: int) -> pf.Proofs:
    """What is left of ``proofs`` where ``lit`` holds."""
    return pf.minimal(p - {lit} for p in proofs if -lit not in p)


def compile_exact(proofs, max_nodes: int = MAX_NODES) -> Circuit:
    """Shannon expansion on the literal's variable that most proofs have (ties: the smallest)."""
    circuit, known = Circuit(), {}

    def build(own: pf.Proofs) -> int:
        if own in known:
            return known[own]
        if len(circuit.nodes) > max_nodes:
            raise CircuitBudget(f"the circuit needs more than {max_nodes} nodes; declare the predicate Prov_k")
        if not own:
            out = circuit.add("false")
        elif frozenset() in own:
            out = circuit.add("true")
        else:
            counts = Counter(abs(x) for p in own for x in p)
            v = min(counts, key=lambda x: (-counts[x], x))
            parts = []
            for lit in (v, -v):
                rest = build(given(own, lit))
                if circuit.nodes[rest][0] != "false":
                    leaf = circuit.add("lit", lit)
                    parts.append(leaf if circuit.nodes[rest][0] == "true" else circuit.add("and", leaf, rest))
            out = circuit.any_of(parts)
        known[own] = out
        return out

    return circuit.finish(build(pf.minimal(map(frozenset, proofs))))


def plain_circuit(proofs) -> Circuit:
    """An Or of Ands as they stand; its count is right only where proofs exclude each other."""
    c = Circuit()
    return c.finish(c.any_of([c.all_of([c.add("lit", x) for x in p]) for p in proofs]))


def top_circuit(proofs, k: int, p: list[float]) -> Circuit:
    """The exact circuit of the ``k`` likeliest proofs; its count is a lower bound."""
    return compile_exact(pf.best(pf.minimal(map(frozenset, proofs)), k, p))


def top_sum(proofs, k: int, p: list[float]) -> float:
    """The sum of the ``k`` likeliest proofs' weights; right only where they exclude each other."""
    return sum(sorted((pf.weight(x, p) for x in proofs), reverse=True)[:k])


def checked(proofs, p: list[float]) -> None:
    for x in p:
        if not 0 <= x <= 1:
            raise BadProbability(f"probability {x} isn't in [0, 1]")
    for proof in proofs:
        for lit in proof:
            if lit == 0 or abs(lit) > len(p):
                raise ValueError(f"literal {lit} names none of {len(p)} leaves")


def count(proofs, p: list[float]) -> float:
    """The probability that some proof holds."""
    checked(proofs, p)
    return compile_exact(proofs).count(p)


def count_and_gradient(proofs, p: list[float]) -> tuple[float, list[float]]:
    checked(proofs, p)
    c = compile_exact(proofs)
    return c.count(p), c.gradient(p)


def sum_circuit(total: int, digits: int) -> Circuit:
    """Two digits add up to ``total``: leaves are the first digit's values, then the second's."""
    c = Circuit()
    ways = [c.all_of([c.leaf(a), c.leaf(digits + total - a)]) for a in range(digits) if 0 <= total - a < digits]
    return c.finish(c.any_of(ways))
