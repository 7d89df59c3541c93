import itertools
import random

import pytest

from semilog import api, errors
from semilog.functions import circuits
from semilog.functions import proofs as pf
from semilog.lang.checker import check
from semilog.lang.reader import read
from semilog.operators import neural
from semilog.plans import distributed, local, worlds
from semilog.streaming.proofs import MaintainedProofs


def brute(proofs, p):
    total = 0.0
    for world in itertools.product([0, 1], repeat=len(p)):
        if any(all((world[abs(x) - 1] == 1) == (x > 0) for x in proof) for proof in proofs):
            weight = 1.0
            for w, x in zip(world, p):
                weight *= x if w else 1 - x
            total += weight
    return total


def random_dnf(r):
    n = r.randint(1, 6)
    return n, [[x * r.choice((1, 1, -1)) for x in r.sample(range(1, n + 1), r.randint(1, n))] for _ in range(r.randint(0, 6))]


def test_count_is_the_probability():
    r = random.Random(3)
    for _ in range(200):
        n, proofs = random_dnf(r)
        p = [r.choice((0.0, 1.0, r.random())) for _ in range(n)]
        assert api.wmc(proofs, p) == pytest.approx(brute(proofs, p))


def test_gradient_is_the_difference():
    r = random.Random(4)
    for _ in range(60):
        n, proofs = random_dnf(r)
        p = [r.choice((0.0, 1.0, r.random())) for _ in range(n)]
        _, grad = api.wmc_grad(proofs, p)
        for i in range(n):  # the count is linear in each probability
            up, down = p[:i] + [1.0] + p[i + 1 :], p[:i] + [0.0] + p[i + 1 :]
            assert grad[i] == pytest.approx(brute(proofs, up) - brute(proofs, down))


def test_opposite_is_the_rest():
    r = random.Random(5)
    for _ in range(100):
        n, proofs = random_dnf(r)
        own = pf.minimal(map(frozenset, proofs))
        p = [r.random() for _ in range(n)]
        assert brute(pf.opposite(own), p) == pytest.approx(1 - brute(own, p))


def test_minimal():
    assert pf.minimal(map(frozenset, [[1, 2], [1], [3, -3], [2, 1, 4]])) == {frozenset([1])}


def test_budgets():
    with pytest.raises(errors.ProofBudget):
        pf.opposite(pf.minimal(frozenset([2 * i + 1, 2 * i + 2]) for i in range(8)), budget=100)
    with pytest.raises(errors.CircuitBudget):
        circuits.compile_exact([[i, i + 1] for i in range(1, 30)], max_nodes=5)


def test_top():
    proofs, p = [[1], [2, 3], [4]], [0.5, 0.9, 0.9, 0.1]
    assert circuits.top_circuit(proofs, 2, p).count(p) == pytest.approx(brute([[1], [2, 3]], p))
    assert circuits.top_sum([[1], [4]], 1, p) == 0.5
    assert circuits.plain_circuit([[1, 2], [-1, 3]]).count([0.5, 0.2, 0.4]) == pytest.approx(0.3)


def test_arguments_are_checked():
    with pytest.raises(errors.BadProbability):
        api.wmc([[1]], [1.5])
    with pytest.raises(ValueError):
        api.wmc([[2]], [0.5])


GRAPH = "domain n. pred edge(n, n): Bool. pred path(n, n): {}. path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). "


def test_pinned_values():
    p = api.compile(GRAPH.format("Bool") + "0.5 :: edge(a, c). 0.5 :: edge(a, b). 0.5 :: edge(b, c).")
    assert p.prob_query("path", ("a", "c")) == [(("a", "c"), 0.625)]
    assert p.grad_query("path", ("a", "c"))[0][2] == [0.75, 0.25, 0.25]
    prov = "domain f. pred owns(f, f): Bool. pred controls(f, f): Prov. controls(X, Y) :- owns(X, Y). controls(X, Z) :- owns(X, Y), owns(Y, Z). 0.9 :: owns(acme, shell). 0.8 :: owns(shell, target). 0.3 :: owns(acme, target)."
    assert api.compile(prov).prob_query("controls", ("acme", "target"))[0][1] == pytest.approx(0.804)
    assert dict(api.compile(prov).provenance()["controls"])[("acme", "target")] == [[1, 2], [3]]


def random_graph(r, extra=""):
    facts = " ".join(f"{r.choice((0.0, 1.0, round(r.random(), 2)))} :: edge({r.choice('abcd')}, {r.choice('abcd')})." for _ in range(r.randint(1, 5)))
    return GRAPH.format("Bool") + extra + facts + " edge(d, a)."


NEGATED = "pred node(n): Bool. node(a). node(b). node(c). pred cut(n, n): Bool. cut(X, Y) :- node(X), node(Y), not path(X, Y). "


def test_capture_is_enumeration():
    r = random.Random(8)
    for i in range(40):
        checked = api.compile(random_graph(r, NEGATED if i % 2 else "")).checked
        one, two = worlds.marginals(checked), worlds.enumerated(checked)
        for pred, rows in two.items():
            for row, (p, grad) in rows.items():
                assert one[pred][row][0] == pytest.approx(p) and one[pred][row][1] == pytest.approx(grad)


def test_soft_aggregates_are_enumerated():
    source = "domain n. pred e(n): Bool. pred q(int): Bool. 0.5 :: e(a). 0.5 :: e(b). q(count<X>) :- e(X)."
    assert api.compile(source).prob_query("q") == [((1,), 0.5), ((2,), 0.25)]
    with pytest.raises(errors.SoftAggregate):
        local.proofs(api.compile(source).checked)


def test_whole_program_limits():
    many = "domain n. pred e(int): Bool. " + " ".join(f"0.5 :: e({i})." for i in range(21))
    with pytest.raises(errors.TooManySoftFacts):
        api.compile(many).prob_query("e")
    with pytest.raises(errors.NotBool):
        api.compile("domain n. pred e(n): Bool. pred w(n): Trop. 0.5 :: e(a).").prob_query("e")


def test_two_soft_facts_on_a_tuple_are_independent():
    assert api.compile("domain n. pred e(n): Bool. 0.5 :: e(a). 0.5 :: e(a).").prob_query("e") == [(("a",), 0.75)]


def test_bounded_proofs_are_a_lower_bound():
    r = random.Random(9)
    for _ in range(20):
        source = random_graph(r)
        exact = dict(api.compile(source).prob_query("path"))
        for row, p in api.compile(source.replace("path(n, n): Bool", "path(n, n): Prov_k(1)")).prob_query("path"):
            assert p <= exact[row] + 1e-9


def test_maintained_proofs_are_recaptured_ones():
    r = random.Random(10)
    for _ in range(12):
        source = GRAPH.format("Prov_k(2)")
        kept = MaintainedProofs(api.compile(source).checked)
        alive = []
        for _ in range(10):
            if alive and r.random() < 0.4:
                leaf = alive.pop(r.randrange(len(alive)))
                kept.delete_soft(leaf[0])
            else:
                fact = (r.choice("abc"), r.choice("abc"), round(r.uniform(0.1, 0.9), 3))
                alive.append((kept.insert_soft("edge", fact[:2], fact[2]), fact))
            fresh = api.compile(source + " ".join(f"{p} :: edge({x}, {y})." for _, (x, y, p) in alive)).checked
            want = local.proofs(fresh).db["path"].rows
            number = {i + 1: leaf + 1 for i, (leaf, _) in enumerate(alive)}
            assert kept.proofs("path") == {row: frozenset(frozenset(number[x] for x in p) for p in own) for row, own in want.items()}
    with pytest.raises(errors.Unsupported):
        MaintainedProofs(api.compile(GRAPH.format("Bool") + NEGATED).checked)


def test_sums_of_digits():
    p = [0.2, 0.8, 0.5, 0.5]
    assert circuits.sum_circuit(1, 2).count(p) == pytest.approx(0.2 * 0.5 + 0.8 * 0.5)
    report = neural.train(neural.Config(digits=4, pairs=200, epochs=3))
    assert report.accuracy_after > 0.95 and report.circuits_built <= 7 and report.circuit_uses == 600


def test_models():
    source = 'domain f. neural flag(f) from model "m". pred hit(f): Bool. hit(X) :- flag(X).'
    p = api.compile(source).attach_models({"m": lambda: [("flag", ("acme",), 0.9)]})
    assert p.prob_query("hit") == [(("acme",), 0.9)] and p.prob_facts() == [("flag", ("acme",), 0.9)]
    for models in ({}, {"m": lambda: [("x", ("a",), 0.5)]}, {"m": lambda: [("flag", ("a", "b"), 0.5)]}, {"m": lambda: [("flag", ("a",), 2)]}):
        with pytest.raises(errors.ModelError):
            api.compile(source).attach_models(models)
    with pytest.raises(errors.ModelError):
        p.attach_models({"m": lambda: []})


def test_patterns_are_checked():
    p = api.compile(GRAPH.format("Bool"))
    with pytest.raises(ValueError):
        p.prob_query("nope")
    with pytest.raises(ValueError):
        p.prob_query("path", ("a",))
    assert check(read(GRAPH.format("Bool"))[0]).modes == {}


@pytest.mark.parametrize("second, lifted", [(False, True), (True, False)])
def test_marginals_of_pairs_hang_on_their_nation_alone(spark, second, lifted):
    """Each pair has one nation, whose probability it gets without worlds; a customer of two nations goes by worlds."""
    cust = [(i, i % 4) for i in range(20)] + ([(1, 2)] if second else [])
    supp = [(i, i % 4) for i in range(12)] + ([(1, 2)] if second else [])
    p = api.compile("pred c(int, int): Bool. pred s(int, int): Bool. pred r(int): Bool. pred q(int, int): Bool. 0.25 :: r(1). 0.5 :: r(2). 0.5 :: r(2). q(C, S) :- c(C, N), s(S, N), r(N).")
    p.bind("c", spark.createDataFrame(cust, "a long, b long")).bind("s", spark.createDataFrame(supp, "a long, b long"))
    chance, want = {1: 0.25, 2: 0.75}, {}
    for a, m in cust:
        for b, n in supp:
            if m == n and n in chance:
                want[a, b] = 1 - (1 - want.get((a, b), 0)) * (1 - chance[n])
    found = p.marginal_frame(spark, "q")
    assert {(r.c0, r.c1): round(r.p, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert (distributed.lifted_marginals(spark, p.checked, "q", p.bound) is not None) == lifted
