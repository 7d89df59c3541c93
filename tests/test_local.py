import random

import pytest

from semilog import api, errors
from semilog.lang.checker import check
from semilog.lang.reader import read
from semilog.plans import local


def rows(source, pred):
    return api.compile(source).eval()[pred]


TC = "domain n. pred edge(n, n): Bool. pred path(n, n): Bool. path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). edge(a, b). edge(b, c). edge(c, a)."


def test_closure_of_a_cycle():
    assert len(rows(TC, "path")) == 9


def random_program(r):
    """2-3 binary predicates, a few constants, rules of one to three atoms, Bool or Trop, at times a negated layer."""
    trop = r.random() < 0.4
    kind = "Trop" if trop else "Bool"
    preds, consts, variables = ["p", "q", "r"][: r.randint(2, 3)], "abcd"[: r.randint(2, 4)], ["X", "Y", "Z"]
    out = ["domain d."] + [f"pred {p}(d, d): {kind}." for p in preds]
    for _ in range(r.randint(2, 5)):
        body = [(r.choice(preds), r.choice(variables), r.choice(variables)) for _ in range(r.randint(1, 3))]
        bound = sorted({v for _, *vs in body for v in vs})
        head = (r.choice(preds), r.choice(bound), r.choice(bound))
        names = [v for _, *vs in [head, *body] for v in vs]
        fix = lambda v: v if names.count(v) > 1 else f"_{v}"  # noqa: B023, E731
        out.append(f"{head[0]}({fix(head[1])}, {fix(head[2])}) :- " + ", ".join(f"{p}({fix(x)}, {fix(y)})" for p, x, y in body) + ".")
    for _ in range(r.randint(2, 8)):
        weight = f"{r.randint(0, 4)} :: " if trop else ""
        out.append(f"{weight}{r.choice(preds)}({r.choice(consts)}, {r.choice(consts)}).")
    if r.random() < 0.35:
        out.append(f"pred top(d, d): Bool. pred node(d): Bool. {' '.join(f'node({c}).' for c in consts)} top(X, Y) :- node(X), node(Y), not p(X, Y).")
    return "\n".join(out)


def test_naive_is_semi_naive():
    r = random.Random(11)
    for _ in range(300):
        source = random_program(r)
        tree, found = read(source)
        assert not found, (source, found)
        one, two = (local.plain(check(tree), s) for s in (True, False))
        assert {p: x.rows for p, x in one.db.items()} == {p: x.rows for p, x in two.db.items()}, source


W = "domain n. pred e(n, n): Trop. pred s(n, n): Trop. s(X, Y) :- e(X, Y). s(X, Z) :- s(X, Y), e(Y, Z). "


def test_cheapest_paths():
    assert rows(W + "3 :: e(a, b). 4 :: e(b, c). 9 :: e(a, c).", "s") == [("a", "b", 3), ("a", "c", 7), ("b", "c", 4)]


def test_negative_cycle():
    with pytest.raises(errors.NegativeWeightCycle):
        api.compile(W + "-1 :: e(a, b). 0 :: e(b, a).").eval()
    assert rows(W + "1 :: e(a, b). -1 :: e(b, a).", "s")[0] == ("a", "a", 0)


def test_integers_count_for_the_cap():
    chain = " ".join(f"-1 :: e({i}, {i + 1})." for i in range(12))
    source = "pred e(int, int): Trop. pred s(int, int): Trop. s(X, Y) :- e(X, Y). s(X, Z) :- s(X, Y), e(Y, Z). " + chain
    assert (0, 12, -12) in rows(source, "s")


def test_overflow():
    with pytest.raises(errors.Overflow):
        api.compile(W + "9223372036854775807 :: e(a, b). 1 :: e(b, c).").eval()


def test_bool_body_weighs_nothing_in_trop():
    assert rows("domain n. pred b(n): Bool. pred e(n): Trop. pred s(n): Trop. s(X) :- e(X), b(X). b(a). 4 :: e(a).", "s") == [("a", 4)]


A = "domain d. pred e(d, int): Bool. pred f(d): Bool. e(a, 1). e(a, 2). e(b, 2). f(u). f(v). "


def test_aggregates_fold_over_bindings():
    assert rows(A + "pred q(d, int): Bool. q(X, count<Y>) :- e(X, Y), f(_Z).", "q") == [("a", 4), ("b", 2)]
    assert rows(A + "pred q(d, int): Bool. q(X, sum<Y>) :- e(X, Y), f(_Z).", "q") == [("a", 6), ("b", 4)]
    assert rows(A + "pred q(int, int): Bool. q(min<Y>, 7) :- e(_X, Y).", "q") == [(1, 7)]
    assert rows(A + "pred q(int): Bool. q(max<Y>) :- e(_X, Y).", "q") == [(2,)]
    assert rows(A + "pred q(int): Bool. q(count<Y>) :- e(c, Y).", "q") == []


def test_aggregates_that_are_refused():
    with pytest.raises(errors.Unsupported):
        rows(A + "pred q(int): Bool. q(prob_or<Y>) :- e(_X, Y).", "q")
    with pytest.raises(errors.NonIntegerAggregand):
        rows(A + "pred q(int): Bool. q(sum<X>) :- e(X, _Y).", "q")
    with pytest.raises(errors.Unsupported):
        rows("domain n. pred e(n, int): Trop. pred q(int): Trop. 1 :: e(a, 1). q(sum<Y>) :- e(_X, Y).", "q")


def test_underscore_is_one_variable():
    assert rows("domain d. pred e(d, d): Bool. pred q(d): Bool. e(a, b). e(c, c). q(X) :- e(X, _), e(_, _).", "q") == [("c",)]


def test_constants_repeats_and_no_arguments():
    base = "domain d. pred e(d, d): Bool. e(a, a). e(a, b). pred q(d): Bool. pred z(): Bool. "
    assert rows(base + "q(X) :- e(X, X).", "q") == [("a",)]
    assert rows(base + "q(X) :- e(a, X).", "q") == [("a",), ("b",)]
    assert rows(base + "z() :- e(b, _X). q(X) :- e(X, _Y), not z().", "q") == [("a",)]
    assert rows(base + "z() :- e(a, _X). q(X) :- e(X, _Y), not z().", "q") == []


def test_negation_may_stand_first():
    assert rows("domain d. pred e(d): Bool. pred f(d): Bool. pred q(d): Bool. e(a). e(b). f(a). q(X) :- not f(X), e(X).", "q") == [("b",)]


def test_negation_of_weights_looks_at_presence():
    assert rows("domain d. pred e(d): Bool. pred w(d): Trop. pred q(d): Bool. e(a). e(b). 3 :: w(a). q(X) :- e(X), not w(X).", "q") == [("b",)]


def test_symbols_and_integers_differ():
    assert rows("domain d. pred e(d): Bool. pred q(d): Bool. e(5). e(a). q(X) :- e(X).", "q") == [("a",), (5,)]


def test_terms_and_depth():
    source = "@terms. domain d. pred nat(d): Bool. nat(zero). nat(succ(N)) :- nat(N)."
    engine = local.plain(api.compile(source).checked)
    assert len(engine.db["nat"].rows) == 65 and engine.dropped == 1
    source = "@terms. domain d. pred tree(d): Bool. pred root(d): Bool. tree(node(leaf, one, leaf)). tree(leaf). root(V) :- tree(node(_L, V, _R))."
    assert rows(source, "root") == [("one",)]


def test_soft_facts_do_not_count_in_plain_runs():
    assert rows("domain d. pred e(d): Bool. 0.5 :: e(a). e(b).", "e") == [("b",)]
