import random

import pytest
from pyspark.sql import functions as F

from semilog import api, errors
from semilog.plans import distributed, encoding, local, magic, worlds
from semilog.lang import tree as t
from semilog.lang.checker import check
from semilog.lang.reader import read
from tests.test_local import TC, W, random_program
from tests.test_proofs import GRAPH


def rows_of(run, pred):
    """A distributed relation as the local engine has it."""
    kinds, n = run.kinds[pred], run.arity[pred]
    out = {}
    for r in run.relations[pred].collect():
        row = tuple(encoding.load(v, k) for v, k in zip(r[:n], kinds))
        out[row] = (local.INF if r["w"] is None else r["w"]) if run.extra(pred) == ["w"] else True
    return out


def agree(spark, source):
    checked = api.compile(source).checked
    want = local.plain(checked).db
    run = api.compile(source).run(spark)
    for pred in want:
        got = rows_of(run, pred)
        expected = want[pred].rows if run.extra(pred) == ["w"] else dict.fromkeys(want[pred].rows, True)
        assert got == expected, (pred, source)
    return run


def test_random_programs(spark):
    r = random.Random(21)
    for _ in range(6):
        agree(spark, random_program(r))


def test_closure_shapes(spark):
    facts = " ".join(f"edge({a}, {b})." for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("y", "y")))
    head = "domain n. pred edge(n, n): Bool. pred p(n, n): Bool. p(X, Y) :- edge(X, Y). "
    for step in ("p(X, Z) :- edge(X, Y), p(Y, Z).", "p(X, Z) :- p(X, Y), p(Y, Z)."):
        run = agree(spark, head + step + facts)
        assert run.closure_of(["p"], run.checked.rules) == "edge"
    for step in ("p(X, Z) :- edge(X, Y), p(Y, Z), edge(X, Z).", "p(Z, X) :- edge(X, Y), p(Y, Z).", "p(X, Z) :- edge(Y, X), p(Y, Z).", "p(X, Z) :- p(X, Y), edge(Y, Z). p(a, a)."):
        run = api.compile(head + step + facts).run(spark)
        assert run.closure_of(["p"], run.checked.rules) is None
    agree(spark, head + "p(X, Z) :- edge(Y, X), p(Y, Z). p(a, a)." + facts)


def test_mixed_values_and_terms(spark):
    agree(spark, 'domain d. pred e(d, d): Bool. pred f(int): Bool. pred q(d, d): Bool. e(5, a). e(a, 7). f(5). f(7). q(X, Y) :- e(X, Y), f(X). q(Y, X) :- e(X, Y), f(Y), not f(X).')
    run = agree(spark, "@terms. domain d. pred e(d, int): Bool. pred t(d): Bool. pred q(d, d): Bool. e(a, 1). e(b, 2). t(node(leaf(X), Y, f(Y, x))) :- e(X, Y). q(X, Z) :- t(node(leaf(X), _Y, f(Z, x))). q(X, X) :- t(node(X, X, _Y)).")
    assert not run.incomplete()


def test_depth_bound(spark):
    p = api.compile("@terms. domain d. pred nat(d): Bool. nat(zero). nat(succ(N)) :- nat(N).")
    p.checked.max_depth = 4
    run = p.run(spark)
    assert run.relations["nat"].count() == 5 and run.incomplete()


def test_negation_and_no_arguments(spark):
    base = "domain d. pred e(d, d): Bool. e(a, a). e(a, b). pred q(d): Bool. pred z(): Bool. "
    agree(spark, base + "z() :- e(b, _X). q(X) :- e(X, _Y), not z().")
    agree(spark, base + "z() :- e(a, _X). q(X) :- e(X, _Y), not z().")
    agree(spark, base + "q(X) :- not e(X, X), e(_Y, X). z() :- e(a, a), e(a, b).")
    agree(spark, base + "z(). q(X) :- z(), e(X, X), not e(b, b).")


def test_aggregates(spark):
    head = "domain d. pred e(d, int): Bool. pred f(d): Bool. e(a, 1). e(a, 2). e(b, 2). f(u). f(v). "
    agree(spark, head + "pred q(d, int): Bool. q(X, count<Y>) :- e(X, Y), f(_Z). pred m(int, int): Bool. m(min<Y>, 7) :- e(_X, Y). pred s(d, int): Bool. s(X, sum<Y>) :- e(X, Y). s(X, max<Y>) :- e(X, Y). pred n(int): Bool. n(count<Y>) :- e(c, Y).")
    with pytest.raises(Exception, match="no integer"):  # frames are lazy; Spark raises where they are read
        api.compile(head + "pred q(int): Bool. q(sum<X>) :- e(X, _Y).").run(spark).relations["q"].collect()
    with pytest.raises(errors.Unsupported):
        api.compile(head + "pred q(int): Bool. q(prob_or<Y>) :- e(_X, Y).").run(spark)


def test_weights(spark):
    agree(spark, W + "3 :: e(a, b). 4 :: e(b, c). 9 :: e(a, c). 1 :: e(c, a).")
    agree(spark, W + "1 :: e(a, b). -1 :: e(b, a).")
    with pytest.raises(errors.NegativeWeightCycle):
        api.compile(W + "-1 :: e(a, b). 0 :: e(b, a).").run(spark)
    with pytest.raises(errors.Overflow):
        api.compile(W + "9223372036854775807 :: e(a, b). 1 :: e(b, c).").run(spark)


def test_infinite_weights(spark):
    edges = spark.createDataFrame([("a", "b", None), ("b", "c", 1), ("a", "c", 5)], "x string, y string, w long")
    found = {(r.c0, r.c1): r.w for r in api.compile(W).bind("e", edges).frames(spark)["s"].collect()}
    assert found == {("a", "b"): None, ("b", "c"): 1, ("a", "c"): 5}


def test_worlds_and_proofs(spark):
    source = GRAPH.format("Bool") + "0.5 :: edge(a, c). 0.5 :: edge(a, b). 0.5 :: edge(b, c). edge(c, d). 0.25 :: edge(c, a). pred cut(n, n): Bool. pred node(n): Bool. node(a). node(c). cut(X, Y) :- node(X), node(Y), not path(X, Y)."
    want = worlds.marginals(api.compile(source).checked)
    for mode in ("worlds", "proofs"):
        run = api.compile(source).run(spark, mode)
        for pred in ("path", "cut"):
            got = {(r.c0, r.c1): r.p for r in distributed.marginals(run, pred).collect()}
            assert got == {row: pytest.approx(p) for row, (p, _) in want[pred].items() if p > 0}, (mode, pred)
        if mode == "proofs":
            for r in distributed.gradients(run, "cut").collect():
                assert list(r.grad) == pytest.approx(want["cut"][(r.c0, r.c1)][1])


def test_bounded_proofs(spark):
    source = GRAPH.format("Prov_k(1)") + "0.5 :: edge(a, c). 0.9 :: edge(a, b). 0.9 :: edge(b, c). 0.5 :: edge(c, a)."
    want = {row: [list(p) for p in own] for row, own in api.compile(source).provenance()["path"]}
    got = {(r.c0, r.c1): [list(p) for p in r.proofs] for r in distributed.proof_lists(api.compile(source).run(spark, "proofs"), "path").collect()}
    assert got == want


def test_limits(spark):
    with pytest.raises(errors.NotBool):
        api.compile(W).run(spark, "worlds")
    many = "pred e(int): Bool. " + " ".join(f"0.5 :: e({i})." for i in range(21))
    with pytest.raises(errors.TooManySoftFacts):
        api.compile(many).run(spark, "worlds")
    with pytest.raises(errors.SoftAggregate):
        api.compile("pred e(int): Bool. 0.5 :: e(1). pred q(int): Bool. q(count<X>) :- e(X).").run(spark, "proofs")
    with pytest.raises(errors.EvalError):
        api.compile("pred e(int): Bool.").bind("e", spark.range(1).select(F.lit(1.5))).frames(spark)
    with pytest.raises(errors.EvalError):
        api.compile("pred e(int): Bool.").bind("e", spark.range(1).select("id", "id"))


def test_small_programs_run_in_process(spark):
    frames = api.compile(TC).frames(spark)
    assert frames["path"].count() == 9 and frames["path"].columns == ["c0", "c1"]
    frames = api.compile(W + "1 :: e(a, b).").frames(spark)
    assert frames["s"].collect()[0].w == 1


def test_demand(spark):
    r = random.Random(3)
    edges = [(r.randrange(12), r.randrange(12)) for _ in range(20)]
    source = "pred e(int, int): Bool. pred p(int, int): Bool. p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z). " + " ".join(f"e({a}, {b})." for a, b in edges)
    tree, _ = read(source)
    want = {row for row in local.plain(check(tree)).db["p"].rows if row[0] == 3}
    rewritten, name = magic.rewritten(tree, t.Atom("p", (t.Int(3), t.Var("Y"))))
    engine = local.plain(check(rewritten))
    assert {row for row in engine.db[name].rows if row[0] == 3} == want
    rewritten, name = magic.rewritten(tree, t.Atom("p", (t.Var("X"), t.Var("Y"))))
    assert set(local.plain(check(rewritten)).db[name].rows) == set(local.plain(check(tree)).db["p"].rows)
    with pytest.raises(ValueError):
        magic.transform(read("pred e(int): Bool. pred q(int): Bool. q(X) :- e(X), not q2(X).")[0].nodes(t.Rule), t.Atom("q", (t.Int(1),)))


def test_plans_keep_joins_native(spark):
    """Joins of bound tables are equi-joins, and no Python runs in them."""
    edges = spark.range(100).select("id", (F.col("id") * 2).alias("b"))
    df = api.compile("pred e(int, int): Bool. pred q(int, int): Bool. q(X, Z) :- e(X, Y), e(Y, Z).").bind("e", edges).frames(spark)["q"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Cartesian" not in plan and "Python" not in plan


SOFT_PATHS = "domain d. pred edge(d, d): Bool. pred sure(d, d): Bool. pred path(d, d): {kind}. path(X, Y) :- edge(X, Y). path(X, Y) :- sure(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z). 0.5 :: edge(a, b). 0.25 :: edge(b, c). 0.5 :: edge(a, c)."


@pytest.mark.parametrize("kind", ["Bool", "Prov_k(9)", "Prov_k(1)"])
def test_questions_to_bound_programs(spark, kind):
    """Asked over bound DataFrames, a program answers as it does with the same facts inline."""
    inline = api.compile(SOFT_PATHS.format(kind=kind) + " sure(c, d).")
    bound = api.compile(SOFT_PATHS.format(kind=kind)).bind("sure", spark.createDataFrame([("c", "d")], "x string, y string"))
    for pattern in (None, ("a", None), ("z", None)):
        a, b = inline.grad_query("path", pattern), bound.grad_query("path", pattern)
        assert [x for x, *_ in a if _[0] > 0] == [x for x, *_ in b] and all(p == pytest.approx(q) and g == pytest.approx(h) for (_, p, g), (_, q, h) in zip([x for x in a if x[1] > 0], b))
        assert [x for x, _ in inline.prob_query("path", pattern)] == [x for x, _ in bound.prob_query("path", pattern)]
    if kind != "Bool":
        assert {p: sorted((row, sorted(x)) for row, x in rows) for p, rows in inline.provenance().items()} == {p: sorted((row, sorted(x)) for row, x in rows) for p, rows in bound.provenance().items()}


def test_soft_facts_of_a_table(spark):
    source = "domain d. pred edge(d, d): Bool. pred path(d, d): {kind}. path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z)."
    rows = [("a", "b", 0.5), ("b", "c", 0.25), ("a", "c", 0.5), ("a", "c", 0.5), ("c", "a", 0.125)]
    inline = api.compile(source.format(kind="Prov_k(9)") + " ".join(f"{p} :: edge({x}, {y})." for x, y, p in rows))
    table = spark.createDataFrame(rows, "x string, y string, p double")
    got = api.compile(source.format(kind="Prov_k(9)")).bind("edge", table).prob_query("path")
    want = inline.prob_query("path")
    assert [x for x, _ in got] == [x for x, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want])
    best = api.compile(source.format(kind="Prov_k(1)")).bind("edge", table).prob_query("path", ("a", "c"))
    assert best == [(("a", "c"), pytest.approx(0.5))]


def test_repeated_rows_of_bound_tables(spark):
    """Facts read with their repeats give what sets give: joins, semi-joins, negation, aggregates, recursion."""
    source = """pred e(int, int): Bool. pred f(int, int): Bool. pred j(int, int): Bool. pred s(int): Bool. pred n(int, int): Bool.
    pred c(int, count): Bool. pred z(int, sum): Bool. pred r(int): Bool. pred w(int, int): Trop.
    j(X, Z) :- e(X, Y), f(Y, Z). s(X) :- e(X, Y), f(Y, _Z). n(X, Y) :- e(X, Y), not f(X, Y).
    c(X, count<Z>) :- e(X, Y), f(Y, Z). z(X, sum<Z>) :- e(X, Y), f(Y, Z). r(1) :- e(1, _Y). r(Y) :- r(X), e(X, Y). w(X, Z) :- e(X, Y), f(Y, Z).""".replace("int, count", "int, int").replace("int, sum", "int, int")
    r = random.Random(5)
    pairs = [[(r.randrange(6), r.randrange(6)) for _ in range(60)] for _ in range(2)]
    p = api.compile(source)
    for name, rows in zip("ef", pairs):
        p.bind(name, spark.createDataFrame(rows, "a long, b long"))
    own = api.compile(source + "".join(f" {name}({a}, {b})." for name, rows in zip("ef", pairs) for a, b in rows))
    want, run = local.plain(own.checked).db, p.run(spark)
    assert set(run.bags) == {"e", "f"}
    for pred in want:
        got = [tuple(x)[: run.arity[pred]] for x in run.relations[pred].collect()]
        assert sorted(got) == sorted(want[pred].rows), pred


def test_long_bodies_in_any_order(spark, monkeypatch):
    facts = " ".join(f"e({i}, {(i * 7 + 3) % 12})." for i in range(12)) + " s(3). s(6). s(0). b(2)."
    source = "pred e(int, int): Bool. pred s(int): Bool. pred b(int): Bool. pred q(int, int): Bool. pred r(int, int): Bool. " + facts
    source += " q(X, U) :- e(X, Y), e(Y, Z), s(Y), e(Z, U), not b(U). r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z), s(Y), r(Y, Z)."
    seen = []
    order = distributed.planner.join_order
    monkeypatch.setattr(distributed.planner, "join_order", lambda atoms, sizes, first=None: seen.append((first, order(atoms, sizes, first))) or seen[-1][1])
    agree(spark, source)
    assert {f for f, _ in seen} == {None, 0, 3}  # the delta comes first, at each of its places
    assert all(f is None or o[0] == f for f, o in seen)


@pytest.mark.parametrize("second", [False, True])
def test_pairs_that_meet_in_few_keys_are_made_in_many_tasks_without_a_pass_for_repeats(spark, second):
    """With one nation each, no pair comes twice; a customer of two nations brings repeats, which go."""
    cust = [(i, i % 2) for i in range(40)] + ([(0, 1)] if second else []) + [(3, 1)]
    supp = [(i, i % 3) for i in range(30)] + ([(0, 1)] if second else [])
    p = api.compile("pred c(int, int): Bool. pred s(int, int): Bool. pred q(int, int): Bool. q(C, S) :- c(C, N), s(S, N).")
    p.bind("c", spark.createDataFrame(cust, "a long, b long")).bind("s", spark.createDataFrame(supp, "a long, b long"))
    found = p.frames(spark)["q"]
    assert sorted(map(tuple, found.collect())) == sorted({(a, b) for a, m in cust for b, n in supp if m == n})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and plan.startswith("Aggregate") == second


SAME = "pred e(int, int): Bool. pred q(int, int): Bool. q(X, Y) :- e(P, X), e(P, Y). q(X, Y) :- e(A, X), q(A, B), e(B, Y)."


@pytest.mark.parametrize("seed", range(4))
def test_same_generation_by_classes(spark, seed):
    """A tree, a cycle, and graphs with several parents; joins see classes, not all pairs."""
    rng = random.Random(seed)
    edges = [[(i // 2, i) for i in range(2, 32)], [(0, 1), (1, 2), (2, 0), (2, 3), (1, 3), (5, 5), (5, 6)]]
    edges = (edges + [[(rng.randrange(14), rng.randrange(14)) for _ in range(n)] for n in (18, 30)])[seed]
    want = {(x, y) for p, x in edges for r, y in edges if p == r}
    while more := {(x, y) for a, x in edges for b, y in edges if (a, b) in want} - want:
        want |= more
    p = api.compile(SAME).bind("e", spark.createDataFrame(edges, "a long, b long"))
    run = p.run(spark)
    assert run.generation_of(["q"], [r for r in run.checked.rules]) == "e"
    found = list(map(tuple, run.relations["q"].collect()))
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_paths_double_their_reach(spark, seed, monkeypatch):
    """Longer ways may be cheaper, weights may fall below 0 or be infinite; rounds are doublings, not steps."""
    rng = random.Random(seed)
    edges = [(i, i + 1, -1) for i in range(20)] + [(rng.randrange(12), rng.randrange(12, 21), rng.choice([0, 3, 9, None])) for _ in range(12)]
    inf, best = float("inf"), {}
    for a, b, w in edges:
        best[a, b] = min(best.get((a, b), inf), inf if w is None else w)
    one = dict(best)
    for _ in range(22):
        for (a, b), w in list(best.items()):
            for (c, d), x in one.items():
                if b == c and (d is not None) and w + x < best.get((a, d), inf) or b == c and (a, d) not in best:
                    best[a, d] = w + x
    tables = []
    real = distributed.written
    monkeypatch.setattr(distributed, "written", lambda df, name: (tables.append(name), real(df, name))[1])
    p = api.compile("pred e(int, int): Trop. pred q(int, int): Trop. q(X, Y) :- e(X, Y). q(X, Z) :- q(X, Y), e(Y, Z).")
    p.bind("e", spark.createDataFrame(edges, "a long, b long, w long"))
    got = {(r.c0, r.c1): inf if r.w is None else r.w for r in p.frames(spark)["q"].collect()}
    assert got == best
    assert tables.count("q") <= 15
