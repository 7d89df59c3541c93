import itertools
import random

import pytest

from semilog import api, errors
from semilog.asp import choice, frames, solve
from semilog.asp.ground import Constraint, Ground, GroundRule, ground
from semilog.lang import tree as t
from semilog.lang.diagnostics import ProgramError
from semilog.lang.reader import read

LOOP = "@asp. pred node(n): Bool. pred in(n): Bool. pred out(n): Bool. node(x). node(y). in(N) :- node(N), not out(N). out(N) :- node(N), not in(N)."


def test_four_models():
    models = api.asp_models(LOOP)
    assert len(models) == 4 and [("in", ("x",)), ("in", ("y",)), ("node", ("x",)), ("node", ("y",))] in models


def test_odd_loop_has_no_model():
    assert api.asp_models("@asp. pred p(): Bool. p() :- not p().") == []


def test_declarations_hold():
    with pytest.raises(ProgramError):
        api.asp_models("@asp. pred p(): Bool. q() :- not p().")


def random_ground(r):
    g = Ground()
    atoms = [("a", (i,)) for i in range(r.randint(2, 5))]
    for a in atoms:
        g.atom(a)
    for _ in range(r.randint(2, 8)):
        some = lambda: r.sample(atoms, r.randint(0, 2))
        g.add(r.choice([*atoms, *atoms, None]), some(), some())
    return g


def brute(g):
    n = len(g.atoms)
    return [set(m) for k in range(n + 1) for m in itertools.combinations(range(n), k) if not solve.violated(g.rules, set(m)) and solve.least_model(solve.reduct(g.rules, set(m))) == set(m)]


def test_models_are_brute_force_ones():
    r = random.Random(2)
    for _ in range(300):
        g = random_ground(r)
        want = sorted(map(sorted, brute(g)))
        assert sorted(map(sorted, solve.stable_models_of(g))) == want
        assert sorted(map(sorted, brute(solve.simplify(g)))) == want
        for k in range(1 << len(g.atoms)):
            m = {i for i in range(len(g.atoms)) if k >> i & 1}
            assert solve.is_answer_set(g.rules, m) == (sorted(m) in want)


def test_filter_is_the_rule_part_of_simplification():
    assert solve.filter_rules([0, 1, 2], [[1, -2], [3], [-4]], {1, 2}, {4, 1}) == [[-2], None, None]


def test_choice_bounds():
    r = random.Random(6)
    for _ in range(30):
        n = r.randint(1, 4)
        lower, upper = r.choice([None, 0, 1, 2, 5]), r.choice([None, 0, 1, 2, 5])
        atoms = tuple(t.Atom("in", (t.Int(i),)) for i in range(n))
        rules, constraints = choice.normalize(choice.Choice(atoms, (), lower, upper), choice.Fresh())
        models = solve.solve(rules, [], constraints)
        sizes = sorted(sum(a[0] == "in" for a in m) for m in models)
        want = sorted(len(c) for k in range(n + 1) for c in itertools.combinations(range(n), k) if (lower or 0) <= k <= (n if upper is None else upper))
        assert sizes == want
    with pytest.raises(errors.AspError):
        choice.normalize(choice.Choice((t.Atom("in", (t.Var("X"),)),), (), 1, None), choice.Fresh())


def test_limits():
    nodes = " ".join(f"node({i})." for i in range(13))
    with pytest.raises(errors.TooManyChoices):
        api.asp_models(LOOP + nodes)
    source = "@asp. pred p(n): Bool. pred q(n, n, n, n): Bool. " + " ".join(f"p(c{i})." for i in range(40)) + " q(A, B, C, D) :- p(A), p(B), p(C), p(D)."
    with pytest.raises(errors.TooLargeGrounding):
        api.asp_models(source)


def test_aspif_and_names():
    tree, _ = read(LOOP)
    g = ground(tree.nodes(t.Rule), [f.atom for f in tree.nodes(t.Fact)])
    text = solve.to_aspif(g)
    assert text.startswith("asp 1 0 0\n") and text.endswith("\n0\n") and "node(x)" in text
    assert solve.parse_show_name(solve.show_name(("p", ("a", 5)))) == ("p", ("a", 5)) and solve.parse_show_name("p") == ("p", ())
    assert solve.solve_with("/nonexistent/solver", g) is None


def test_constraints_and_hints():
    both = Constraint((t.Literal(t.Atom("in", (t.Const("x"),))), t.Literal(t.Atom("in", (t.Const("y"),)))))
    assert len(api.asp_models(LOOP, [both])) == 3
    tree, _ = read(LOOP)
    g = ground(tree.nodes(t.Rule), [f.atom for f in tree.nodes(t.Fact)])
    hints = choice.Hints()
    example = (len(g.atoms), g.rules, solve.stable_models_of(g)[0])
    first = hints.train([example], steps=1)
    assert hints.train([example], steps=20) <= first + 1e-6
    assert sorted(hints.levels(len(g.atoms), g.rules)) == list(range(len(g.atoms)))


def test_frames_agree_with_lists(spark):
    r = random.Random(3)
    for _ in range(2):
        rules = [GroundRule(r.choice([*range(12), None]), tuple(r.sample(range(12), r.randrange(3))), tuple(r.sample(range(12), r.randrange(2)))) for _ in range(25)]
        rows = [(i, x.head, list(x.pos), list(x.neg)) for i, x in enumerate(rules)]
        df = spark.createDataFrame(rows, "rule long, head long, pos array<bigint>, neg array<bigint>")
        atoms = lambda found: {x.atom for x in found.collect()}
        g = Ground(rules, [("a", (i,)) for i in range(12)], {})
        can, sure = solve.possible_atoms(g), solve.certain(g)
        possible = frames.possible_atoms(df)
        assert atoms(possible) == can and atoms(frames.certain(df, possible)) == sure
        model = set(r.sample(range(12), 8))
        held = spark.createDataFrame([(a,) for a in model], "atom long")
        assert atoms(frames.greatest_unfounded_set(df, held)) == solve.greatest_unfounded_set(rules, model)
        told = {x.rule: (x.dead, list(x.pos), list(x.neg)) for x in frames.filter_rules(df, possible, frames.certain(df, possible)).collect()}
        for i, x in enumerate(rules):
            dead = any(a not in can for a in x.pos) or any(a in sure for a in x.neg)
            assert told[i] == (dead, [] if dead else sorted(a for a in x.pos if a not in sure), [] if dead else sorted(a for a in x.neg if a in can))


def test_rules_of_one_atom_lead_to_their_heads_without_counts(spark, monkeypatch):
    """A chain, a rule of two atoms at its end, and a circle that nothing reaches; counts are kept for rules of several."""
    names, real = [], frames.written
    monkeypatch.setattr(frames, "written", lambda df, name: (names.append(name), real(df, name))[1])
    rows = [(0, 0, [], [])] + [(i, i, [i - 1], []) for i in range(1, 6)] + [(90, 90, [91, 91], []), (91, 91, [90], [])]
    schema = "rule long, head long, pos array<long>, neg array<long>"
    assert {r.atom for r in frames.least_model(spark.createDataFrame(rows, schema)).collect()} == set(range(6))
    assert "met" not in names
    more = [*rows, (7, 7, [5, 2], []), (8, 8, [7, 90], [])]
    assert {r.atom for r in frames.least_model(spark.createDataFrame(more, schema)).collect()} == {*range(6), 7}
