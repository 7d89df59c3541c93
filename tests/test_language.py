import json

import pytest

from semilog.lang import codec
from semilog.lang import tree as t
from semilog.lang.checker import check
from semilog.lang.diagnostics import ProgramError, as_json, as_text
from semilog.lang.printer import print_program
from semilog.lang.reader import read

EVERYTHING = """% a program with every statement
@terms.
domain d.
domain firm.
pred edge(d, int): Trop total sound_only.
pred path(d, term firm): Prov_k(7).
pred p(): Bool.
neural flag(firm, d) from model "m".

% rules
path(X, f(Y, g(1))) :- path(X, Y), not p(), not q(X, _).
pred q(d, int): Bool.
pred c(d, int): Bool.
c(X, count<Y>) :- q(X, Y).
5 :: edge(a, -3).
0.25 :: flag(acme, x).
q(b, 2).
p().
input q from "x.tsv".
?q(a, _).
?prob flag(X, Y).
?grad flag(acme, x).
"""


def codes(source):
    program, found = read(source)
    if found:
        return [d.code for d in found]
    try:
        check(program, source)
    except ProgramError as e:
        return [d.code for d in e.diagnostics]
    return []


def test_print_then_read_gives_the_same():
    program, found = read(EVERYTHING)
    assert not found
    text = print_program(program)
    again, _ = read(text)
    assert again.items == program.items
    assert print_program(again) == text
    assert "% rules" in text and "\n\n% rules" in text


def test_json_and_back():
    program, _ = read(EVERYTHING)
    text = codec.to_json(program)
    assert codec.from_json(text).items == program.items
    kinds = set(codec.schema()["$defs"]["item"]["oneOf"][i]["properties"]["kind"]["const"] for i in range(7))
    assert {i["kind"] for i in json.loads(text)["items"]} <= kinds


@pytest.mark.parametrize("text", ["nope", "{}", '{"ir_version": "1.0.0", "items": []}', '{"ir_version": "0.2.0", "items": []}', '{"ir_version": "0.1.0", "items": [{"kind": "x", "data": {}}]}', '{"ir_version": "0.1.0"}'])
def test_json_that_is_refused(text):
    with pytest.raises(codec.LoadError):
        codec.from_json(text)


D = "domain d. pred e(d, d): Bool. pred p(d, d): Bool. pred w(d, d): Trop. pred v(d): Prov. pred k(d): Prov_k(2). "


@pytest.mark.parametrize(
    "source, expected",
    [
        ("domain d. $", ["E0001"]),
        ("domain d", ["E0003"]),
        ("domain X.", ["E0002"]),
        (D + "p(X, Y) :- e(X, Z), e(Z, Y), e(X, W).", ["E0010"]),
        (D + "p(X, X) :- e(X, _Y), nope(X).", ["E1001"]),
        (D + "p(X, Y) :- e(X, Y), not p(X, Y).", ["E1002"]),
        (D + "p(X, Y) :- e(X, X), not e(X, Y), not e(Y, Y).", ["E1003"]),
        (D + "e(a, X).", ["E1004"]),
        (D + "e(a).", ["E1005"]),
        ("domain d. pred k(d): Prov_k(0).", ["E1006"]),
        (D + "p(X, Y) :- w(X, Y).", ["E1007"]),
        (D + "v(X) :- v(X).", ["E1008"]),
        (D + "w(a, b).", ["E1009"]),
        (D + "3 :: e(a, b).", ["E1009"]),
        (D + "1.5 :: e(a, b).", ["E1009"]),
        (D + "0.5 :: w(a, b).", ["E1009"]),
        ('domain d. neural n(d) from model "m". n(a).', ["E1010"]),
        ("@asp. domain d. pred e(d): Bool. ?e(X).", ["E1011"]),
        ("@asp. domain d. pred e(d): Bool. 0.5 :: e(a).", ["E1011"]),
        ("@asp. domain d. pred e(d): Bool. e(f(a)).", ["E1011"]),
        (D + "pred e(d): Bool.", ["E1012"]),
        (D + "pred e(d, d): Bool.", []),
        (D + "k(X) :- k(X), v(X).", []),
        (D + "p(X, _Y) :- e(X, _Y).", []),
    ],
)
def test_codes(source, expected):
    assert codes(source) == expected


def test_reading_goes_on_after_an_error():
    _, found = read("domain X. domain a. pred 5. domain b.")
    assert [d.code for d in found] == ["E0002", "E0002"]


def test_singleton_has_a_fix():
    source = D + "p(X, X) :- e(X, Long)."
    _, found = read(source)
    fix = found[0].fix
    assert source[slice(*fix.span)] == "Long" and fix.replacement == "_Long"
    assert "1:" in as_text(found, source) and json.loads(as_json(found))[0]["fix"]["replacement"] == "_Long"


def test_layers_are_lowest_first():
    program, _ = read(D + "pred a(d): Bool. pred b(d): Bool. a(X) :- e(X, X). b(X) :- e(X, _Y), not a(X).")
    layers = check(program).layers
    at = {p: i for i, s in enumerate(layers) for p in s}
    assert at["e"] < at["a"] < at["b"]


def test_reading_never_crashes():
    import random

    r = random.Random(5)
    pieces = ["pred", "domain", "d", "(", ")", ":-", ".", ",", "X", "::", "5", "0.5", "not", "?prob", '"s"', "%c\n", "@asp", "<", ">", "count", ":", "Bool", "f"]
    for _ in range(3000):
        read(" ".join(r.choice(pieces) for _ in range(r.randrange(25))))


def test_term_helpers():
    assert t.show(("f", "a", ("g", 1))) == "f(a, g(1))" and t.depth(("f", ("g", 1))) == 2
