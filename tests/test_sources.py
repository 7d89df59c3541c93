import pytest

from semilog import api, errors
from semilog.cli import main
from semilog.sources import files

HEAD = "domain d. pred e(d, int): Bool. pred w(d, d): Trop. neural n(d) from model \"m\". "


def load(tmp_path, decl, **named):
    for name, text in named.items():
        (tmp_path / name.replace("_", ".")).write_text(text)
    return api.compile(HEAD + decl).load_inputs(str(tmp_path))


def test_formats_agree(tmp_path):
    want = [("a", 5), ("b c", -2)]
    assert load(tmp_path, 'input e from "e.tsv".', e_tsv="a\t5\r\n\nb c\t-2\n").eval()["e"] == want
    assert load(tmp_path, 'input e from "e.csv".', e_csv='"a",5\nb c,-2\n').eval()["e"] == want
    assert load(tmp_path, 'input e from "e.json".', e_json='[["a", 5], ["b c", -2]]').eval()["e"] == want
    (tmp_path / "plain").write_text("a\t5\nb c\t-2")
    assert load(tmp_path, 'input e from "plain".').eval()["e"] == want


def test_weights_and_probabilities(tmp_path):
    assert load(tmp_path, 'input w from "w.tsv".', w_tsv="a\tb\t3").eval()["w"] == [("a", "b", 3)]
    assert load(tmp_path, 'input n from "n.csv".', n_csv="a,0.25").prob_facts() == [("n", ("a",), 0.25)]


def test_csv_quotes(tmp_path):
    assert load(tmp_path, 'input e from "e.csv".', e_csv='"a ""b"", c",1').eval()["e"] == [('a "b", c', 1)]


@pytest.mark.parametrize(
    "name, text",
    [("e.tsv", "a"), ("e.tsv", "a\tx"), ("e.tsv", "\t5"), ("e.csv", '"a"junk,5'), ("e.csv", 'a"b,5'), ("e.csv", '"a,5'), ("e.json", "[[1, 5]]"), ("e.json", '[["a", 1.5]]'), ("e.json", '{"a": 1}'), ("e.json", "nope"), ("e.tsv", "a\t9223372036854775808"), ("e.xml", "a\t5")],
)
def test_bad_files(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(errors.LoadError, match=name):
        api.compile(HEAD + f'input e from "{name}".').load_inputs(str(tmp_path))


def test_loading_is_atomic_and_once(tmp_path):
    (tmp_path / "e.tsv").write_text("a\t1")
    p = api.compile(HEAD + 'input e from "e.tsv". input w from "missing.tsv".')
    with pytest.raises(errors.LoadError):
        p.load_inputs(str(tmp_path))
    assert p.checked.facts == []
    (tmp_path / "missing.tsv").write_text("a\tb\t1")
    p.load_inputs(str(tmp_path))
    with pytest.raises(errors.LoadError):
        p.load_inputs(str(tmp_path))
    with pytest.raises(errors.LoadError):
        load(tmp_path, 'input n from "n.tsv".', n_tsv="a")


def test_scan_agrees_with_loading(spark, tmp_path):
    decl = api.compile(HEAD).checked.decls
    for name, text in (("e.tsv", "a\t5\nb \"c\t-2\n"), ("e.csv", 'a,5\n"b ""c",-2\n'), ("e.json", '["a", 5]\n["b \\"c", -2]\n')):
        (tmp_path / name).write_text(text)
        got = sorted(map(tuple, files.scan(spark, str(tmp_path / name), decl["e"]).collect()))
        assert got == [("a", 5), ('b "c', -2)], name
    (tmp_path / "w.tsv").write_text("a\tb\t3")
    assert api.compile(HEAD).bind_file(spark, "w", str(tmp_path / "w.tsv")).frames(spark)["w"].collect()[0].w == 3
    for name, text in (("x.tsv", "a"), ("x.csv", '"a"junk,5'), ("x.json", "[1, 5]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017  Spark's own, with the row in its text
            files.scan(spark, str(tmp_path / name), decl["e"]).collect()


def run(capsys, *args):
    code = main(list(args))
    out = capsys.readouterr()
    return code, out.out, out.err


PROV = """domain f.
pred owns(f, f): Bool.
pred controls(f, f): Prov.
0.9 :: owns(acme, shell).
0.8 :: owns(shell, target).
0.3 :: owns(acme, target).
controls(X, Y) :- owns(X, Y).
controls(X, Z) :- owns(X, Y), owns(Y, Z).
"""


def test_command_line(tmp_path, capsys):
    f = tmp_path / "p.dl"
    f.write_text(PROV)
    code, out, _ = run(capsys, "run", str(f))
    assert code == 0 and "0.804 :: controls(acme, target)\n  ⇐ [0.9 :: owns(acme, shell)] ∧ [0.8 :: owns(shell, target)]\n  ⇐ [0.3 :: owns(acme, target)]\n" in out
    f.write_text(PROV + "?prob controls(acme, target).\n?grad controls(acme, target).\n")
    assert run(capsys, "run", str(f))[1].splitlines()[:2] == ["0.804 :: controls(acme, target)"] * 2
    f.write_text("domain d. pred e(d, int): Trop. 3 :: e(b, 1). 2 :: e(a, 1). ?e(_, 1).")
    assert run(capsys, "run", str(f), "--semi-naive")[1] == "e(b, 1) = 3\ne(a, 1) = 2\n"  # symbols by first appearance
    f.write_text("@asp. pred p(): Bool. p() :- not p().")
    assert run(capsys, "run", str(f))[1] == "UNSATISFIABLE\n"
    f.write_text("@terms. domain d. pred nat(d): Bool. nat(zero). nat(succ(N)) :- nat(N).")
    assert run(capsys, "run", str(f))[1].endswith("% status: Sound (possibly incomplete) — 1 derivation(s) dropped at depth bound 64\n")


def test_exit_codes(tmp_path, capsys):
    f = tmp_path / "p.dl"
    f.write_text("domain d. pred e(d): Bool. e(a, b).")
    assert run(capsys, "check", str(f))[0] == 1
    assert "E1005" in run(capsys, "check", str(f), "--error-format=json")[1]
    assert run(capsys, "run", str(f))[0] == 1
    assert run(capsys)[0] == 2 and run(capsys, "run", str(f), "--nope")[0] == 2 and run(capsys, "check", "/nonexistent")[0] == 2
    f.write_text("domain d. pred w(d): Trop. pred e(d): Bool. 0.5 :: e(a).")
    assert run(capsys, "run", str(f))[0] == 4
    f.write_text("domain  d.")
    assert run(capsys, "fmt", str(f)) == (0, "domain d.\n", "") and run(capsys, "fmt", str(f), "--check")[0] == 1
    code, out, _ = run(capsys, "ir", str(f), "--to", "json")
    (tmp_path / "p.json").write_text(out)
    assert run(capsys, "ir", str(tmp_path / "p.json"), "--to", "surface")[1] == "domain d.\n"


def test_intermediates_can_be_deleted(spark):
    from semilog import storage

    df = storage.written(spark.range(5), "numbers")
    assert df.count() == 5
    storage.clear(spark)
    with pytest.raises(Exception):  # noqa: B017
        storage.written(spark.range(1), "again").union(df).collect()
