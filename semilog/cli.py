"""Command line: ``check``, ``run``, ``fmt`` and ``ir``; exit codes 0 fine, 1 diagnostics, 2 usage, 4 run-time error."""

from __future__ import annotations

import os
import sys

from semilog import api
from semilog.errors import AspError, EvalError, LoadError, ModelError, ProbError
from semilog.functions import circuits
from semilog.lang import codec
from semilog.lang import tree as t
from semilog.lang.checker import check
from semilog.lang.diagnostics import ProgramError, as_json, as_text
from semilog.lang.printer import print_program
from semilog.lang.reader import read
from semilog.plans import local, worlds
from semilog.sources import files, text

USAGE = """usage: semilog check FILE [--error-format=text|json]
       semilog run FILE [--semi-naive]
       semilog fmt FILE [--check]
       semilog ir FILE --to json|surface
"""


class Usage(Exception):
    pass


def source_of(path: str) -> str:
    try:
        return open(path, encoding="utf-8").read()
    except (OSError, UnicodeDecodeError) as e:
        raise Usage(f"{path}: {e}") from e


def parsed(path: str) -> tuple[t.Program, str]:
    source = source_of(path)
    program, found = read(source)
    if found:
        raise ProgramError(found, source)
    return program, source


def answers(models: list) -> str:
    if not models:
        return "UNSATISFIABLE\n"
    return "".join(f"Answer {i}: {{{', '.join(text.line(*a) for a in m)}}}\n" for i, m in enumerate(models, 1))


def matching(rows, query: t.Query, order: text.InternOrder) -> list[tuple]:
    return order.rows([r for r in rows if text.fits(r, query)])


def asked(checked, kind: str) -> str:
    """Answers to the program's ``?prob`` or ``?grad`` queries."""
    order, p, captured, out = text.InternOrder(checked), [s.p for s in checked.soft], None, []
    for q in (q for q in checked.queries if q.kind == kind):
        if q.atom.pred in checked.modes:
            worlds.guard(checked, False)
            captured = captured or local.proofs(checked)
            found = {r: circuits.count_and_gradient(own, p) for r, own in captured.db[q.atom.pred].rows.items()}
        else:
            found = worlds.marginals(checked)[q.atom.pred]
        for row in matching(found, q, order):
            value, grad = found[row]
            if kind == "grad" or value > 0:
                out.append(text.marginal(checked, q.atom.pred, row, value))
            if kind == "grad":
                out.append(text.gradient(checked, grad))
    return "".join(out)


def run(path: str, semi_naive: bool) -> str:
    program, source = parsed(path)
    if any(p.name == "asp" for p in program.nodes(t.Pragma)):
        return answers(api.asp_models(source))
    checked = check(program, source)
    files.load_inputs(checked, os.path.dirname(path) or ".")
    kinds = {q.kind for q in checked.queries}
    if not kinds & {"grad", "prob"} and not checked.modes and not checked.soft:
        return text.relations(checked, local.plain(checked, semi_naive and not checked.terms))
    deep = text.status(checked, local.proofs(checked)) if checked.terms else ""
    if kinds & {"grad", "prob"}:  # both, if a program asks both
        return "".join(asked(checked, k) for k in ("prob", "grad") if k in kinds) + deep
    if checked.modes:
        worlds.guard(checked, False)
        return text.pedigrees(checked, local.proofs(checked)) + deep
    order, found = text.InternOrder(checked), worlds.marginals(checked)
    return "".join(text.marginal(checked, p, row, found[p][row][0]) for p in sorted(found) for row in order.rows(found[p]) if found[p][row][0] > 0) + deep


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    try:
        if len(args) < 2 or args[0] not in ("check", "run", "fmt", "ir"):
            raise Usage("a command and a file are needed")
        command, path, options = args[0], args[1], args[2:]
        allowed = {"check": {"--error-format=text", "--error-format=json"}, "run": {"--semi-naive"}, "fmt": {"--check"}, "ir": {"--to", "json", "surface"}}[command]
        if unknown := [o for o in options if o not in allowed]:
            raise Usage(f"unknown option {unknown[0]}")
        if command == "check":
            source = source_of(path)
            try:
                program, found = read(source)
                if not found:
                    check(program, source)
            except ProgramError as e:
                found = e.diagnostics
            sys.stdout.write(as_json(found) + "\n" if "--error-format=json" in options else as_text(found, source))
            return int(bool(found))
        if command == "run":
            sys.stdout.write(run(path, "--semi-naive" in options))
            return 0
        if command == "fmt":
            program, source = parsed(path)
            if "--check" in options:
                return int(print_program(program) != source)
            sys.stdout.write(print_program(program))
            return 0
        if options not in (["--to", "json"], ["--to", "surface"]):
            raise Usage("ir needs --to json or --to surface")
        if path.endswith(".json"):
            program = codec.from_json(source_of(path))
        else:
            program, _ = parsed(path)
        sys.stdout.write(codec.to_json(program) + "\n" if options[1] == "json" else print_program(program))
        return 0
    except Usage as e:
        sys.stderr.write(f"{e}\n{USAGE}")
        return 2
    except ProgramError as e:
        sys.stderr.write(str(e))
        return 1
    except (AspError, EvalError, LoadError, ModelError, ProbError, codec.LoadError) as e:
        sys.stderr.write(f"{type(e).__name__}: {e}\n")
        return 4


if __name__ == "__main__":
    sys.exit(main())
