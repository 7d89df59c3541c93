"""Diagnostics with a stable code, a place, and often a fix; as text or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: Codes and what they stand for.
CODES = {
    "E0001": "unexpected character",
    "E0002": "a different token was expected",
    "E0003": "unexpected end of input",
    "E0010": "singleton variable",
    "E0100": "grammatical but not implemented",
    "E1001": "predicate is used but never declared",
    "E1002": "negation or aggregation through a cycle",
    "E1003": "variable isn't range-restricted",
    "E1004": "fact isn't ground",
    "E1005": "arity doesn't match the declaration",
    "E1006": "Prov_k needs a bound of 1 or more",
    "E1007": "rule mixes incompatible annotations",
    "E1008": "annotation can't be recursive here",
    "E1009": "fact's annotation doesn't fit its predicate",
    "E1010": "certain fact on a neural predicate",
    "E1011": "no meaning under @asp",
    "E1012": "predicate redeclared differently",
}


@dataclass(frozen=True)
class Fix:
    message: str
    span: tuple[int, int]
    replacement: str


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    span: tuple[int, int] = (0, 0)
    fix: Fix | None = None


def place(source: str, offset: int) -> tuple[int, int]:
    """Line and column, from 1."""
    before = source[:offset]
    return before.count("\n") + 1, offset - (before.rfind("\n") + 1) + 1


def as_text(found: list[Diagnostic], source: str) -> str:
    out = []
    for d in found:
        line, column = place(source, d.span[0])
        out.append(f"error[{d.code}]: {d.message}\n  --> {line}:{column}\n")
        if d.fix:
            out.append(f"  fix: {d.fix.message}\n")
    return "".join(out)


def as_json(found: list[Diagnostic]) -> str:
    rows = []
    for d in found:
        row = {"code": d.code, "severity": "error", "message": d.message, "span": {"start": d.span[0], "end": d.span[1]}}
        if d.fix:
            row["fix"] = {"message": d.fix.message, "span": {"start": d.fix.span[0], "end": d.fix.span[1]}, "replacement": d.fix.replacement}
        rows.append(row)
    return json.dumps(rows)


class ProgramError(ValueError):
    """A program was refused; ``diagnostics`` says why."""

    def __init__(self, found: list[Diagnostic], source: str = ""):
        super().__init__(as_text(found, source))
        self.diagnostics = found
