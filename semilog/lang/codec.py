"""A program as JSON and back, and the JSON's schema.

Enums with data are objects with ``kind`` and ``data``; enums without data are strings; a weight is an integer or
``"inf"``; absent fields have their default.
"""

from __future__ import annotations

import json

from semilog.lang import tree as t

EFFECT_FIELDS = {"total": "termination", "partial": "termination", "complete": "completeness", "sound_only": "completeness", "deterministic": "determinism", "stochastic": "determinism"}
KINDS = {t.Domain: "domain", t.Predicate: "predicate", t.Rule: "rule", t.Fact: "fact", t.Input: "input", t.Query: "query", t.Pragma: "pragma"}


class LoadError(ValueError):
    """The JSON is no program of a version that can be read."""


def term_out(x: t.Term) -> dict:
    if isinstance(x, t.Var):
        return {"kind": "var", "data": {"name": x.name}}
    if isinstance(x, t.Const):
        return {"kind": "const", "data": {"name": x.name}}
    if isinstance(x, t.Int):
        return {"kind": "int", "data": {"value": x.value}}
    if isinstance(x, t.Agg):
        return {"kind": "agg", "data": {"op": x.op, "var": x.var}}
    return {"kind": "compound", "data": {"functor": x.functor, "args": [term_out(a) for a in x.args]}}


def term_in(x: dict) -> t.Term:
    kind, d = x["kind"], x["data"]
    if kind == "compound":
        return t.Compound(d["functor"], tuple(map(term_in, d["args"])))
    return {"var": t.Var, "const": t.Const, "int": t.Int, "agg": t.Agg}[kind](*d.values()) if kind != "agg" else t.Agg(d["op"], d["var"])


def atom_out(a: t.Atom) -> dict:
    return {"pred": a.pred, "args": [term_out(x) for x in a.args]}


def atom_in(a: dict) -> t.Atom:
    return t.Atom(a["pred"], tuple(map(term_in, a["args"])))


def node_out(n) -> dict:
    if isinstance(n, t.Predicate):
        kind = {"kind": "prov_k", "data": {"k": n.annotation.k}} if n.annotation.kind == "prov_k" else {"kind": n.annotation.kind}
        args = [{"kind": "int"} if a[0] == "int" else {"kind": a[0], "data": {"name": a[1]}} for a in n.args]
        out = {"name": n.name, "sig": {"args": args, "annotation": kind, "effects": {EFFECT_FIELDS[e]: e for e in n.effects}}}
        return out | ({"neural": {"model": n.model}} if n.model is not None else {})
    if isinstance(n, t.Rule):
        return {"head": atom_out(n.head), "body": [{"kind": "neg" if b.negated else "pos", "data": atom_out(b.atom)} for b in n.body]}
    if isinstance(n, t.Fact):
        out = {"atom": atom_out(n.atom)}
        out |= {"weight": n.weight} if n.weight is not None else {}
        return out | ({"prob": n.prob} if n.prob is not None else {})
    if isinstance(n, t.Query):
        return {"kind": n.kind, "atom": atom_out(n.atom)}
    if isinstance(n, t.Input):
        return {"pred": n.pred, "path": n.path}
    return {"name": n.name}


def node_in(kind: str, d: dict):
    if kind == "domain":
        return t.Domain(d["name"])
    if kind == "predicate":
        sig = d["sig"]
        args = tuple((a["kind"],) if a["kind"] == "int" else (a["kind"], a["data"]["name"]) for a in sig["args"])
        ann = sig["annotation"]
        return t.Predicate(d["name"], args, t.Annotation(ann["kind"], ann.get("data", {}).get("k")), tuple(sig.get("effects", {}).values()), d.get("neural", {}).get("model"))
    if kind == "rule":
        return t.Rule(atom_in(d["head"]), tuple(t.Literal(atom_in(b["data"]), b["kind"] == "neg") for b in d["body"]))
    if kind == "fact":
        return t.Fact(atom_in(d["atom"]), d.get("weight"), d.get("prob"))
    if kind == "query":
        return t.Query(d["kind"], atom_in(d["atom"]))
    if kind == "input":
        return t.Input(d["pred"], d["path"])
    if kind == "pragma":
        return t.Pragma(d["name"])
    raise LoadError(f"unknown statement {kind!r}")


def to_json(program: t.Program) -> str:
    return json.dumps({"ir_version": t.VERSION, "items": [{"kind": KINDS[type(i.node)], "data": node_out(i.node)} for i in program.items]}, indent=2, ensure_ascii=False)


def from_json(text: str) -> t.Program:
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise LoadError(f"not JSON: {e}") from e
    version = raw.get("ir_version") if isinstance(raw, dict) else None
    parts = str(version).split(".")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        raise LoadError(f"bad version {version!r}")
    if parts[:2] != t.VERSION.split(".")[:2]:  # below 1.0 a minor version may break
        raise LoadError(f"version {version} can't be read by {t.VERSION}")
    try:
        return t.Program([t.Item(node_in(i["kind"], i["data"])) for i in raw["items"]])
    except (KeyError, TypeError) as e:
        raise LoadError(f"not a program: {e!r}") from e


def schema() -> dict:
    """A JSON Schema of ``to_json``'s output."""
    ref = lambda n: {"$ref": f"#/$defs/{n}"}
    text, whole = {"type": "string"}, {"type": "integer"}
    obj = lambda **p: {"type": "object", "properties": p, "required": list(p)}
    tagged = lambda **k: {"oneOf": [obj(kind={"const": n}, **({"data": d} if d else {})) for n, d in k.items()]}
    items = lambda x: {"type": "array", "items": x}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        **obj(ir_version=text, items=items(ref("item"))),
        "$defs": {
            "term": tagged(var=obj(name=text), const=obj(name=text), int=obj(value=whole), agg=obj(op={"enum": ["min", "max", "sum", "count", "prob_or"]}, var=text), compound=obj(functor=text, args=items(ref("term")))),
            "atom": obj(pred=text, args=items(ref("term"))),
            "literal": tagged(pos=ref("atom"), neg=ref("atom")),
            "item": tagged(
                domain=obj(name=text), predicate=obj(name=text, sig=obj(args=items(tagged(domain=obj(name=text), int=None, term=obj(name=text))), annotation=tagged(bool=None, trop=None, prov=None, prov_k=obj(k=whole)))),
                rule=obj(head=ref("atom"), body=items(ref("literal"))), fact=obj(atom=ref("atom")), input=obj(pred=text, path=text), query=obj(kind={"enum": ["plain", "prob", "grad"]}, atom=ref("atom")), pragma=obj(name={"enum": ["terms", "asp"]}),
            ),
        },
    }
