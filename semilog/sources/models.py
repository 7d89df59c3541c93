"""Models in the same process: callables whose soft outputs become facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from semilog.errors import ModelError
from semilog.lang.checker import Checked, Soft


def attach_models(checked: Checked, models: dict[str, Callable[[], Iterable]]) -> None:
    """Soft facts of every neural predicate's model, in the order of declarations; all or none, and only once.

    A model gives rows ``(pred, args, p)``.
    """
    if checked.models_attached:
        raise ModelError("models are attached already")
    new: list[Soft] = []
    for decl in checked.decls.values():
        if decl.model is None:
            continue
        if decl.model not in models:
            raise ModelError(f"no model `{decl.model}` for `{decl.name}`")
        for pred, args, p in models[decl.model]():
            if pred != decl.name:
                raise ModelError(f"model `{decl.model}` gives facts of `{pred}`, not of `{decl.name}`")
            if len(args) != len(decl.args):
                raise ModelError(f"model `{decl.model}` gives {len(args)} arguments, `{decl.name}` has {len(decl.args)}")
            if not 0 <= float(p) <= 1:
                raise ModelError(f"model `{decl.model}` gives probability {p}, not in [0, 1]")
            new.append(Soft(pred, tuple(args), float(p)))
    checked.soft += new
    checked.models_attached = True
