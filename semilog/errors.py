"""Errors that a run can end with."""

from __future__ import annotations


class EvalError(RuntimeError):
    """A program can't be evaluated."""


class Overflow(EvalError):
    """An integer sum left 64 bits."""


class NegativeWeightCycle(EvalError):
    """Weights fall without end."""


class NonIntegerAggregand(EvalError):
    """An aggregate met a value that is no integer."""


class Unsupported(EvalError):
    """The construct is reserved or undefined."""


class ProbError(RuntimeError):
    """A probability can't be computed."""


class TooManySoftFacts(ProbError):
    """More soft facts than worlds are enumerated for."""


class BadProbability(ProbError):
    """A probability isn't in [0, 1]."""


class NotBool(ProbError):
    """A program with Trop predicates has no probabilities."""


class ProofBudget(ProbError):
    """A tuple has more minimal proofs than the budget; declare its predicate Prov_k."""


class SoftAggregate(ProbError):
    """An aggregate reads soft tuples, which capture can't follow."""


class CircuitBudget(ProbError):
    """A circuit has more nodes than the budget."""


class AspError(RuntimeError):
    """A stable-model program can't be solved."""


class TooManyChoices(AspError):
    """More negated atoms than guesses are enumerated for."""


class TooLargeGrounding(AspError):
    """A rule has more instances than the budget."""


class LoadError(ValueError):
    """An input file can't be loaded; says file and line."""


class ModelError(ValueError):
    """A model can't be attached."""
