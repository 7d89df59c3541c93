"""Ground rules of any number as DataFrames: least models, simplification and unfounded sets by joins.

Rules have columns ``rule`` (a number of its own), ``head`` (null for a constraint), ``pos`` and ``neg`` (arrays of
atoms); sets of atoms have a column ``atom``. All atoms are bigint.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semilog.storage import written

#: Rounds' parts of a model that are kept apart before they are written as one table.
COMPACT = 8


def least_model(rules: DataFrame) -> DataFrame:
    """The least set closed under the rules, negations passed over.

    A round counts, for each rule of several atoms, which of them became true; a rule whose count is full gives its
    head. Each pair of rule and atom is joined once, when the atom is new.
    """
    heads = rules.where(F.col("head").isNotNull()).select("rule", "head", F.array_distinct("pos").alias("pos"))
    # A rule of one atom needs no count: the atom leads to the head.
    leads = written(heads.where(F.size("pos") == 1).select(F.get("pos", F.lit(0)).alias("atom"), F.col("head").alias("next")).distinct(), "leads")
    several = heads.where(F.size("pos") > 1)
    needs = written(several.select("rule", F.explode("pos").alias("atom")), "needs")
    sizes = written(several.select("rule", "head", F.size("pos").cast("bigint").alias("n")), "sizes")
    counts = not needs.isEmpty()
    new = written(heads.where(F.size("pos") == 0).select(F.col("head").alias("atom")).distinct(), "model")
    parts, met = [new], None
    while not new.isEmpty():
        found = leads.join(new, "atom", "left_semi").select(F.col("next").alias("atom"))
        if counts:
            hits = needs.join(new, "atom").select("rule", F.lit(1).cast("bigint").alias("n"))
            met = written((hits if met is None else met.union(hits)).groupBy("rule").agg(F.sum("n").alias("n")), "met")
            found = found.union(sizes.join(met, ["rule", "n"]).select(F.col("head").alias("atom")))
        new = written(found.distinct().join(functools.reduce(DataFrame.union, parts), "atom", "left_anti"), "model")
        parts.append(new)
        if len(parts) > COMPACT:
            parts = [written(functools.reduce(DataFrame.union, parts), "model")]
    return functools.reduce(DataFrame.union, parts)


def touching(rules: DataFrame, column: str, atoms: DataFrame, inside: bool) -> DataFrame:
    """The numbers of rules that have an atom of ``column`` in the set, or outside of it."""
    each = rules.select("rule", F.explode(column).alias("atom"))
    return each.join(atoms, "atom", "left_semi" if inside else "left_anti").select("rule").distinct()


def reduct(rules: DataFrame, model: DataFrame) -> DataFrame:
    """The rules without negations, as far as the model allows them; constraints go."""
    left = rules.where(F.col("head").isNotNull()).join(touching(rules, "neg", model, True), "rule", "left_anti")
    return left.select("rule", "head", "pos", F.array().cast("array<bigint>").alias("neg"))


def founded_set(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Atoms of the model that rules derive without going in circles."""
    own = rules.join(touching(rules, "pos", model, False), "rule", "left_anti").join(model.select(F.col("atom").alias("head")), "head", "left_semi")
    return least_model(reduct(own, model))


def greatest_unfounded_set(rules: DataFrame, model: DataFrame) -> DataFrame:
    return model.join(founded_set(rules, model), "atom", "left_anti")


def possible_atoms(rules: DataFrame) -> DataFrame:
    """Atoms that are derived if every negation holds."""
    return least_model(rules)


def certain(rules: DataFrame, possible: DataFrame) -> DataFrame:
    """Atoms that are derived from impossible negations alone."""
    return least_model(rules.join(touching(rules, "neg", possible, True), "rule", "left_anti"))


def filter_rules(rules: DataFrame, possible: DataFrame, sure: DataFrame) -> DataFrame:
    """Rules with ``dead``: an impossible atom or a certain negation stands in the body; certain atoms and impossible
    negations go from the bodies of the others."""
    side = lambda c, negated: F.transform(c, lambda a: F.struct(a.alias("atom"), F.lit(negated).alias("negated")))
    literals = rules.select("rule", F.explode(F.concat(side(F.col("pos"), False), side(F.col("neg"), True))).alias("x")).select("rule", "x.*")
    told = literals.join(possible.select("atom", F.lit(True).alias("_can")), "atom", "left").join(sure.select("atom", F.lit(True).alias("_sure")), "atom", "left")
    can, is_sure = F.coalesce("_can", F.lit(False)), F.coalesce("_sure", F.lit(False))
    dead = F.bool_or(F.when(F.col("negated"), is_sure).otherwise(~can))
    own = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("atom"))))
    bodies = told.groupBy("rule").agg(dead.alias("dead"), own(~F.col("negated") & ~is_sure).alias("pos"), own(F.col("negated") & can).alias("neg"))
    empty: Column = F.array().cast("array<bigint>")
    joined = rules.select("rule", "head").join(bodies, "rule", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    kept = lambda c: F.when(F.col("dead"), empty).otherwise(F.coalesce(c, empty)).alias(c)
    return joined.select("rule", "head", "dead", kept("pos"), kept("neg"))
