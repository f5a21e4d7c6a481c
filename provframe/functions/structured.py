"""Semirings whose elements are sets, lists or levels instead of one number.

An element is one array, so it grows with what it lists: lineage with the source rows of a tuple, why-sets with its
witnesses. Where a tuple may have very many, the row forms B[X] and N[X] are the ones that spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provframe.semirings import Semiring, Weight

SETS = "array<array<string>>"


def _none() -> Column:
    return F.array().cast(SETS)


def _empty_set() -> Column:
    return F.array(F.array().cast("array<string>"))


def _sets(x: Column) -> Column:
    """Different sets in order. Spark compares all pairs to find different arrays, so they are sorted first and compared with the one before."""
    x = F.array_sort(x)
    before = F.concat(F.array(F.lit(None).cast("array<string>")), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    marked = F.zip_with(x, before, lambda own, last: F.struct(own.alias("own"), own.eqNullSafe(last).alias("again")))
    return F.when(F.size(x) == 0, x).otherwise(F.transform(F.filter(marked, lambda m: ~m["again"]), lambda m: m["own"]))


#: Why-provenance: the set of all sets of source rows that derive the tuple. Zero is no set, one the empty set.
WHY = Semiring(
    "Why[X]",
    weight=Weight(
        dtype=SETS,
        zero=_none,
        one=_empty_set,
        plus=lambda c: _sets(F.flatten(F.collect_list(c))),
        times=lambda a, b: _sets(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_union(x, y)))))),
        total_of_ones=_empty_set,
        zero_sum_free=True,
        zero_divisor_free=True,
        natural=lambda c: F.when(c > 0, _empty_set()).otherwise(_none()),
        staged=True,
    ),
)


def _one_set(sets: Column) -> Column:
    """The union of some sets as the only one; none for none."""
    return F.when(F.size(sets) == 0, sets).otherwise(F.array(F.array_sort(F.array_distinct(F.flatten(sets)))))


#: Lineage: the set of all source rows that take part. Zero is no set at all, one the empty set.
LINEAGE = Semiring(
    "Lin[X]",
    weight=Weight(
        dtype=SETS,
        zero=_none,
        one=_empty_set,
        plus=lambda c: _one_set(F.flatten(F.collect_list(c))),
        times=lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), _none()).otherwise(_one_set(F.concat(a, b))),
        total_of_ones=_empty_set,
        zero_sum_free=True,
        zero_divisor_free=True,
        natural=lambda c: F.when(c > 0, _empty_set()).otherwise(_none()),
        staged=True,
    ),
)


def variables_of(*names: Column) -> Column:
    """The element that a source row has in WHY and LINEAGE: one set with its name."""
    return F.array(F.array(*names))


def clearance(levels: int) -> Semiring:
    """Access levels 0 (public) to ``levels`` - 1; ``levels`` stands for nobody. A tuple needs the least level of its derivations,
    a derivation the greatest of its rows."""
    return Semiring(
        f"clearance {levels}",
        weight=Weight(
            dtype="int",
            zero=levels,
            one=0,
            plus=F.min,
            times=F.greatest,
            total_of_ones=lambda: F.lit(0),
            zero_sum_free=True,
            zero_divisor_free=True,
            valid=lambda c: (c >= 0) & (c <= levels),
            natural=lambda c: F.when(c > 0, F.lit(0)).otherwise(F.lit(levels)),
            lattice=True,
        ),
    )


def cheapest(k: int) -> Semiring:
    """The costs of the ``k`` cheapest derivations, ascending; a source row has a list of its own cost."""
    best = lambda x: F.slice(F.array_sort(x), 1, k)
    return Semiring(
        f"cheapest {k}",
        weight=Weight(
            dtype="array<double>",
            zero=lambda: F.array().cast("array<double>"),
            one=lambda: F.array(F.lit(0.0)),
            plus=lambda c: best(F.flatten(F.collect_list(c))),
            times=lambda a, b: best(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x + y)))),
            zero_sum_free=True,
            zero_divisor_free=True,
            natural=lambda c: F.array_repeat(F.lit(0.0), F.least(c, F.lit(k)).cast("int")),
            staged=True,
        ),
    )
