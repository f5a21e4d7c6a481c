"""The four annotation semirings, described as column expressions.

A semiring tells a :class:`~provframe.frame.KFrame` which annotation columns its
rows carry and how Spark combines them:

* ``symbolic`` semirings carry one *witness* per row: the source rows whose
  joint presence derives the tuple. A tuple with k witnesses is k rows, so
  addition is a grouping and multiplication is whatever the join already did.
* semirings with a :class:`Weight` carry one scalar per row. The column is left
  out while every row weighs ``one``, so plain pipelines stay plain SQL.

==========  ========  ======  =========================================
constant    symbolic  weight  a row stands for
==========  ========  ======  =========================================
``B``       no        no      the tuple is present
``N``       no        yes     the tuple occurs ``weight`` times
``BX``      yes       no      one clause of the tuple's positive formula
``NX``      yes       yes     one monomial with coefficient ``weight``
==========  ========  ======  =========================================
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT_TYPE = "decimal(38,0)"


def _exact(value: Column, what: str) -> Column:
    """Fail instead of carrying the NULL that an overflow leaves when ANSI mode is off."""
    return F.coalesce(value, F.raise_error(F.lit(f"{what} exceeds {COUNT_TYPE}")).cast(COUNT_TYPE))


@dataclass(frozen=True)
class Weight:
    """A scalar commutative semiring in Spark terms.

    ``plus`` maps a column to the aggregate that adds it up over a group,
    ``times`` multiplies two columns, ``total_of_ones`` is the aggregate for
    rows whose weight column was left out because each weighs ``one``.

    ``zero_sum_free``: nothing but zeros adds up to zero. ``zero_divisor_free``:
    nothing but zero multiplies to zero. Without these promises sums and products
    are filtered, as a tuple annotated with zero is absent. ``valid`` says of a
    given number whether it is an element at all. ``natural`` maps a natural number to the
    one added so often, which :func:`provframe.operators.valuation.specialise` needs for coefficients. ``lattice``
    promises that both operations are idempotent and absorb each other.

    Elements may be arrays and structs; ``zero`` and ``one`` are then functions that give a Column. With ``staged`` the
    rows of a tuple are added up in each task before they move, for sums whose aggregate would otherwise collect them: what moves
    is one element for each task and tuple.
    """

    dtype: str
    zero: object
    one: object
    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    total_of_ones: Callable[[], Column] | None = None
    zero_sum_free: bool = False
    zero_divisor_free: bool = False
    valid: Callable[[Column], Column] | None = None
    natural: Callable[[Column], Column] | None = None
    lattice: bool = False
    staged: bool = False

    def given(self, value: Column) -> Column:
        """A number from outside as an element; raises for NULL and for what isn't one."""
        fine = value.isNotNull() if self.valid is None else value.isNotNull() & self.valid(value)
        refuse = F.raise_error(F.concat(F.lit("not an annotation: "), F.coalesce(value.cast("string"), F.lit("NULL"))))
        return F.when(fine, value.cast(self.dtype)).otherwise(refuse.cast(self.dtype))

    def lit_one(self) -> Column:
        return (self.one() if callable(self.one) else F.lit(self.one)).cast(self.dtype)

    def lit_zero(self) -> Column:
        return (self.zero() if callable(self.zero) else F.lit(self.zero)).cast(self.dtype)

    def is_zero(self, value: Column) -> Column:
        return value == self.lit_zero()

    def total(self, value: Column | None) -> Column:
        """Aggregate that adds a group's weights; ``None`` means all ones."""
        if value is not None:
            return self.plus(value)
        if self.total_of_ones is not None:
            return self.total_of_ones()
        return self.plus(self.lit_one())


COUNTS = Weight(
    dtype=COUNT_TYPE,
    zero=0,
    one=1,
    plus=lambda c: _exact(F.sum(c).cast(COUNT_TYPE), "sum of multiplicities"),
    times=lambda a, b: _exact((a * b).cast(COUNT_TYPE), "product of multiplicities"),
    total_of_ones=lambda: F.count(F.lit(1)).cast(COUNT_TYPE),
    zero_sum_free=True,
    zero_divisor_free=True,
    valid=lambda c: (c >= 0) & (c == F.floor(c)),
    natural=lambda c: c,
)


@dataclass(frozen=True)
class Semiring:
    """Name plus the two choices above; semirings are compared by name.

    A user-defined scalar semiring is ``Semiring("name", weight=Weight(...))``.
    """

    name: str
    symbolic: bool = False
    weight: Weight | None = None

    def same_as(self, other: "Semiring") -> bool:
        return self.name == other.name

    @property
    def keeps_exponents(self) -> bool:
        """Whether using a source row twice differs from using it once."""
        return self.symbolic and self.weight is not None


B = Semiring("B")
N = Semiring("N", weight=COUNTS)
BX = Semiring("B[X]", symbolic=True)
NX = Semiring("N[X]", symbolic=True, weight=COUNTS)

BY_NAME = {s.name: s for s in (B, N, BX, NX)}
