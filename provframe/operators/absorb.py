"""Absorption: drop every clause that contains another clause of its tuple.

Absorption never changes what a formula means, only how it is written, so it
runs once, when a result is wanted in canonical form.

Most plans need none of it. When all clauses of a frame have one size - true for
any join of differently named tables - distinct clauses cannot contain each
other, and the plan alone proves it.

Otherwise a clause that is inside another one shares all its variables with it, so the two
meet at any variable of the shorter clause. Each clause waits at its own rarest variable, the one that
fewest clauses of its tuple have; every clause asks at each of its variables,
and the containment test decides. That is one equi-join on (tuple, variable) for clauses of any
length, and a variable that all clauses share is never a meeting place unless a clause has no other.

Where the plan knows which leaves its rows have together, and leaves can't share variables, a clause can only be inside one that has
all its leaves and more, with the same rows in them. Then there is one anti join on (tuple, those leaves) for each shape, and clauses stay
in native columns: no names are made and no clause is taken apart. If there is a leaf that all shapes have, clauses that are inside each other
have the same row in it: all clauses are dealt by it once, and put in order and absorbed where they are.

Otherwise the clauses are made distinct by one shuffle on (tuple, clause), and every branch
below reads that shuffle: conditions are put where Catalyst does not push them below it.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provframe.frame import KFrame, tuple_key
from provframe.functions.witness import NAMES

KEY, VARIABLE = "__k", "__v"


def may_absorb(frame: KFrame) -> bool:
    """Whether a clause of the frame might contain another, as far as the plan tells."""
    return not frame.antichain and (frame.sizes is None or len(frame.sizes) > 1)


def absorb(frame: KFrame) -> KFrame:
    if frame.semiring.weight is not None or not frame.semiring.symbolic:
        return frame.merge()
    if frame.absorbed and frame.is_merged:
        return frame
    if not may_absorb(frame):
        return replace(frame.merge(), absorbed=True)

    if _told_by_shape(frame):
        return _absorb_by_shape(frame)

    f = frame.as_names()
    clauses = f.df.select(tuple_key(f.attrs).alias(KEY), NAMES).distinct()
    left = clauses.join(
        _absorbed(clauses, frame.sizes is None or 0 in frame.sizes), (F.col(KEY) == F.col("__ak")) & (F.col(NAMES) == F.col("__aw")), "left_anti"
    )
    attrs = [F.col(KEY)[f"_{i}"].alias(a) for i, a in enumerate(f.attrs)]
    return replace(f, df=left.select(*attrs, NAMES), merged=True, absorbed=True)


def _told_by_shape(frame: KFrame) -> bool:
    """Whether equal variables are equal leaves. Numbers such as -0.0 and 0.0 are equal but spelt differently."""
    ids = [f.dataType for x in frame.leaves for f in x.ids.fields]
    return frame.witness_shapes is not None and frame._leaves_apart() and all(t == T.StringType() or isinstance(t, (T.IntegralType, T.DatetimeType, T.BooleanType, T.DecimalType)) for t in ids)


def _absorb_by_shape(frame: KFrame) -> KFrame:
    shapes = sorted(frame.witness_shapes, key=lambda s: (len(s), sorted(s)))
    columns = [x.column for x in frame.leaves]

    def has(shape: frozenset[int]) -> Column:
        return reduce(and_, (F.col(c).isNotNull() if k in shape else F.col(c).isNull() for k, c in enumerate(columns)), F.lit(True))

    rows = frame.df.select(tuple_key(frame.attrs).alias(KEY), *columns)
    inside = [shape for shape in shapes if any(shape < other for other in shapes)]
    core = sorted(frozenset.intersection(*shapes))
    if core:
        # The widest shape first, so that its order serves the others.
        df = rows.repartition(*[columns[k] for k in core])
        df = df if frame.is_merged else df.distinct()
        for shape in reversed(inside):
            alike = Window.partitionBy(*[columns[k] for k in core], KEY, *[columns[k] for k in _nested(shape, inside) if k not in core])
            df = df.withColumn("__found", F.max(has(shape)).over(alike)).where(~F.col("__found") | has(shape)).drop("__found")
        return _as_frame(frame, df, columns)
    # Shorter clauses are read from the unmerged rows, where Catalyst drops the branches that make other shapes.
    df = rows if frame.is_merged else rows.distinct()
    for shape in inside:
        short = rows.where(has(shape)).select(F.col(KEY).alias("__wk"), *[F.col(columns[k]).alias(f"__short{k}") for k in sorted(shape)])
        same = reduce(and_, (F.col(columns[k]) == F.col(f"__short{k}") for k in sorted(shape)), F.col(KEY) == F.col("__wk"))
        df = df.join(short, same & ~has(shape), "left_anti")
    return _as_frame(frame, df, columns)


def _as_frame(frame: KFrame, df: DataFrame, columns: list[str]) -> KFrame:
    attrs = [F.col(KEY)[f"_{i}"].alias(a) for i, a in enumerate(frame.attrs)]
    return replace(frame, df=df.select(*attrs, *columns), merged=True, absorbed=True)


def _nested(shape: frozenset[int], shapes: list[frozenset[int]]) -> list[int]:
    """The leaves of a shape, those of the shapes inside it first."""
    return sorted(shape, key=lambda k: (sum(k not in other for other in shapes if other <= shape), k))


def _absorbed(clauses: DataFrame, constants: bool) -> DataFrame:
    """(key, clause) of every clause that properly contains another one, as ``__ak, __aw``.

    The empty clause, the constant True, is inside every other: where the plan can make one, it asks and waits under a
    variable of its own that each clause also asks at.
    """
    everywhere = F.array(F.lit("").cast("string"))  # no variable has an empty name
    asked = clauses.select(KEY, NAMES, F.explode(F.concat(NAMES, everywhere) if constants else F.col(NAMES)).alias(VARIABLE))
    common = asked.groupBy(KEY, VARIABLE).agg(F.count(F.lit(1)).alias("__n"))
    counted = asked.join(common, [KEY, VARIABLE])
    own = F.when((F.col(VARIABLE) != "") | (F.size(NAMES) == 0), F.struct("__n", VARIABLE))
    waiting = (
        counted.groupBy(KEY, NAMES)
        .agg(F.min(own)[VARIABLE].alias("__at"))
        .select(F.col(KEY).alias("__wk"), F.col(NAMES).alias("__short"), "__at")
    )
    met = asked.join(waiting, (F.col(KEY) == F.col("__wk")) & (F.col(VARIABLE) == F.col("__at")))
    contained = (F.size("__short") < F.size(NAMES)) & (F.size(F.array_except("__short", NAMES)) == 0)
    return met.where(contained).select(F.col(KEY).alias("__ak"), F.col(NAMES).alias("__aw")).distinct()
