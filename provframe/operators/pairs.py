"""Joins whose pairs far outnumber the rows: sums over pairs without the pairs, and pairs that are distinct by construction.

A join on an interval keeps its two sides beside the joined rows for as long as only columns are dropped. What :meth:`KFrame.merge`
then does depends on the semiring.

In B and N the pairs are counted, not made, where the join says that a whole number lies between two others and, with ``above``, that one value
is greater than another. An interval of whole numbers is the union of at most two dyadic cells of each width; a number is in one cell of
each, so a pair meets in exactly one cell, and nothing is left to test but the order of two values. A row of the right is asked once for
each different left tuple of its cell, and the answer is a count of what comes before it in order, found by stretches of the order. The work grows with the rows, times the different left tuples kept of a cell: the pairs at worst.

In the symbolic semirings every pair is a term and has to be made. Pairs of rows that are distinct on (kept attributes, witness) are distinct
themselves, so only the pairs of repeated rows are moved to be merged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provframe.frame import KFrame, condition, tuple_key
from provframe.functions.witness import WEIGHT, quoted, variable_name
from provframe.operators.intervals import Cells
from provframe.semirings import N

WIDEST = 63
#: Stretches of equal width into which the order of a cell is cut.
STRETCHES = 32
LEFT, RIGHT, CELL = "__left", "__right", "__cell"


@dataclass(frozen=True)
class Pairs:
    """The sides of the join that made ``df``, and the join itself for other rows of the same sides.

    ``between`` and ``above`` are the whole condition; None if there is more to it. ``cells`` deals rows of both sides to where they meet.
    """

    df: DataFrame
    left: KFrame
    right: KFrame
    join: Callable[[KFrame, KFrame], KFrame]
    between: tuple[str, str, str] | None
    above: tuple[str, str] | None
    cells: Callable[[DataFrame, DataFrame], list[Cells]]


def _kept(frame: KFrame) -> tuple[list[str], list[str]]:
    pairs = frame.pairs
    return [a for a in frame.attrs if a in pairs.left.attrs], [a for a in frame.attrs if a in pairs.right.attrs]


def merged(frame: KFrame, spelled: bool = False) -> KFrame | None:
    """The frame with equal tuples added up; None where the pairs have to be added up one by one.

    With ``spelled`` the variables are spelt before the rows are paired, for results that need the name in every pair.
    """
    if frame.pairs is None or frame.pairs.df is not frame.df:
        return None
    return _distinct(frame, spelled) if frame.semiring.symbolic else _counted(frame)


# ---- counting ------------------------------------------------------------------------------


def _cells(low: Column, high: Column) -> Column:
    """The dyadic cells that make up an interval of whole numbers, as (level, number)."""
    length = high.cast("decimal(20,0)") - low.cast("decimal(20,0)") + 1  # as doubles, large bounds would look equal
    widest = F.least(F.lit(WIDEST), F.floor(F.log2(length.cast("double"))).cast("int") + 1)

    def at(k: Column) -> Column:
        # The lowest k bits; 2^63 - 1 for the widest.
        part = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(WIDEST + 1) - k)
        part = F.when(k == 0, F.lit(0).cast("bigint")).otherwise(part)
        down = lambda x: F.call_function("shiftright", x, k)
        # Whole cells of this width are first to last; one is taken unless the cell of twice the width is whole too.
        first = down(low) + F.when(low.bitwiseAND(part) != 0, 1).otherwise(0)
        last = down(high) - F.when(high.bitwiseAND(part) != part, 1).otherwise(0)
        cell = lambda c: F.struct(k.alias("level"), c.alias("number"))
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        return F.array(F.when((first <= last) & odd(first), cell(first)), F.when((first <= last) & ~odd(last), cell(last)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), widest), at)))


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether rows of both sides, put under each other, are ordered as their comparison says."""
    plain = lambda t: isinstance(t, (T.IntegralType, T.DoubleType))
    return a == b or (plain(a) and plain(b))


def _counted(frame: KFrame) -> KFrame | None:
    pairs, semiring = frame.pairs, frame.semiring
    if pairs.between is None or pairs.above is None or not (semiring.weight is None or semiring.name == N.name) or frame.weighted:
        return None
    keep_left, keep_right = _kept(frame)
    value, low, high, x, y = (condition(c) for c in (*pairs.between, *pairs.above))
    left = pairs.left.df.select(tuple_key(keep_left).alias(LEFT) if keep_left else F.struct(F.lit(0)).alias(LEFT), value.alias("__value"), x.alias("__order"))
    right = pairs.right.df.select(tuple_key(keep_right).alias(RIGHT) if keep_right else F.struct(F.lit(0)).alias(RIGHT), low.alias("__low"), high.alias("__high"), y.alias("__order"))
    whole = all(isinstance(rows.schema[c].dataType, T.IntegralType) for rows, c in ((left, "__value"), (right, "__low"), (right, "__high")))
    if not whole or not _comparable(left.schema["__order"].dataType, right.schema["__order"].dataType):
        return None
    asking = right.where("__low <= __high AND __order IS NOT NULL")
    asking = asking.select(RIGHT, "__order", F.explode(_cells(F.col("__low").cast("bigint"), F.col("__high").cast("bigint"))).alias(CELL))
    levels = asking.agg(F.collect_set(f"{CELL}.level").alias("__levels")).scalar()
    given = left.where("__value IS NOT NULL AND __order IS NOT NULL").withColumn("__levels", levels).withColumn("__level", F.explode("__levels"))
    number = F.call_function("shiftright", F.col("__value").cast("bigint"), F.col("__level"))
    given = given.select(LEFT, "__order", F.struct(F.col("__level").alias("level"), number.alias("number")).alias(CELL))
    # Every row of the right stands among the rows of each left tuple in its cell, before those with an equal value.
    asked = asking.join(given.select(CELL, LEFT).distinct(), CELL)
    empty = F.lit(None).cast(asked.schema[RIGHT].dataType).alias(RIGHT)
    rows = given.select(CELL, LEFT, "__order", F.lit(1).alias("__side"), empty)
    rows = rows.unionByName(asked.select(CELL, LEFT, "__order", F.lit(0).alias("__side"), RIGHT))
    # A group is cut into stretches of the order, so one with very many rows is the work of many tasks.
    ends = left.agg(F.struct(F.min("__order").cast("double").alias("least"), F.max("__order").cast("double").alias("most")).alias("e")).scalar()
    number = F.col("__order").cast("double")
    stretch = F.when(F.isnan(number), F.lit(STRETCHES + 2)).otherwise(F.coalesce(F.width_bucket(number, F.col("__ends.least"), F.col("__ends.most"), F.lit(STRETCHES)), F.lit(0)))
    rows = rows.withColumn("__ends", ends).withColumn("__stretch", stretch.cast("int")).drop("__ends")
    # The hash sorts fast; the columns behind it tell.
    rows = rows.withColumn("__key", F.xxhash64(CELL, LEFT, "__stretch")).repartition("__key")
    part = ["__key", "__stretch", CELL, LEFT]
    later = Window.partitionBy(CELL, LEFT).orderBy(F.col("__stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.groupBy(*part).agg(F.sum("__side").alias("__ones")).select(*part, F.coalesce(F.sum("__ones").over(later), F.lit(0)).alias("__above"))
    inside = Window.partitionBy(*part).orderBy(F.col("__order").desc(), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__found", F.sum("__side").over(inside)).where("__side = 0").join(above, part)
    found = found.withColumn("__found", F.col("__found") + F.col("__above")).where("__found > 0")
    if semiring.weight is None:
        summed = found.select(LEFT, RIGHT).distinct()
    else:
        summed = found.groupBy(LEFT, RIGHT).agg(semiring.weight.plus(F.col("__found").cast("decimal(20,0)")).alias(WEIGHT))
    places = {a: F.col(LEFT)[f"_{i}"] for i, a in enumerate(keep_left)} | {a: F.col(RIGHT)[f"_{i}"] for i, a in enumerate(keep_right)}
    weight = [] if semiring.weight is None else [F.col(WEIGHT)]
    return replace(frame, df=summed.select(*[places[a].alias(a) for a in frame.attrs], *weight), weighted=bool(weight), merged=True, pairs=None)


# ---- distinct pairs ------------------------------------------------------------------------


def _spelled(side: KFrame) -> KFrame:
    names = {x.column: F.when(F.col(x.column).isNotNull(), F.struct(variable_name(x).alias("_0"))) for x in side.leaves}
    kind = T.StructType([T.StructField("_0", T.StringType())])
    return replace(side, df=side.df.withColumns(names), leaves=tuple(replace(x, ids=kind, spelled=True) for x in side.leaves))


def _parted(side: KFrame, kept: list[str]) -> tuple[KFrame, KFrame | None]:
    """The rows that are alone with their kept attributes and witness, and the others; None if the plan knows that there are none."""
    if side.keyed and side.leaves:
        return side, None
    columns = [quoted(a) for a in kept] + [x.column for x in side.leaves]
    repeated = side.df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(columns)))
    part = lambda how: replace(side, df=side.df.join(repeated, same, how))
    return part("left_anti"), part("left_semi")


def _distinct(frame: KFrame, spelled: bool) -> KFrame | None:
    if frame.has_names or not frame._leaves_apart() or not (frame.pairs.left.leaves and frame.pairs.right.leaves):
        return None
    pairs = frame.pairs
    sides = [(side, *_parted(side, kept)) for side, kept in zip((pairs.left, pairs.right), _kept(frame))]
    if spelled:
        sides = [tuple(part and _spelled(part) for part in parts) for parts in sides]
    (left, lone_left, many_left), (right, lone_right, many_right) = sides
    joined = lambda one, two: replace(pairs.join(one, two).project(*frame.attrs), pairs=None)
    alone = joined(lone_left, lone_right)
    weight = frame.semiring.weight
    df = alone.df
    if weight is not None and not alone.weighted:
        df = df.withColumn(WEIGHT, weight.lit_one())
    for one, two in ((many_left, right), (lone_left, many_right)):
        if one is not None and two is not None:
            df = df.unionByName(joined(one, two).merge().df)
    return replace(alone, df=df, weighted=weight is not None, merged=True, sizes=frame.sizes, antichain=frame.antichain, shapes=frame.shapes)
