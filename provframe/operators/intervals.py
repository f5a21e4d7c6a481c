"""Joins on intervals: a value between two bounds, and two intervals that overlap.

Intervals are binned by their length: one of length at most 2^k lies in bins of that width, two of them at most (three
where rounding says so), whatever its length. A value is looked for in its one bin of every width that occurs on the other
side, an overlapping interval in its bins of every width that is no shorter than its own. So there is no width to guess, a long interval
is never cut into many pieces, and the work grows with the rows, times the number of different magnitudes of length, plus the results.

Bounds and bins are computed once for each row, not for each pair. Where no equality deals the rows too, a bin with very many pairs is
laid out as a grid: rows of either side are dealt by a hash and meet those of the other side in cells, so wide bins are the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.frame import KFrame, condition
from provframe.functions.witness import quoted

#: Widths are powers of two within the range of doubles; bin numbers stay within a bigint.
LEAST_LEVEL, GREATEST_LEVEL, LARGEST_BIN = -1000, 1023, 4e18
LARGEST = 1.7e308

LEVEL, BIN, OWN_LEVEL, OWN_BIN = "__level", "__bin", "__own_level", "__own_bin"
#: Rows of one side that a cell of a bin has, about.
CELL_ROWS = 4096


def _number(x: Column) -> Column:
    x = x.cast("double")
    return F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))


def level_of(low: Column, high: Column) -> Column:
    """k such that the interval is at most 2^k long; zero for a single value; NULL for an empty interval."""
    length = _number(high) - _number(low)
    # Bounds that differ but not as doubles have length zero here.
    k = F.coalesce(F.ceil(F.log2(F.least(length, F.lit(LARGEST)))).cast("int"), F.lit(0))
    bounded = F.least(F.greatest(k, F.lit(LEAST_LEVEL)), F.lit(GREATEST_LEVEL))
    return F.when(low < high, bounded).when(low == high, F.lit(0))


def bin_of(x: Column, level: Column) -> Column:
    """The bin of a value; never falls as the value grows."""
    place = _number(x) / F.pow(F.lit(2.0), level)
    return F.floor(F.greatest(F.least(place, F.lit(LARGEST_BIN)), F.lit(-LARGEST_BIN))).cast("bigint")


def _levels(rows: DataFrame, level: Column) -> Column:
    """The levels that occur, as a scalar subquery: at most one for each power of two."""
    return rows.agg(F.collect_set(level).alias("__levels")).scalar()


def _with_bins(rows: DataFrame, low: Column, high: Column, level: str, bin_name: str, first: str = "__first") -> DataFrame:
    """Each row once for every bin of its level that the interval touches, and the first of them."""
    at = F.col(level)
    rows = rows.where(at.isNotNull()).withColumn(first, bin_of(low, at))
    return rows.withColumn(bin_name, F.explode(F.sequence(F.col(first), bin_of(high, at))))


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with their cell of the bin, as ``__row`` and ``__column``. Bins with many rows on both sides are cut into cells."""
    mine = left.groupBy(OWN_LEVEL, OWN_BIN).agg(F.count(F.lit(1)).alias("__m"))
    theirs = right.groupBy(LEVEL, BIN).agg(F.count(F.lit(1)).alias("__t"))
    both = mine.join(theirs, (F.col(OWN_LEVEL) == F.col(LEVEL)) & (F.col(OWN_BIN) == F.col(BIN)))
    parts = lambda n: F.ceil(F.col(n) / F.lit(CELL_ROWS)).cast("int")
    # As many as the pairs over those of a cell, at most.
    large = both.select(F.col(LEVEL).alias("__at_level"), F.col(BIN).alias("__at_bin"), parts("__m").alias("__rows"), parts("__t").alias("__columns")).where("__rows > 1 OR __columns > 1")

    def cells(rows: DataFrame, level: str, bin_name: str, own: str, size: str, other: str, other_size: str) -> DataFrame:
        hashed = rows.withColumn("__hash", F.xxhash64(*[F.col(quoted(c)) for c in rows.columns]))
        rows = hashed.join(F.broadcast(large), (F.col(level) == F.col("__at_level")) & (F.col(bin_name) == F.col("__at_bin")), "left")
        rows = rows.withColumn(own, F.coalesce(F.pmod(F.col("__hash"), F.col(size)).cast("int"), F.lit(0)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_size), F.lit(1)) - 1))).drop("__hash", "__at_level", "__at_bin", "__rows", "__columns")

    return cells(left, OWN_LEVEL, OWN_BIN, "__r1", "__rows", "__c1", "__columns"), cells(right, LEVEL, BIN, "__c2", "__columns", "__r2", "__rows")


def tasks_of(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)


def _meet(left: DataFrame, right: DataFrame, cond: Column, extra: Column | None, dealt: bool) -> DataFrame:
    """Joins rows by level and bin. With ``dealt``, bins with many rows on both sides are cut into cells."""
    on = (F.col(OWN_LEVEL) == F.col(LEVEL)) & (F.col(OWN_BIN) == F.col(BIN)) & cond
    on = on if extra is None else on & extra
    if not dealt:
        return left.join(right, on)
    count = tasks_of(left)
    left, right = _dealt(left, right)
    left = left.repartition(count, OWN_LEVEL, OWN_BIN, "__r1", "__c1")
    right = right.repartition(count, LEVEL, BIN, "__r2", "__c2")
    on = (F.col("__r1") == F.col("__r2")) & (F.col("__c1") == F.col("__c2")) & on
    return left.join(right, on).drop("__r1", "__r2", "__c1", "__c2")


@dataclass(frozen=True)
class Cells:
    """Rows of both sides, dealt to the cells where they meet, and what makes them a pair there: of each comparison the smaller
    side's value, the greater side's, whether the left has the smaller one, and whether equal values don't do."""

    left: DataFrame
    right: DataFrame
    comparisons: tuple[tuple[Column, Column, bool, bool], ...]

    #: The columns that name a cell, on either side.
    PLACES = ((OWN_LEVEL, OWN_BIN, "__r1", "__c1"), (LEVEL, BIN, "__r2", "__c2"))


def _asked(left: DataFrame, right: DataFrame, value: Column, low: Column, high: Column) -> tuple[DataFrame, DataFrame]:
    """Values and intervals with their levels and bins."""
    bounded = right.withColumns({"__low": low, "__high": high}).withColumn(LEVEL, level_of(F.col("__low"), F.col("__high")))
    binned = _with_bins(bounded, F.col("__low"), F.col("__high"), LEVEL, BIN)
    asking = left.withColumn("__value", value).where("__value IS NOT NULL").withColumn("__levels", _levels(right, level_of(low, high)))
    asking = asking.withColumn(OWN_LEVEL, F.explode("__levels")).drop("__levels").withColumn(OWN_BIN, bin_of(F.col("__value"), F.col(OWN_LEVEL)))
    return asking, binned


def between_cells(left: DataFrame, right: DataFrame, value: Column, low: Column, high: Column, above: tuple[Column, Column] | None) -> list[Cells]:
    one, two = _dealt(*_asked(left, right, value, low, high))
    inside = ((F.col("__low"), F.col("__value"), False, False), (F.col("__value"), F.col("__high"), True, False))
    return [Cells(one, two, inside if above is None else (*inside, (above[1], above[0], False, True)))]


def between_join(left: KFrame, right: KFrame, extra: Column | None, value, low, high, dealt: bool = True, above: tuple | None = None) -> KFrame:
    """Pairs whose value on the left lies between two expressions of the right; with ``above`` also the first of two values is greater."""
    from provframe.operators.pairs import Pairs

    given = (value, low, high)
    value, low, high = (condition(x) for x in given)
    cond = F.col("__value").between(F.col("__low"), F.col("__high"))
    if above is not None:
        cond = cond & (condition(above[0]) > condition(above[1]))
    other, leaves = left._right_side(right)
    asking, binned = _asked(left.df, other, value, low, high)
    joined = _meet(asking, binned, cond, extra, dealt)
    product = left._product(joined.drop(LEVEL, BIN, OWN_LEVEL, OWN_BIN, "__value", "__low", "__high", "__first"), right, leaves)
    if extra is not None or not all(isinstance(x, str) for x in (*given, *(above or ()))):
        return product  # columns may be bound to these very rows
    again = lambda one, two: between_join(one, two, None, *given, dealt, above)
    cells = lambda one, two: between_cells(one, two, value, low, high, above and tuple(map(condition, above)))
    return replace(product, pairs=Pairs(product.df, left, right, again, given, above, cells))


def overlap_join(left: KFrame, right: KFrame, extra: Column | None, left_bounds: tuple, right_bounds: tuple, dealt: bool = True) -> KFrame:
    """Pairs of intervals, both closed, that have a value in common; each pair is found in the bin of its first common value.

    A pair meets at the width of its longer interval, so one half of the join deals by the widths of the right side, the
    other by those of the left.
    """
    from provframe.operators.pairs import Pairs

    given = (left_bounds, right_bounds)
    left_bounds, right_bounds = (tuple(condition(x) for x in bounds) for bounds in given)
    other, leaves = left._right_side(right)
    cond = (F.col("__a") <= F.col("__d")) & (F.col("__c") <= F.col("__b")) & (F.col(BIN) == F.greatest("__first1", "__first2"))
    halves = [
        _meet(one, two, cond, extra, dealt).drop(LEVEL, BIN, OWN_LEVEL, OWN_BIN, "__a", "__b", "__c", "__d", "__first1", "__first2")
        for one, two, _, _ in _halves(left.df, other, left_bounds, right_bounds)
    ]
    product = left._product(halves[0].unionByName(halves[1]), right, leaves)
    if extra is not None or not all(isinstance(x, str) for bounds in given for x in bounds):
        return product  # columns may be bound to these very rows
    again = lambda one, two: overlap_join(one, two, None, *given, dealt)
    cells = lambda one, two: overlap_cells(one, two, left_bounds, right_bounds)
    return replace(product, pairs=Pairs(product.df, left, right, again, None, None, cells))


def _halves(left: DataFrame, right: DataFrame, left_bounds: tuple, right_bounds: tuple) -> Iterator[tuple[DataFrame, DataFrame, str, str]]:
    """Both halves of the join: rows of both sides with level and bin, and the names of the first bin of either."""
    bounded = lambda rows, bounds, names: rows.withColumns(dict(zip(names, bounds)))
    mine = bounded(left, left_bounds, ("__a", "__b")).withColumn(OWN_LEVEL, level_of(F.col("__a"), F.col("__b"))).where(F.col(OWN_LEVEL).isNotNull())
    theirs = bounded(right, right_bounds, ("__c", "__d")).withColumn(LEVEL, level_of(F.col("__c"), F.col("__d"))).where(F.col(LEVEL).isNotNull())
    for short, short_bounds, short_level, short_bin, long, long_bounds, long_level, long_bin, more in (
        (mine, ("__a", "__b"), OWN_LEVEL, OWN_BIN, theirs, ("__c", "__d"), LEVEL, BIN, 0),
        (theirs, ("__c", "__d"), LEVEL, BIN, mine, ("__a", "__b"), OWN_LEVEL, OWN_BIN, 1),
    ):
        least = F.col(short_level) + more
        # The shorter interval's own level gives way to the one it is looked for at.
        spread = short.withColumn("__levels", _levels(long, F.col(long_level))).withColumn("__at", F.explode(F.filter("__levels", lambda k: k >= least)))
        spread = spread.drop("__levels", short_level).withColumnRenamed("__at", short_level)
        spread = _with_bins(spread, *map(F.col, short_bounds), short_level, short_bin, "__first1")
        binned = _with_bins(long, *map(F.col, long_bounds), long_level, long_bin, "__first2")
        yield (spread, binned, "__first1", "__first2") if short is mine else (binned, spread, "__first2", "__first1")


def overlap_cells(left: DataFrame, right: DataFrame, left_bounds: tuple, right_bounds: tuple) -> list[Cells]:
    found = []
    for one, two, own_first, first in _halves(left, right, left_bounds, right_bounds):
        # The bin of the greater of two values is the greater of their bins: one of the two begins here.
        begins = (F.when(F.col(OWN_BIN) == F.col(own_first), 0).otherwise(1), F.when(F.col(BIN) == F.col(first), 1).otherwise(0), True, False)
        common = ((F.col("__a"), F.col("__d"), True, False), (F.col("__c"), F.col("__b"), False, False), begins)
        found.append(Cells(*_dealt(one, two), common))
    return found
