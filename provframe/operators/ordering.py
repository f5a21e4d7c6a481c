"""Order over annotated relations: ranks, running sums, top-k, as-of joins.

A tuple with multiplicity n stands for n equal rows, so ranks and running sums are those of the expanded rows, which are
never made. Rows that are equal in the ordering (peers) are added up first; the peer groups are dealt to tasks by ranges of (key,
order) and written down with the number of their range. What lies before a range of the same key is a sum over a small table,
one row for each range and key. So no key is ordered in one task, however many of the rows it has: its ranges are ordered side by
side. Tuples get the result of their peer group by an equi-join that Spark can split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provframe.frame import KFrame, _check_names, col_of, tuple_key
from provframe.functions.witness import WEIGHT
from provframe.semirings import COUNT_TYPE
from provframe.session import scratch_folder

RANGE, BY, AT = "__range", "__by", "__at"


def _order(order) -> list[tuple[str, bool]]:
    """[(attribute, descending)] of names and (name, "desc") pairs; NULLs come first ascending and last descending."""
    items = [order] if isinstance(order, str) else list(order)
    out = []
    for item in items:
        name, way = (item, "asc") if isinstance(item, str) else item
        if way.lower() not in ("asc", "desc"):
            raise ValueError(f"unknown direction {way}")
        out.append((name, way.lower() == "desc"))
    if not out:
        raise ValueError("an order needs an attribute")
    return out


def _sort(columns: Sequence[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in columns]


def _key(names: Sequence[str]) -> Column:
    return tuple_key(names) if names else F.struct(F.lit(0).alias("_0"))


def in_ranges(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """``rows``, which have a column BY, written in ranges of (BY, order) with the number of the range.

    Written because the ranges come from a sample: read twice, a range must hold the same rows both times.
    """
    sort = [F.col(BY).asc(), *_sort([(F.col(c), down) for c, down in order])]
    path = scratch_folder(rows.sparkSession, "ranges")
    rows.repartitionByRange(*sort).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def before(placed: DataFrame, order: Sequence[tuple[str, bool]], measures: Mapping[str, Column], combine=F.sum) -> DataFrame:
    """``placed`` with, for each measure, what ``combine`` makes of all rows of its key that come earlier, and of those up to it.

    Columns are named ``name`` (earlier rows) and ``name_to`` (with the row itself); NULL where there is nothing.
    """
    totals = placed.groupBy(RANGE, BY).agg(*[combine(m).alias(n) for n, m in measures.items()])
    earlier = Window.partitionBy(BY).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(RANGE).alias("__r"), F.col(BY).alias("__b"), *[combine(n).over(earlier).alias(f"__off_{n}") for n in measures])
    # Within a range of a key, which is no larger than a range.
    inside = Window.partitionBy(RANGE, BY).orderBy(*_sort([(F.col(c), down) for c, down in order]))
    spans = {"": inside.rowsBetween(Window.unboundedPreceding, -1), "_to": inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)}
    met = placed.join(offsets, (F.col(RANGE) == F.col("__r")) & (F.col(BY) == F.col("__b")), "left")
    plus = (lambda a, b: F.greatest(a, b)) if combine is F.max else (lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
    columns = [plus(F.col(f"__off_{n}"), combine(m).over(span)).alias(f"{n}{tag}") for n, m in measures.items() for tag, span in spans.items()]
    return met.select(*placed.columns, *columns)


def ranked(frame: KFrame, by: Sequence[str], order, rank: str | None = "rank", dense: str | None = None, running: Mapping[str, str] | None = None) -> KFrame:
    """The relation with RANK, DENSE_RANK and running sums in each ``by`` group as further attributes.

    In N they count multiplicities: a tuple's rank is one more than the number of expanded rows before it, and a running sum adds an
    attribute over all expanded rows up to its peers. In B and the symbolic semirings they are over the
    support; annotations stay. ``running`` maps new names to numeric attributes.
    """
    by, order, running = list(by), _order(order), dict(running or {})
    frame._need([*by, *[a for a, _ in order], *running.values()])
    added = [n for n in (rank, dense) if n] + list(running)
    names = [*frame.attrs, *added]
    _check_names(names)
    if frame.semiring.symbolic or frame.semiring.weight is None:
        base, n = frame.support(), F.lit(1).cast("bigint")
    elif frame.semiring.name == "N":
        merged = frame.merge()
        base, n = merged.df, F.col(WEIGHT) if merged.weighted else F.lit(1).cast("bigint")
    else:
        raise ValueError(f"ranks are not defined for {frame.semiring.name}")
    columns = [(f"__o{i}", down) for i, (_, down) in enumerate(order)]
    at = [col_of(a).alias(c) for (a, _), (c, _) in zip(order, columns)]
    sums = [F.sum(col_of(a) * n).alias(f"__x{i}") for i, a in enumerate(running.values())]
    peers = base.select(_key(by).alias(BY), *at, n.alias("__n"), *[(col_of(a) * n).alias(f"__x{i}") for i, a in enumerate(running.values())])
    peers = peers.groupBy(BY, *[c for c, _ in columns]).agg(F.sum("__n").alias("__n"), *[F.sum(f"__x{i}").alias(f"__x{i}") for i in range(len(sums))])
    placed = in_ranges(peers, columns)
    measures = {"__rows": F.col("__n"), "__groups": F.lit(1).cast("bigint")} | {f"__run{i}": F.col(f"__x{i}") for i in range(len(sums))}
    found = before(placed, columns, measures)
    values = []
    if rank:
        values.append((F.coalesce(F.col("__rows"), F.lit(0)) + 1).cast("bigint").alias(rank))
    if dense:
        values.append((F.coalesce(F.col("__groups"), F.lit(0)) + 1).cast("bigint").alias(dense))
    for i, (name, attr) in enumerate(running.items()):
        kind = "bigint" if frame.df.schema[attr].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
        values.append(F.col(f"__run{i}_to").cast(kind).alias(name))
    own = found.select(F.struct(BY, *[c for c, _ in columns]).alias(AT), *values)
    here = F.struct(_key(by).alias(BY), *at)
    df = frame.df.join(own, here == F.col(AT))
    kept = [col_of(a) for a in names] + [F.col(c) for c in frame.annotation_columns]
    return replace(frame, df=df.select(*kept), attrs=tuple(names))


def top(frame: KFrame, k: int, by: Sequence[str], order) -> KFrame:
    """The first ``k`` rows of each ``by`` group; ties are broken by the remaining attributes.

    In N these are expanded rows: the last tuple taken may keep a part of its multiplicity only. In B and the symbolic
    semirings they are tuples, with their annotations. Spark keeps k tuples of a key in each task before it shuffles.
    """
    by, order = list(by), _order(order)
    frame._need([*by, *[a for a, _ in order]])
    if k < 1:
        raise ValueError("top needs at least one row")
    full = order + [(a, False) for a in frame.attrs if a not in [x for x, _ in order]]
    inside = Window.partitionBy(*([col_of(a) for a in by] or [F.lit(0)])).orderBy(*_sort([(col_of(a), down) for a, down in full]))
    scalar = not frame.semiring.symbolic
    if scalar and frame.semiring.weight is not None and frame.semiring.name != "N":
        raise ValueError(f"top is not defined for {frame.semiring.name}")
    if scalar and frame.semiring.weight is not None:
        merged = frame.merge()
        n = F.col(WEIGHT) if merged.weighted else merged.semiring.weight.lit_one()
        few = merged.df.select(*merged.key_columns, n.alias(WEIGHT)).withColumn("__place", F.row_number().over(inside)).where(F.col("__place") <= k)
        earlier = F.coalesce(F.sum(WEIGHT).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        few = few.withColumn("__before", earlier).where(F.col("__before") < k)
        own = F.least(F.col(WEIGHT), F.lit(k) - F.col("__before")).cast(COUNT_TYPE).alias(WEIGHT)
        return replace(merged, df=few.select(*merged.key_columns, own), weighted=True, merged=True)
    few = frame.support().withColumn("__place", F.row_number().over(inside)).where(F.col("__place") <= k).drop("__place")
    if scalar:
        return replace(frame, df=few, merged=True)
    chosen = few.select(tuple_key(frame.attrs).alias(AT))
    return replace(frame, df=frame.df.join(chosen, tuple_key(frame.attrs) == F.col(AT), "left_semi"))


def asof(left: KFrame, right: KFrame, on, left_time: str, right_time: str) -> KFrame:
    """Each left tuple with the right tuples of the latest time not after its own, among those with equal keys.

    Annotations are multiplied. Right tuples that share the latest time all match; left tuples without any are absent. NULL
    keys and times match nothing. Both sides' distinct (key, time) go through one ordered stream in ranges, in which the last
    right time is carried over the borders; the tuples themselves only take part in equi-joins.
    """
    left._need_same_semiring(right)
    pairs = left._pairs(right, on) if on else []
    left._need([left_time])
    right._need([right_time])
    kinds = [f.df.schema[t].dataType for f, t in ((left, left_time), (right, right_time))]
    if kinds[0] != kinds[1]:
        raise ValueError(f"the two times are of types {kinds[0].simpleString()} and {kinds[1].simpleString()}")
    mine, theirs = [a for a, _ in pairs], [b for _, b in pairs]
    known = lambda names: reduce(lambda a, b: a & b, [col_of(n).isNotNull() for n in names])
    types = [right.df.schema[b].dataType for b in theirs]
    key = F.struct(*[col_of(a).cast(t).alias(f"_{i}") for i, (a, t) in enumerate(zip(mine, types))]) if pairs else _key([])
    other_key = F.struct(*[col_of(b).alias(f"_{i}") for i, b in enumerate(theirs)]) if pairs else _key([])
    asking = left.df.where(known([*mine, left_time])).select(key.alias(BY), col_of(left_time).alias("__t")).distinct()
    given = right.support().where(known([*theirs, right_time])).select(other_key.alias(BY), col_of(right_time).alias("__t")).distinct()
    stream = given.withColumn("__asks", F.lit(0)).unionByName(asking.withColumn("__asks", F.lit(1)))
    placed = in_ranges(stream, [("__t", False), ("__asks", False)])
    found = before(placed, [("__t", False), ("__asks", False)], {"__last": F.when(F.col("__asks") == 0, F.col("__t"))}, F.max)
    matches = found.where((F.col("__asks") == 1) & F.col("__last").isNotNull()).select(F.struct(BY, "__t").alias(AT), F.struct(BY, F.col("__last").alias("__t")).alias("__match"))
    other, leaves = left._right_side(right)
    here = F.struct(key.alias(BY), col_of(left_time).alias("__t"))
    there = F.struct(other_key.alias(BY), col_of(right_time).alias("__t"))
    met = left.df.join(matches, here == F.col(AT)).join(other, there == F.col("__match"))
    return left._product(met.drop(AT, "__match"), right, leaves)
