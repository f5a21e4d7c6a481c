"""Anti and outer join, intersection, difference, division, grouping.

Each is defined over every semiring where it has a meaning; difference and
division need negation or counting over a set, so symbolic annotations refuse
them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provframe.frame import Dedup, KFrame, _check_names, col_of, condition, tuple_key
from provframe.functions.witness import WEIGHT, spaces_apart


def _weight(f: KFrame) -> Column:
    return F.col(WEIGHT) if f.weighted else f.semiring.weight.lit_one()


def _is_pairs(on) -> bool:
    return on is not None and not isinstance(on, (str, Column))


def _of_right_alone(right: KFrame, where) -> bool:
    """Whether a condition needs no column of the left side."""
    try:
        right.df.select(*right.key_columns).where(condition(where))
    except AnalysisException:
        return False
    return True


def anti(left: KFrame, right: KFrame, on=None, where=None, between=None) -> KFrame:
    """⊳: tuples of ``left`` without a match in the support of ``right``.

    With key pairs, the right side is reduced to its distinct keys; a condition
    on the right side alone is applied before that. A condition on both sides stays in
    the anti join, which ends at a row's first match and never makes pairs. Other predicates
    have no key to deal rows by: their matches are found by a join and removed by key. Tuples of ``right``
    whose annotations add up to zero are not in its support.
    """
    left._need_same_semiring(right)
    weight = right.semiring.weight
    if weight is not None and not weight.zero_sum_free:
        right = right.merge()
    clash = set(left.attrs) & set(right.attrs)
    if clash:
        raise ValueError(f"attribute(s) {sorted(clash)} on both sides; alias one side first")
    if _is_pairs(on) and between is None:
        pairs = left._pairs(right, on)
        equal = left._join_condition(right, on)
        if where is not None and not _of_right_alone(right, where):
            others = right.df.select(*right.key_columns).distinct()
            return replace(left, df=left.df.join(others, equal & condition(where), "left_anti"))
        rows = right.df if where is None else right.df.where(condition(where))
        keys = rows.select(*[col_of(b) for _, b in pairs]).distinct()
        return replace(left, df=left.df.join(keys, equal, "left_anti"))
    plain = replace(left, df=left.df.select(*left.key_columns), leaves=(), has_names=False, weighted=False)
    other = replace(right, df=right.df.select(*right.key_columns), leaves=(), has_names=False, weighted=False)
    matched = plain.join(other, on, where, between).df.select(tuple_key(left.attrs).alias("__mk")).distinct()
    df = left.df.join(matched, tuple_key(left.attrs) == F.col("__mk"), "left_anti")
    return replace(left, df=df)


def left_outer(left: KFrame, right: KFrame, on=None, where=None, between=None) -> KFrame:
    """⟕: inner join ∪ anti join padded with NULL.

    Spark's own outer join cannot split a hot key of the optional side; the
    inner join can, and the anti join meets each key once.

    No absorption is needed where a left row's witness decides whether it has a match, as it has the row's join key or belongs to
    one row alone, and shares no variables with the right: a clause of the padded half is a witness without a match, one of the
    inner half holds a witness with a match, and neither is inside the other.
    """
    inner = left.join(right, on, where, between)
    types = {f.name: f.dataType for f in right.df.schema.fields}
    padding = [F.lit(None).cast(types[a]).alias(a) for a in right.attrs]
    both = inner.msum(anti(left, right, on, where, between).project(*left.attrs, *padding))
    single = all(f.sizes is not None and len(f.sizes) == 1 for f in (left, right))
    apart = not (left.has_names or right.has_names) and all(spaces_apart(a.space, b.space) for a in left.leaves for b in right.leaves)
    named = {a for x in left.leaves for a in x.named}
    by_key = between is None and _is_pairs(on) and named.issuperset(a for a, _ in left._pairs(right, on))
    decides = left.keyed or by_key and (where is None or _of_right_alone(right, where))
    return replace(both, antichain=decides and bool(left.leaves) and left._leaves_apart() and single and apart)


def semi(left: KFrame, right: KFrame, on, strategy=Dedup.EXISTENCE) -> KFrame:
    """⋉, a correlated EXISTS or an IN: left tuples with a match, times δ of the matches.

    EXISTENCE leaves the left annotation as it is; HOW_PROVENANCE multiplies it by the sum of the matching tuples'
    annotations, so it says why the match is there. The right side is reduced to its keys first, added up in scalar semirings.
    """
    left._need_same_semiring(right)
    pairs = left._pairs(right, on)
    if strategy is Dedup.HOW_PROVENANCE:
        keys = right.early(*dict.fromkeys(b for _, b in pairs))
        return left.join(keys, pairs).project(*left.attrs)
    names = list(dict.fromkeys(b for _, b in pairs))
    keys = right.project(*names).support().select(*[col_of(b).alias(f"__s{i}") for i, b in enumerate(names)])
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & (col_of(a) == F.col(f"__s{names.index(b)}"))
    return replace(left, df=left.df.join(keys, cond, "left_semi"))


def not_in(left: KFrame, attr: str, right: KFrame, other: str) -> KFrame:
    """NOT IN with SQL's NULLs: nothing passes if the right side holds a NULL, and a NULL passes only an empty right side.

    Annotations are those of the left side. The two facts about the right side are one row.
    """
    left._need_same_semiring(right)
    left._need([attr])
    right._need([other])
    keys = right.project(other).support().select(col_of(other).alias("__s"))
    facts = keys.agg(F.count(F.lit(1)).alias("__rows"), F.count("__s").alias("__known"))
    passing = (F.col("__rows") == 0) | ((F.col("__rows") == F.col("__known")) & col_of(attr).isNotNull())
    df = left.df.join(keys, col_of(attr) == F.col("__s"), "left_anti").crossJoin(F.broadcast(facts)).where(passing)  # one row
    return replace(left, df=df.drop("__rows", "__known"))


def grouping_sets(frame: KFrame, sets: Sequence[Sequence[str]], name: str = "grouping") -> KFrame:
    """π onto several attribute lists at once: left-out attributes are NULL, and ``name`` is SQL's GROUPING_ID over all of them.

    Scalar semirings add up the finest tuples first, so the input moves once and its copies are made of
    partial sums; symbolic ones copy each witness without the attributes left out.
    """
    attrs = list(dict.fromkeys(a for s in sets for a in s))
    if not sets or not attrs:
        raise ValueError("grouping sets need an attribute")
    frame._need(attrs)
    _check_names([*attrs, name])
    f = frame.early(*attrs)
    types = {x.name: x.dataType for x in f.df.schema.fields}
    rows = []
    for own in sets:
        values = [(col_of(a) if a in own else F.lit(None).cast(types[a])).alias(a) for a in attrs]
        number = sum(1 << (len(attrs) - 1 - i) for i, a in enumerate(attrs) if a not in own)
        rows.append(F.struct(*values, F.lit(number).cast("bigint").alias(name)))
    copies = f.df.select(F.explode(F.array(*rows)).alias("__row"), *f.annotation_columns)
    df = copies.select(*[F.col("__row")[a].alias(a) for a in [*attrs, name]], *f.annotation_columns)
    return replace(f, df=df, attrs=(*attrs, name), merged=False, keyed=False, absorbed=False)


def _need_same_schema(left: KFrame, right: KFrame) -> None:
    left._need_same_semiring(right)
    if left.attrs != right.attrs:
        raise ValueError(f"schemas differ: {list(left.attrs)} and {list(right.attrs)}")


def _side_by_side(left: KFrame, right: KFrame) -> DataFrame:
    """Each tuple once, with its total on either side as ``__l`` and ``__r`` (B: 0 or 1).

    One pre-aggregated grouping over both sides rather than a join, so a tuple
    with very many copies costs no more than any other.
    """
    weight = left.semiring.weight
    zero = F.lit(0) if weight is None else weight.lit_zero()

    def side(f: KFrame, own: str, other: str) -> DataFrame:
        value = F.lit(1) if weight is None else _weight(f)
        return f.df.select(*f.key_columns, value.alias(own), zero.alias(other))

    plus = F.max if weight is None else weight.plus
    return (
        side(left, "__l", "__r")
        .unionByName(side(right, "__r", "__l"))
        .groupBy(*left.key_columns)
        .agg(plus(F.col("__l")).alias("__l"), plus(F.col("__r")).alias("__r"))
    )


def intersect(left: KFrame, right: KFrame) -> KFrame:
    """∩: tuples of both sides, annotations multiplied. NULLs match each other."""
    _need_same_schema(left, right)
    weight = left.semiring.weight
    if not left.semiring.symbolic and (weight is None or left.semiring.name == "N"):
        both = _side_by_side(left, right).where((F.col("__l") > 0) & (F.col("__r") > 0))
        cols = list(left.key_columns)
        if weight is not None:
            cols.append(weight.times(F.col("__l"), F.col("__r")).alias(WEIGHT))
        return replace(left, df=both.select(*cols), weighted=weight is not None, merged=True)
    # merge first: the product then pairs each tuple's total (or distinct witnesses) once
    lhs, rhs = left.merge(), right.merge()
    rhs = rhs.rename({a: f"rhs {a}" for a in rhs.attrs})
    both = lhs.join(rhs, tuple_key(lhs.attrs) == tuple_key(rhs.attrs))
    return both.project(*left.attrs)


def minus(left: KFrame, right: KFrame) -> KFrame:
    """−: set difference in B, truncated subtraction of multiplicities in N."""
    _need_same_schema(left, right)
    if left.semiring.name not in ("B", "N"):
        raise ValueError(f"difference has no meaning in {left.semiring.name}")
    sides = _side_by_side(left, right)
    weight = left.semiring.weight
    if weight is None:
        df = sides.where((F.col("__l") > 0) & (F.col("__r") == 0)).select(*left.key_columns)
        return replace(left, df=df, merged=True)
    rest = (F.col("__l") - F.col("__r")).cast(weight.dtype).alias(WEIGHT)
    df = sides.where(F.col("__l") > F.col("__r")).select(*left.key_columns, rest)
    return replace(left, df=df, weighted=True, merged=True)


def divide(left: KFrame, right: KFrame) -> KFrame:
    """÷ in B: the quotient tuples that occur with every tuple of ``right``."""
    left._need_same_semiring(right)
    if left.semiring.symbolic or left.semiring.weight is not None:
        raise ValueError(f"division is only defined in B, not in {left.semiring.name}")
    left._need(right.attrs)
    quotient = [a for a in left.attrs if a not in right.attrs]
    if not quotient:
        raise ValueError("division needs an attribute that the divisor does not have")
    pairs = left.df.select(*left.key_columns).distinct()
    divisor = right.df.select(tuple_key(right.attrs).alias("__dk")).distinct()
    needed = divisor.agg(F.count(F.lit(1)).alias("__needed"))  # always a single row
    hits = pairs.join(divisor, tuple_key(right.attrs) == F.col("__dk"), "left")
    df = (
        hits.groupBy(*[col_of(a) for a in quotient])
        .agg(F.count("__dk").alias("__hits"))
        .join(F.broadcast(needed), F.col("__hits") == F.col("__needed"), "inner")
        .select(*[col_of(a) for a in quotient])
    )
    return KFrame(df, tuple(quotient), left.semiring, merged=True)


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def check_aggregates(frame: KFrame, aggregates: Mapping[str, tuple[str, str]]) -> None:
    if not aggregates:
        raise ValueError("grouping needs at least one aggregate")
    for fn, attr in aggregates.values():
        if fn.upper() not in AGGREGATES:
            raise ValueError(f"unknown aggregate {fn}; use one of {AGGREGATES}")
        if attr != "*":
            frame._need([attr])
        elif fn.upper() != "COUNT":
            raise ValueError(f"{fn}(*) has no meaning")


def group(frame: KFrame, by: Sequence[str], aggregates: Mapping[str, tuple[str, str]]) -> KFrame:
    """ɣ: ``group(["a"], total=("SUM", "x"), rows=("COUNT", "*"))``.

    N aggregates with multiplicities, B over distinct tuples; both give each
    group the annotation one. Symbolic semirings take the values over the
    support and annotate the group as projection onto ``by`` does; where the values are to follow
    the provenance, use :meth:`KFrame.aggregate`.
    """
    by = list(by)
    frame._need(by)
    check_aggregates(frame, aggregates)
    names = by + list(aggregates)
    _check_names(names)
    keys = [col_of(a) for a in by]
    if frame.semiring.name == "N":
        df = frame.df.groupBy(*keys).agg(*_aggregate_columns(frame, aggregates))
        return KFrame(df, tuple(names), frame.semiring, merged=True)
    if not frame.semiring.symbolic and frame.semiring.weight is not None:
        raise ValueError(f"grouping is not defined for {frame.semiring.name}")
    values = frame.support().groupBy(*keys).agg(*_aggregate_columns(replace(frame, weighted=False), aggregates))
    if not frame.semiring.symbolic:
        return KFrame(values, tuple(names), frame.semiring, merged=True)
    if not by:
        raise ValueError("grouping a symbolic relation needs a grouping attribute")
    witnesses = frame.project(*by).merge()
    outs = values.select(tuple_key(by).alias("__gk"), *[col_of(n) for n in aggregates])
    joined = witnesses.df.join(outs, tuple_key(by) == F.col("__gk"), "inner")
    df = joined.select(*[col_of(n) for n in names], *witnesses.annotation_columns)
    return replace(witnesses, df=df, attrs=tuple(names))


def _aggregate_columns(frame: KFrame, aggregates: Mapping[str, tuple[str, str]]) -> list[Column]:
    """COUNT is a bigint, SUM has the type Spark's sum of the attribute has, AVG is a double.

    The types don't depend on whether equal rows were added up before; AVG divides the exact sum.
    """
    out = []
    n = F.col(WEIGHT) if frame.weighted else None
    for name, (fn, attr) in aggregates.items():
        fn = fn.upper()
        x = F.lit(1) if attr == "*" else col_of(attr)
        if fn in ("MIN", "MAX"):
            out.append((F.min(x) if fn == "MIN" else F.max(x)).alias(name))
            continue
        count = F.count(x) if n is None else F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0)).cast("bigint")
        if fn == "COUNT":
            out.append(count.alias(name))
            continue
        dtype = frame.df.schema[attr].dataType
        if isinstance(dtype, T.DecimalType):
            kind = f"decimal({min(38, dtype.precision + 10)},{dtype.scale})"
        else:
            kind = "bigint" if isinstance(dtype, T.IntegralType) else "double"
        total = F.sum(x) if n is None else F.sum(x * n)
        if fn == "SUM":
            out.append(total.cast(kind).alias(name))
        else:
            out.append(F.when(count > 0, total.cast("double") / count.cast("double")).alias(name))
    return out
