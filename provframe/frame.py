"""KFrame: a DataFrame whose rows carry semiring annotations.

Every method builds a lazy DataFrame; nothing runs until an action. Rows are
kept un-merged for as long as the algebra allows: addition is postponed until
:meth:`KFrame.merge`, and bringing formulas into canonical form until
:meth:`KFrame.absorb`, so a pipeline of selections, joins and projections is the
same Catalyst plan as the plain query with a few more columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from enum import Enum
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.functions.witness import (
    NAMES,
    WEIGHT,
    Leaf,
    all_apart,
    leaf_column,
    names_array,
    quoted,
    spaces_apart,
    witness_size,
)
from provframe.semirings import Semiring

if TYPE_CHECKING:
    from provframe.operators.pairs import Pairs

RESERVED = "__"
MAX_SIZES = 64  # beyond this many possible clause sizes a plan counts as having several
MAX_SHAPES = 16  # beyond this many shapes of witnesses a plan counts as knowing none


class Dedup(Enum):
    """What deduplication keeps of a non-zero annotation."""

    EXISTENCE = "existence"
    HOW_PROVENANCE = "how_provenance"


def col_of(name: str) -> Column:
    return F.col(quoted(name))


def condition(cond: str | Column) -> Column:
    return F.expr(cond) if isinstance(cond, str) else cond


def tuple_key(attrs: Iterable[str]) -> Column:
    """The tuple as one struct: struct equality treats NULL fields as equal."""
    return F.struct(*[col_of(a).alias(f"_{i}") for i, a in enumerate(attrs)])


@dataclass(frozen=True)
class KFrame:
    """An annotated relation.

    ``merged``   rows are distinct on (attributes, witness)
    ``keyed``    rows are distinct on the witness leaves alone
    ``sizes``    sizes a clause may have, when known from the plan; one single
                 size means no clause can absorb another
    ``absorbed`` the frame holds canonical formulas
    ``antichain`` no witness of any row contains another one's, so whatever is projected, no
                 clause can absorb another
    ``shapes``   which leaves a row may have together, by place, when the plan knows and some are optional
    ``pairs``    the sides of the join behind ``df``, as long as only columns were dropped since
    """

    df: DataFrame
    attrs: tuple[str, ...]
    semiring: Semiring
    leaves: tuple[Leaf, ...] = ()
    has_names: bool = False
    weighted: bool = False
    merged: bool = False
    keyed: bool = False
    sizes: frozenset[int] | None = frozenset({0})
    absorbed: bool = False
    antichain: bool = False
    shapes: frozenset[frozenset[int]] | None = None
    pairs: Pairs | None = None

    # ---- shape -----------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return list(self.attrs)

    @property
    def witness_columns(self) -> list[str]:
        return [x.column for x in self.leaves] + ([NAMES] if self.has_names else [])

    @property
    def annotation_columns(self) -> list[str]:
        return self.witness_columns + ([WEIGHT] if self.weighted else [])

    @property
    def key_columns(self) -> list[Column]:
        return [col_of(a) for a in self.attrs]

    def _leaves_apart(self) -> bool:
        return not (self.has_names and self.leaves) and all_apart([x.space for x in self.leaves])

    @property
    def witness_shapes(self) -> frozenset[frozenset[int]] | None:
        """The sets of leaves, by place, that a row may have: the others are NULL. None if the plan doesn't know."""
        if self.has_names:
            return None
        return self.shapes if any(x.optional for x in self.leaves) else frozenset({frozenset(range(len(self.leaves)))})

    @property
    def is_merged(self) -> bool:
        if self.keyed and self._leaves_apart() and self.leaves:
            return True
        return self.merged

    def _need(self, names: Iterable[str]) -> None:
        missing = [n for n in names if n not in self.attrs]
        if missing:
            raise ValueError(f"unknown attribute(s) {missing}; available: {list(self.attrs)}")

    def _need_same_semiring(self, other: "KFrame") -> None:
        if not self.semiring.same_as(other.semiring):
            raise ValueError(
                f"relations over different semirings: {self.semiring.name} and {other.semiring.name}"
            )

    # ---- selection -------------------------------------------------------------

    def where(self, cond: str | Column | Callable, columns: Sequence[str] | None = None, vectorized: bool = False) -> "KFrame":
        """σ: keep the rows satisfying a SQL predicate string or a Column.

        For predicates SQL cannot say, ``cond`` may be a Python callable; Spark
        cannot push it into the scan. With ``vectorized`` it gets one pandas Series
        for each of ``columns`` and returns a Boolean Series; otherwise, as a last
        resort, a dict for each row. Only ``columns`` (default: all attributes) travel to Python.
        """
        if isinstance(cond, (str, Column)):
            return replace(self, df=self.df.where(condition(cond)))
        from provframe.functions.predicates import python_predicate

        self._need(columns or ())
        return replace(self, df=self.df.where(python_predicate(cond, columns or self.attrs, vectorized)))

    # ---- projection ------------------------------------------------------------

    def project(self, *items: str | Column) -> "KFrame":
        """π: keep attributes in the given order, or compute aliased columns.

        Tuples that collide are added up by the next :meth:`merge`.
        """
        flat = list(items[0]) if len(items) == 1 and isinstance(items[0], (list, tuple)) else list(items)
        if not flat:
            raise ValueError("a projection needs at least one attribute")
        self._need(i for i in flat if isinstance(i, str))
        cols = [col_of(i) if isinstance(i, str) else i for i in flat]
        names = self.df.select(*cols).columns
        _check_names(names)
        plain = all(isinstance(i, str) for i in flat)
        kept = {i for i in flat if isinstance(i, str)}
        df = self.df.select(*cols, *self.annotation_columns)
        known = plain and self.pairs is not None and self.pairs.df is self.df
        return replace(
            self,
            df=df,
            attrs=tuple(names),
            leaves=tuple(replace(x, named=tuple(a for a in x.named if a in kept)) for x in self.leaves),
            merged=self.merged and plain and set(names) == set(self.attrs),
            absorbed=self.absorbed and plain and set(names) == set(self.attrs),
            pairs=replace(self.pairs, df=df) if known else None,
        )

    def early(self, *attrs: str | Column) -> "KFrame":
        """π before a join, added up at once where that leaves one row per tuple.

        In scalar semirings the rows of one tuple become one, pre-aggregated where
        they are read, so a join key that holds a third of all rows joins as a single
        row. Symbolic semirings keep a row per witness and only lose the other attributes.
        Free where the join deals its rows by these attributes anyway; a shuffle of its own where the join would be a
        broadcast, or where tuples hardly repeat: use :meth:`project` there.
        """
        f = self.project(*attrs)
        return f if f.semiring.symbolic else f.merge()

    def rename(self, mapping: Mapping[str, str]) -> "KFrame":
        """ρ on attributes; annotations are untouched."""
        self._need(mapping)
        names = [mapping.get(a, a) for a in self.attrs]
        _check_names(names)
        cols = [col_of(a).alias(n) for a, n in zip(self.attrs, names)]
        leaves = tuple(replace(x, named=tuple(mapping.get(a, a) for a in x.named)) for x in self.leaves)
        return replace(self, df=self.df.select(*cols, *self.annotation_columns), attrs=tuple(names), leaves=leaves)

    def alias(self, name: str, sep: str = "_") -> "KFrame":
        """ρ on the relation: every attribute ``a`` becomes ``name_a``.

        Variables stay those of the underlying rows, so a self-join of two
        aliases multiplies each row's variable with itself.
        """
        return self.rename({a: f"{name}{sep}{a}" for a in self.attrs})

    # ---- products and joins ----------------------------------------------------

    def _right_side(self, other: "KFrame") -> tuple[DataFrame, list[Leaf]]:
        """The other frame with its annotation columns renamed out of the way."""
        self._need_same_semiring(other)
        clash = [a for a in other.attrs if a in self.attrs]
        if clash:
            raise ValueError(f"attribute(s) {clash} on both sides; alias one side first")
        k = len(self.leaves)
        leaves = [x.at(leaf_column(k + i)) for i, x in enumerate(other.leaves)]
        cols = list(other.key_columns)
        cols += [F.col(o.column).alias(n.column) for o, n in zip(other.leaves, leaves)]
        if other.has_names:
            cols.append(F.col(NAMES).alias(f"{NAMES}_r" if self.has_names else NAMES))
        if other.weighted:
            cols.append(F.col(WEIGHT).alias(f"{WEIGHT}_r" if self.weighted else WEIGHT))
        return other.df.select(*cols), leaves

    def _product(
        self, joined: DataFrame, other: "KFrame", right_leaves: list[Leaf]
    ) -> "KFrame":
        """Multiply annotations of the paired rows in ``joined``."""
        leaves = self.leaves + tuple(right_leaves)
        has_names = self.has_names or other.has_names
        weighted = self.weighted or other.weighted
        # Columns that only stand side by side are left where they are: a projection
        # between two joins would keep Catalyst from reordering them.
        computed: dict[str, Column] = {}
        if self.has_names and other.has_names:
            computed[NAMES] = F.concat(F.col(NAMES), F.col(f"{NAMES}_r"))
        if self.weighted and other.weighted:
            computed[WEIGHT] = self.semiring.weight.times(F.col(WEIGHT), F.col(f"{WEIGHT}_r"))
        if computed:
            kept = [col_of(a) for a in self.attrs + other.attrs] + [F.col(x.column) for x in leaves]
            if has_names:
                kept.append(computed.get(NAMES, F.col(NAMES)).alias(NAMES))
            if weighted:
                kept.append(computed.get(WEIGHT, F.col(WEIGHT)).alias(WEIGHT))
            joined = joined.select(*kept)
        if WEIGHT in computed and not self.semiring.weight.zero_divisor_free:
            joined = joined.where(~self.semiring.weight.is_zero(F.col(WEIGHT)))
        apart = not (self.witness_columns and other.witness_columns) or (
            not (self.has_names or other.has_names)
            and all(spaces_apart(a.space, b.space) for a in self.leaves for b in other.leaves)
        )
        sizes = _product_sizes(self.sizes, other.sizes, apart)
        shapes = None
        if self.witness_shapes is not None and other.witness_shapes is not None:
            shapes = _few(frozenset(a | {len(self.leaves) + k for k in b} for a in self.witness_shapes for b in other.witness_shapes))
        return KFrame(
            joined,
            self.attrs + other.attrs,
            self.semiring,
            leaves,
            has_names,
            weighted,
            merged=self.is_merged and other.is_merged and (apart or not self.semiring.symbolic),
            keyed=self.keyed and other.keyed,
            sizes=sizes,
            shapes=shapes,
        )

    def cross(self, other: "KFrame") -> "KFrame":
        """×: all pairs, annotations multiplied.

        A following ``where`` that equates attributes of both sides turns this
        into an equi-join; Catalyst reorders a chain of products accordingly.
        """
        right, leaves = self._right_side(other)
        return self._product(self.df.join(right), other, leaves)

    def join(
        self,
        other: "KFrame",
        on=None,
        where: str | Column | None = None,
        between: tuple | None = None,
        overlaps: tuple | None = None,
        above: tuple | None = None,
    ) -> "KFrame":
        """⨝: σ over ×. ``on`` is a predicate, or pairs ``[(left, right), ...]``.

        ``between=(value, low, high)`` joins where an expression of this side lies between two of the
        other, ``overlaps=((low, high), (low, high))`` where a closed interval of this side has a value in common
        with one of the other; see :mod:`provframe.operators.intervals`. A fourth member of ``between`` is
        a fixed bin width, good where all intervals are about that long; it does not change the result. ``above=(x, y)`` asks
        beside ``between`` that x of this side is greater than y of the other. Where x and y are numbers and the others whole numbers,
        pairs are then counted in order instead of made, if B or N is all that is asked for; see :mod:`provframe.operators.pairs`.
        """
        if above is not None and (between is None or len(between) == 4):
            raise ValueError("above goes with between=(value, low, high)")
        if between is not None and len(between) == 4:
            return self._join_between(other, on, where, *between)
        if between is not None or overlaps is not None:
            from provframe.operators.intervals import between_join, overlap_join

            extra = None if on is None and where is None else self._join_condition(other, on, where)
            if overlaps is not None:
                return overlap_join(self, other, extra, *overlaps, dealt=on is None)
            return between_join(self, other, extra, *between, dealt=on is None, above=above)
        right, leaves = self._right_side(other)
        cond = self._join_condition(other, on, where)
        return self._product(self.df.join(right, cond, "inner"), other, leaves)

    def _join_between(self, other: "KFrame", on, where, value, low, high, width) -> "KFrame":
        right, leaves = self._right_side(other)
        bin_of = lambda x: F.floor(x.cast("double") / F.lit(float(width))).cast("bigint")
        value, low, high = (condition(x) for x in (value, low, high))
        bins = F.when(low <= high, F.sequence(bin_of(low), bin_of(high)))
        binned = right.withColumn("__bin", F.explode(bins))
        cond = (F.col("__own_bin") == F.col("__bin")) & value.between(low, high)
        if on is not None or where is not None:
            cond = cond & self._join_condition(other, on, where)
        joined = self.df.withColumn("__own_bin", bin_of(value)).join(binned, cond).drop("__bin", "__own_bin")
        return self._product(joined, other, leaves)

    def _pairs(self, other: "KFrame", on) -> list[tuple[str, str]]:
        if isinstance(on, Mapping):
            on = list(on.items())
        elif isinstance(on, tuple) and len(on) == 2 and all(isinstance(x, str) for x in on):
            on = [on]
        pairs = [tuple(p) for p in (on or [])]
        self._need(a for a, _ in pairs)
        other._need(b for _, b in pairs)
        return pairs

    def _join_condition(self, other: "KFrame", on, where=None) -> Column:
        terms: list[Column] = []
        if isinstance(on, (str, Column)):
            terms.append(condition(on))
        else:
            terms += [col_of(a) == col_of(b) for a, b in self._pairs(other, on)]
        if where is not None:
            terms.append(condition(where))
        if not terms:
            raise ValueError("a join needs a condition; use cross() for all pairs")
        out = terms[0]
        for t in terms[1:]:
            out = out & t
        return out

    # ---- multiset sum ----------------------------------------------------------

    def msum(self, other: "KFrame") -> "KFrame":
        """⊎: annotations of equal tuples are added. Columns must agree in name and order."""
        self._need_same_semiring(other)
        if self.attrs != other.attrs:
            raise ValueError(f"schemas differ: {list(self.attrs)} and {list(other.attrs)}")
        left, right = _align(self, other)
        sizes = None if left.sizes is None or right.sizes is None else left.sizes | right.sizes
        known = left.shapes is not None and right.shapes is not None
        # Witnesses of different shapes differ, so what is distinct on either side stays so.
        differ = self.semiring.symbolic and known and left._leaves_apart() and not left.shapes & right.shapes
        return replace(
            left,
            df=left.df.unionByName(right.df),
            merged=differ and self.is_merged and other.is_merged,
            keyed=differ and self.keyed and other.keyed,
            sizes=sizes,
            absorbed=False,
            antichain=False,
            shapes=_few(left.shapes | right.shapes) if known else None,
        )

    union_all = msum

    def union(self, other: "KFrame", strategy: Dedup = Dedup.EXISTENCE) -> "KFrame":
        """SQL UNION: δ over ⊎."""
        return self.msum(other).dedup(strategy)

    # ---- merge, absorb, dedup --------------------------------------------------

    def merge(self) -> "KFrame":
        """Add up the annotations of equal tuples.

        One shuffle with map-side pre-aggregation. Witness columns are part of
        the grouping key, so a tuple with very many witnesses is spread over all
        reducers.
        """
        f = self.canonical()
        if f.is_merged:
            return replace(f, merged=True)
        if f.pairs is not None:
            from provframe.operators.pairs import merged

            found = merged(f)
            if found is not None:
                return found
        keys = f.key_columns + [F.col(c) for c in f.witness_columns]
        weight = f.semiring.weight
        if weight is None:
            return replace(f, df=f.df.select(*keys).distinct(), merged=True)
        total = weight.total(F.col(WEIGHT) if f.weighted else None).alias(WEIGHT)
        if weight.staged:
            part = f.df.select(*keys, *([F.col(WEIGHT)] if f.weighted else []), F.spark_partition_id().alias("__task")).groupBy(*keys, "__task").agg(total)
            df = part.groupBy(*keys).agg(weight.plus(F.col(WEIGHT)).alias(WEIGHT))
        else:
            df = f.df.groupBy(*keys).agg(total)
        if not weight.zero_sum_free:
            df = df.where(~weight.is_zero(F.col(WEIGHT)))
        return replace(f, df=df, weighted=True, merged=True)

    def canonical(self) -> "KFrame":
        """Give equal witnesses equal columns."""
        if not self.semiring.symbolic:
            return self
        if self._leaves_apart():
            return self if not self.has_names else self.as_names()
        kinds = {x.kind for x in self.leaves}
        if self.has_names or not all_apart([space for space, _ in kinds]):
            return self.as_names()
        changed: dict[str, Column] = {}
        for kind in kinds:
            same = [x.column for x in self.leaves if x.kind == kind]
            if len(same) > 1:
                used = F.array_compact(F.array(*[F.col(c) for c in same]))
                if not self.semiring.keeps_exponents:
                    used = F.array_distinct(used)
                used = F.sort_array(used)
                for i, c in enumerate(same):
                    changed[c] = F.get(used, F.lit(i)).alias(c)
        if not changed or self.merged:
            return self
        cols = self.key_columns + [
            changed.get(c, F.col(c)) for c in self.annotation_columns
        ]
        leaves = tuple(replace(x, optional=True, named=()) if x.column in changed else x for x in self.leaves)
        return replace(self, df=self.df.select(*cols), leaves=leaves, shapes=None)

    def as_names(self) -> "KFrame":
        """Turn every witness into one sorted array of variable names."""
        if self.has_names and not self.leaves and self.merged:
            return self
        names = names_array(self.leaves, self.has_names, not self.semiring.keeps_exponents)
        cols = self.key_columns + [names.alias(NAMES)] + ([F.col(WEIGHT)] if self.weighted else [])
        return replace(
            self, df=self.df.select(*cols), leaves=(), has_names=True, keyed=False, merged=self.is_merged
        )

    def absorb(self) -> "KFrame":
        """Canonical form: merged, and in B[X] no clause contains another of its tuple."""
        from provframe.operators.absorb import absorb

        return absorb(self)

    def dedup(self, strategy: Dedup = Dedup.EXISTENCE) -> "KFrame":
        """δ: reduce every non-zero annotation to one, or keep it."""
        if strategy is Dedup.HOW_PROVENANCE:
            return self
        weight = self.semiring.weight
        if weight is not None and not weight.zero_sum_free and not self.is_merged:
            return self.merge().dedup(strategy)  # a tuple whose annotations add up to zero is absent
        df = self.df.select(*self.key_columns)
        if self.semiring.symbolic or not self.is_merged:
            df = df.distinct()
        return KFrame(df, self.attrs, self.semiring, merged=True, absorbed=True)

    # ---- results ---------------------------------------------------------------

    def support(self) -> DataFrame:
        """The distinct tuples."""
        return self.dedup(Dedup.EXISTENCE).df

    def support_size(self) -> int:
        return self.support().count()

    def lookup(self, **row) -> "KFrame":
        """The part of the relation holding one tuple; no rows means annotation zero."""
        missing = [a for a in self.attrs if a not in row]
        if missing:
            raise ValueError(f"lookup needs a value for {missing}")
        self._need(row)
        cond = F.lit(True)
        for a in self.attrs:
            cond = cond & (col_of(a).isNull() if row[a] is None else (col_of(a) == F.lit(row[a])))
        return replace(self, df=self.df.where(cond))

    def result(self, name: str = "n") -> DataFrame:
        """Tuples with their scalar annotation (B: the tuples alone)."""
        if self.semiring.symbolic:
            raise ValueError("symbolic annotations are rendered with text(), packed() or stats()")
        m = self.merge()
        if m.semiring.weight is None:
            return m.df
        check_results(self.attrs, name)
        weight = F.col(WEIGHT) if m.weighted else m.semiring.weight.lit_one()
        return m.df.select(*m.key_columns, weight.alias(name))

    def terms(self, name: str = "term") -> DataFrame:
        from provframe.functions.render import terms

        return terms(self, name)

    def text(self, max_terms: int | None = None, name: str = "annotation", part: str = "part", spread: bool = False) -> DataFrame:
        from provframe.functions.render import text

        return text(self, max_terms, name, part, spread)

    def numbered(self, name: str = "term", number: str = "number") -> DataFrame:
        from provframe.functions.render import numbered

        return numbered(self, name, number)

    def packed(self, max_terms: int | None = None, name: str = "annotation", part: str = "part") -> DataFrame:
        from provframe.functions.render import packed

        return packed(self, max_terms, name, part)

    def annotation_of(self, **row) -> DataFrame:
        """Packed annotation of one tuple; an empty result means zero."""
        return self.lookup(**row).packed()

    def stats(self, digest: bool = False) -> DataFrame:
        from provframe.functions.render import stats

        return stats(self, digest)

    def total_stats(self) -> DataFrame:
        from provframe.functions.render import total_stats

        return total_stats(self)

    def differences(self, other: "KFrame") -> DataFrame:
        from provframe.functions.render import differences

        return differences(self, other)

    def equals(self, other: "KFrame") -> bool:
        """Whether both relations give every tuple the same annotation."""
        return self.differences(other).isEmpty()

    def variables(self, name: str = "variable") -> DataFrame:
        from provframe.functions.render import variables

        return variables(self, name)

    def one_witness(self) -> "KFrame":
        from provframe.functions.render import one_witness

        return one_witness(self)

    # ---- further operators -----------------------------------------------------

    def anti(self, other: "KFrame", on=None, where=None, between=None) -> "KFrame":
        from provframe.operators.extra import anti

        return anti(self, other, on, where, between)

    def left_outer(self, other: "KFrame", on=None, where=None, between=None) -> "KFrame":
        from provframe.operators.extra import left_outer

        return left_outer(self, other, on, where, between)

    def intersect(self, other: "KFrame") -> "KFrame":
        from provframe.operators.extra import intersect

        return intersect(self, other)

    def minus(self, other: "KFrame") -> "KFrame":
        from provframe.operators.extra import minus

        return minus(self, other)

    def divide(self, other: "KFrame") -> "KFrame":
        from provframe.operators.extra import divide

        return divide(self, other)

    def group(self, by: Sequence[str], **aggregates: tuple[str, str]) -> "KFrame":
        from provframe.operators.extra import group

        return group(self, by, aggregates)

    def aggregate(self, by: Sequence[str], **aggregates: tuple[str, str]):
        """ɣ with values that follow the provenance: an :class:`provframe.operators.valuation.Aggregated`."""
        from provframe.operators.valuation import Aggregated

        return Aggregated(self, tuple(by), aggregates)

    def ranked(self, by: Sequence[str], order, rank: str | None = "rank", dense: str | None = None, running: Mapping[str, str] | None = None) -> "KFrame":
        from provframe.operators.ordering import ranked

        return ranked(self, by, order, rank, dense, running)

    def top(self, k: int, by: Sequence[str], order) -> "KFrame":
        from provframe.operators.ordering import top

        return top(self, k, by, order)

    def asof(self, other: "KFrame", on, left_time: str, right_time: str) -> "KFrame":
        from provframe.operators.ordering import asof

        return asof(self, other, on, left_time, right_time)

    def semi(self, other: "KFrame", on, strategy: Dedup = Dedup.EXISTENCE) -> "KFrame":
        from provframe.operators.extra import semi

        return semi(self, other, on, strategy)

    def not_in(self, attr: str, other: "KFrame", other_attr: str) -> "KFrame":
        from provframe.operators.extra import not_in

        return not_in(self, attr, other, other_attr)

    def grouping_sets(self, sets: Sequence[Sequence[str]], name: str = "grouping") -> "KFrame":
        from provframe.operators.extra import grouping_sets

        return grouping_sets(self, sets, name)

    def circuit(self):
        """The relation with factored annotations: a :class:`provframe.operators.circuit.Circuit`."""
        from provframe.operators.circuit import source

        return source(self)

    def without(self, deleted) -> "KFrame":
        from provframe.operators.valuation import without

        return without(self, deleted)

    def specialise(self, target: Semiring, values=None) -> "KFrame":
        from provframe.operators.valuation import specialise

        return specialise(self, target, values)


def check_results(attrs: Sequence[str], *names: str) -> None:
    """Refuse result columns that are called like an attribute."""
    clash = {a.lower() for a in attrs} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"result column(s) {sorted(clash)} are attributes too; rename them or choose another result name")


def _check_names(names: Sequence[str]) -> None:
    lowered = [n.lower() for n in names]
    if len(set(lowered)) != len(lowered):
        raise ValueError(f"duplicate attribute names in {list(names)}")
    bad = [n for n in names if n.startswith(RESERVED)]
    if bad:
        raise ValueError(f"attribute names starting with {RESERVED!r} are reserved: {bad}")


def _product_sizes(a, b, apart: bool) -> frozenset[int] | None:
    if a is None or b is None:
        return None
    if apart:
        out = {x + y for x in a for y in b}
    else:
        out = {s for x in a for y in b for s in range(max(x, y), x + y + 1)}
    return frozenset(out) if len(out) <= MAX_SIZES else None


def _few(shapes: frozenset[frozenset[int]]) -> frozenset[frozenset[int]] | None:
    return shapes if len(shapes) <= MAX_SHAPES else None


def _align(left: KFrame, right: KFrame) -> tuple[KFrame, KFrame]:
    """Give both sides of ⊎ the same annotation columns."""
    if left.semiring.symbolic:
        slots: list[Leaf] = []
        places: list[dict[int, int]] = []  # slot -> own leaf index, per side
        for side in (left, right):
            taken: dict[int, int] = {}
            for i, leaf in enumerate(side.leaves):
                free = [s for s, x in enumerate(slots) if x.kind == leaf.kind and s not in taken]
                if not free:
                    slots.append(leaf)
                    free = [len(slots) - 1]
                taken[free[0]] = i
            places.append(taken)
        target = tuple(
            replace(
                x,
                column=leaf_column(s),
                named=(),
                optional=any(
                    s not in taken or side.leaves[taken[s]].optional
                    for side, taken in zip((left, right), places)
                ),
            )
            for s, x in enumerate(slots)
        )
        has_names = left.has_names or right.has_names
    else:
        target, places, has_names = (), [{}, {}], False
    weighted = left.weighted or right.weighted
    out = []
    for side, taken in zip((left, right), places):
        cols = list(side.key_columns)
        for s, leaf in enumerate(target):
            own = F.col(side.leaves[taken[s]].column) if s in taken else F.lit(None).cast(leaf.ids)
            cols.append(own.alias(leaf.column))
        if has_names:
            own = F.col(NAMES) if side.has_names else F.array().cast("array<string>")
            cols.append(own.alias(NAMES))
        if weighted:
            own = F.col(WEIGHT) if side.weighted else side.semiring.weight.lit_one()
            cols.append(own.alias(WEIGHT))
        own = side.witness_shapes
        shapes = None if own is None or has_names else frozenset(frozenset(s for s, i in taken.items() if i in shape) for shape in own)
        out.append(
            replace(side, df=side.df.select(*cols), leaves=target, has_names=has_names, weighted=weighted, shapes=shapes)
        )
    return out[0], out[1]


def clause_size(frame: KFrame) -> Column:
    return witness_size(frame.leaves, frame.has_names)
