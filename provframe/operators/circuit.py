"""Factored annotations: formulas and polynomials as circuits.

In the row form a product of two formulas has a row for each pair of their terms. A circuit keeps it as one gate with two
inputs: every tuple has a node, every operator makes gates from the nodes of its input, and nothing is multiplied out. A projection
adds one edge for each input row, a join one gate for each joined row, whatever their formulas are. Difference and anti
join are gates too, so they have a meaning for symbolic annotations as well: a tuple is there under the deletions for
which its left node is and its right one is not.

Questions about annotations are evaluations: existence, multiplicity, number and degree of derivations, cheapest derivation. They go
through the operators from the sources up, in work linear in the number of edges. A node's value travels in the rows that name the
node: a sum gate stands for a tuple and adds up the values of the tuple's rows, a product gate stands for two rows that meet and
multiplies theirs. So edges and values are never shuffled to find each other. Node names are 128-bit hashes of what the node stands for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.frame import KFrame, _check_names, col_of, condition, tuple_key
from provframe.functions.witness import WEIGHT, Leaf, variable_name
from provframe.operators.valuation import Sources, _ids_of
from provframe.semirings import COUNT_TYPE, Semiring

NODE, PARENT, LEFT, RIGHT, VALUE = "__node", "__parent", "__left", "__right", "__value"
_numbers = count()


def _hash(*columns: Column) -> Column:
    """128 bits of some values; NULLs are told from what is left out."""
    marks = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns])
    return F.struct(F.xxhash64(marks, *columns).alias("a"), F.xxhash64(F.lit("second"), *columns, marks).alias("b"))


@dataclass(frozen=True)
class Algebra:
    """How gates compute: an aggregate that adds, a product, what one is, the rows of a source with their values (from rows with their
    leaf), and which values are zero; and whether a difference has a value."""

    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    one: Column
    given: Callable[[DataFrame, Leaf], DataFrame]
    differences: bool = False
    nonzero: Callable[[Column], Column] | None = None

    def there(self, rows: DataFrame) -> DataFrame:
        return rows if self.nonzero is None else rows.where(self.nonzero(F.col(VALUE)))

    def added(self, rows: DataFrame, attrs: Sequence[str]) -> DataFrame:
        return self.there(rows.groupBy(*[col_of(a) for a in attrs]).agg(self.plus(F.col(VALUE)).alias(VALUE)))


#: The rows (attrs, VALUE) of an operator from those of its inputs; the rows of a source are given by itself.
Make = Callable[[Algebra, list[DataFrame]], DataFrame]


class Circuit:
    """An annotated relation whose rows (attrs, NODE) name nodes; each tuple may still have several rows, which add up."""

    def __init__(self, rows: DataFrame, attrs: tuple[str, ...], kind: str, edges: DataFrame | None, inputs: tuple["Circuit", ...], make: Make, leaf: Leaf | None = None):
        self.rows, self.attrs, self.kind, self.edges, self.inputs, self.make, self.leaf = rows, attrs, kind, edges, inputs, make, leaf

    # ---- operators -------------------------------------------------------------

    def _with(self, step: Callable[[DataFrame, str], DataFrame], attrs: tuple[str, ...]) -> "Circuit":
        """The same nodes after a step that rows take alike, whether they carry nodes or values."""
        make = lambda algebra, inputs: step(self.make(algebra, inputs), VALUE)
        return Circuit(step(self.rows, NODE), attrs, self.kind, self.edges, self.inputs, make, self.leaf)

    @property
    def _keys(self) -> list[Column]:
        return [col_of(a) for a in self.attrs]

    def where(self, cond: str | Column) -> "Circuit":
        """σ: nodes stay."""
        return self._with(lambda rows, _: rows.where(condition(cond)), self.attrs)

    def rename(self, mapping: dict[str, str]) -> "Circuit":
        """ρ on attributes."""
        names = tuple(mapping.get(a, a) for a in self.attrs)
        _check_names(names)
        return self._with(lambda rows, carried: rows.select(*[col_of(a).alias(n) for a, n in zip(self.attrs, names)], carried), names)

    def alias(self, name: str, sep: str = "_") -> "Circuit":
        return self.rename({a: f"{name}{sep}{a}" for a in self.attrs})

    def project(self, *attrs: str) -> "Circuit":
        """π: one sum gate for each tuple, one edge for each row."""
        missing = [a for a in attrs if a not in self.attrs]
        if missing or not attrs:
            raise ValueError(f"unknown attribute(s) {missing}; available: {list(self.attrs)}")
        number = next(_numbers)
        gate = _hash(F.lit(number), *[col_of(a) for a in attrs])
        rows = self.rows.select(*[col_of(a) for a in attrs]).distinct().withColumn(NODE, gate)
        make = lambda algebra, inputs: algebra.added(inputs[0], attrs)
        return Circuit(rows, tuple(attrs), "sum", self.rows.select(gate.alias(PARENT), F.col(NODE).alias(LEFT)), (self,), make)

    def join(self, other: "Circuit", on: Sequence[tuple[str, str]] | None = None, where: str | Column | None = None) -> "Circuit":
        """⨝ (× without a condition): one product gate for each pair of rows."""
        clash = set(self.attrs) & set(other.attrs)
        if clash:
            raise ValueError(f"attribute(s) {sorted(clash)} on both sides; alias one side first")
        cond = F.lit(True)
        for a, b in on or ():
            cond = cond & (col_of(a) == col_of(b))
        if where is not None:
            cond = cond & condition(where)

        def meet(left: DataFrame, right: DataFrame) -> DataFrame:
            return left.join(right) if on is None and where is None else left.join(right, cond)

        met = meet(self.rows.withColumnRenamed(NODE, LEFT), other.rows.withColumnRenamed(NODE, RIGHT))
        gates = met.withColumn(NODE, _hash(F.lit(next(_numbers)), F.col(LEFT), F.col(RIGHT)))
        edges = gates.select(F.col(NODE).alias(PARENT), LEFT, RIGHT).distinct()
        attrs = self.attrs + other.attrs

        def make(algebra: Algebra, inputs: list[DataFrame]) -> DataFrame:
            both = meet(inputs[0].withColumnRenamed(VALUE, LEFT), inputs[1].withColumnRenamed(VALUE, RIGHT))
            return algebra.there(both.select(*[col_of(a) for a in attrs], algebra.times(F.col(LEFT), F.col(RIGHT)).alias(VALUE)))

        return Circuit(gates.select(*[col_of(a) for a in attrs], NODE), attrs, "product", edges, (self, other), make)

    def cross(self, other: "Circuit") -> "Circuit":
        return self.join(other)

    def msum(self, other: "Circuit") -> "Circuit":
        """⊎: one sum gate for each tuple of either side."""
        if self.attrs != other.attrs:
            raise ValueError(f"schemas differ: {list(self.attrs)} and {list(other.attrs)}")
        # Each side's tuples have one node of their own first, so that no node is an input of both sides.
        sides = self.project(*self.attrs), other.project(*other.attrs)
        gate = _hash(F.lit(next(_numbers)), *self._keys)
        both = sides[0].rows.unionByName(sides[1].rows)
        rows = both.select(*self._keys).distinct().withColumn(NODE, gate)
        make = lambda algebra, inputs: algebra.added(inputs[0].unionByName(inputs[1]), self.attrs)
        return Circuit(rows, self.attrs, "sum", both.select(gate.alias(PARENT), F.col(NODE).alias(LEFT)), sides, make)

    def exists(self) -> "Circuit":
        """δ that keeps existence: a gate that is one where its input isn't zero."""
        whole = self.project(*self.attrs)
        gate = _hash(F.lit(next(_numbers)), F.col(NODE))
        edges = whole.rows.select(gate.alias(PARENT), F.col(NODE).alias(LEFT))
        make = lambda algebra, inputs: inputs[0].select(*self._keys, algebra.one.alias(VALUE))
        return Circuit(whole.rows.withColumn(NODE, gate), self.attrs, "exists", edges, (whole,), make)

    def minus(self, other: "Circuit") -> "Circuit":
        """−: the tuple's own node and not the other side's. Equal tuples of either side are added up first; NULLs match."""
        if self.attrs != other.attrs:
            raise ValueError(f"schemas differ: {list(self.attrs)} and {list(other.attrs)}")
        own = self.project(*self.attrs)
        return own._less(other.project(*other.attrs), tuple_key(self.attrs) == F.col("__k"))

    def anti(self, other: "Circuit", on: Sequence[tuple[str, str]]) -> "Circuit":
        """⊳: a row's node and not the sum of its matches. NULL keys match nothing."""
        theirs = list(dict.fromkeys(b for _, b in on))
        cond = F.lit(True)
        for a, b in on:
            cond = cond & (col_of(a) == F.col("__k")[f"_{theirs.index(b)}"])
        return self._less(other.project(*theirs), cond)

    def _less(self, keys: "Circuit", cond: Column) -> "Circuit":
        right = keys.rows.select(tuple_key(keys.attrs).alias("__k"), F.col(NODE).alias(RIGHT))
        met = self.rows.withColumnRenamed(NODE, LEFT).join(right, cond, "left")

        def make(algebra: Algebra, inputs: list[DataFrame]) -> DataFrame:
            if not algebra.differences:
                raise ValueError("a difference has a value in B only")
            return inputs[0].join(inputs[1].select(tuple_key(keys.attrs).alias("__k")), cond, "left_anti")

        # Rows without a counterpart get a gate too, with one input.
        gates = met.withColumn(NODE, _hash(F.lit(next(_numbers)), F.col(LEFT), F.col(RIGHT)))
        edges = gates.select(F.col(NODE).alias(PARENT), LEFT, RIGHT).distinct()
        return Circuit(gates.select(*self._keys, NODE), self.attrs, "minus", edges, (self, keys), make)

    # ---- evaluation ------------------------------------------------------------

    def _values(self, algebra: Algebra) -> DataFrame:
        """(attrs, VALUE): the rows with the values of their nodes, without those that are zero."""
        return self.make(algebra, [c._values(algebra) for c in self.inputs])

    def _evaluated(self, algebra: Algebra) -> DataFrame:
        """(attrs, VALUE), a row for each tuple."""
        return self._values(algebra).groupBy(*self._keys).agg(algebra.plus(F.col(VALUE)).alias(VALUE))

    def _alive(self, deleted: Sources | None) -> Callable[[DataFrame, Leaf], DataFrame]:
        """The rows of a source relation that are not deleted, with the columns of their leaf."""

        def alive(rows: DataFrame, leaf: Leaf) -> DataFrame:
            if deleted is None:
                return rows
            if isinstance(deleted, DataFrame):
                gone = deleted.select(F.col(deleted.columns[0]).alias("__gone")).distinct()
                return rows.join(gone, variable_name(leaf) == F.col("__gone"), "left_anti")
            if leaf.space not in deleted:
                return rows
            other = deleted[leaf.space]
            gone = other.select(_ids_of(leaf, other, 0).alias("__gone")).distinct()
            return rows.join(gone, F.col(leaf.column) == F.col("__gone"), "left_anti")

        return alive

    def evaluate(self, target: Semiring, values: Sources | None = None, deleted: Sources | None = None) -> KFrame:
        """The relation in a scalar semiring after deleting source rows; ``values`` gives variables other values than one."""
        if target.symbolic:
            raise ValueError("a circuit is evaluated in a scalar semiring")
        alive = self._alive(deleted)
        weight = target.weight
        if weight is None:
            if values is not None:
                raise ValueError("in B variables are deleted or true")
            algebra = Algebra(lambda v: F.first(v), lambda a, b: a, F.lit(True), lambda rows, leaf: alive(rows, leaf).withColumn(VALUE, F.lit(True)), differences=True)
            return KFrame(self._evaluated(algebra).select(*self._keys), self.attrs, target, merged=True)

        def given(rows: DataFrame, leaf: Leaf) -> DataFrame:
            rows = alive(rows, leaf)
            if values is None or not (isinstance(values, DataFrame) or leaf.space in values):
                return rows.withColumn(VALUE, weight.lit_one())
            own = values if isinstance(values, DataFrame) else values[leaf.space]
            ids = F.col(own.columns[0]) if isinstance(values, DataFrame) else _ids_of(leaf, own, 1)
            own = own.select(ids.alias("__id"), weight.given(F.col(own.columns[-1])).alias("__own"))
            key = variable_name(leaf) if isinstance(values, DataFrame) else F.col(leaf.column)
            found = rows.join(own, key == F.col("__id"), "left").withColumn(VALUE, F.coalesce("__own", weight.lit_one()))
            return found.where(~weight.is_zero(F.col(VALUE)))

        cast = lambda v: v.cast(weight.dtype)
        algebra = Algebra(lambda v: cast(weight.plus(v)), lambda a, b: cast(weight.times(a, b)), weight.lit_one(), given, nonzero=lambda v: ~weight.is_zero(v))
        df = self._evaluated(algebra).withColumnRenamed(VALUE, WEIGHT)
        return KFrame(df.where(~weight.is_zero(F.col(WEIGHT))), self.attrs, target, weighted=True, merged=True)

    def derivations(self) -> DataFrame:
        """attrs, terms, degree: how many derivations each tuple has, and how many source rows they use in all.

        These are the sum of coefficients and the total degree of the tuple's polynomial, which is never multiplied out.
        """
        number = lambda c: c.cast(COUNT_TYPE)
        pair = lambda n, d: F.struct(number(n).alias("n"), number(d).alias("d"))
        algebra = Algebra(
            lambda v: pair(F.sum(v["n"]), F.sum(v["d"])),
            lambda a, b: pair(a["n"] * b["n"], a["n"] * b["d"] + b["n"] * a["d"]),
            pair(F.lit(1), F.lit(0)),
            lambda rows, leaf: rows.withColumn(VALUE, pair(F.lit(1), F.lit(1))),
        )
        found = self._evaluated(algebra)
        return found.select(*self._keys, F.col(VALUE)["n"].cast("bigint").alias("terms"), F.col(VALUE)["d"].cast("bigint").alias("degree"))

    def size(self) -> DataFrame:
        """One row: gates and edges of all operators, source rows not counted."""
        parts, seen, todo = [], set(), [self]
        while todo:
            c = todo.pop()
            if c.kind == "source" or id(c.edges) in seen:
                continue
            seen.add(id(c.edges))
            todo += c.inputs
            width = F.lit(1) if RIGHT not in c.edges.columns else F.lit(1) + F.col(RIGHT).isNotNull().cast("int")
            parts.append(c.edges.groupBy(PARENT).agg(F.sum(width).alias("e")).agg(F.count(F.lit(1)).alias("gates"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges")))
        out = parts[0] if parts else self.rows.limit(0).select(F.lit(0).cast("bigint").alias("gates"), F.lit(0).cast("bigint").alias("edges"))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("gates", "edges")])


def source(frame: KFrame) -> Circuit:
    """A source relation, as ``annotate`` makes it with a table name, as a circuit: a node for each variable."""
    if not frame.semiring.symbolic or len(frame.leaves) != 1 or frame.has_names or frame.weighted:
        raise ValueError("a circuit starts from a relation whose rows carry one variable each")
    leaf = frame.leaves[0]
    node = _hash(F.lit(f"variable {leaf.space}"), F.col(leaf.column))
    rows = frame.df.select(*frame.key_columns, node.alias(NODE))
    own = frame.df.select(*frame.key_columns, leaf.column)
    make = lambda algebra, _: algebra.given(own, leaf).select(*[col_of(a) for a in frame.attrs], VALUE)
    return Circuit(rows, frame.attrs, "source", frame.df.select(node.alias(NODE), leaf.column).distinct(), (), make, leaf)
