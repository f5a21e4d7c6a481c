"""Valuations: symbolic annotations under given values of their variables.

A formula or polynomial describes what happens under any values of the source rows. ``without`` deletes source rows;
``specialise`` maps every variable into another semiring and adds and multiplies there. Both go term by term over the row form:
a value reaches a term by an equi-join on the variable that Spark can split, and no formula is put together.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.frame import KFrame, tuple_key
from provframe.functions.witness import NAMES, WEIGHT, Leaf, names_array, quoted, variable_name
from provframe.semirings import N, Semiring

#: Source rows by table: (id columns in the order of annotate) for deletion, (id columns, value) for a valuation; or by name, (variable) or (variable, value).
Sources = Mapping[str, DataFrame] | DataFrame


def _ids_of(leaf: Leaf, rows: DataFrame, extra: int) -> Column:
    """The ids of given source rows as a struct of the leaf's type."""
    names = rows.columns[: len(rows.columns) - extra]
    if len(names) != len(leaf.ids.fields):
        raise ValueError(f"{leaf.space} has {len(leaf.ids.fields)} id column(s), not {names}")
    return F.struct(*[F.col(quoted(n)).cast(f.dataType).alias(f.name) for n, f in zip(names, leaf.ids.fields)])


def _need_symbolic(frame: KFrame) -> None:
    if not frame.semiring.symbolic:
        raise ValueError(f"{frame.semiring.name} annotations have no variables")


def without(frame: KFrame, deleted: Sources) -> KFrame:
    """The relation after deleting source rows: every term that uses one of them goes.

    ``deleted`` has the ids of rows by table, or variables by name. Tuples that lose all terms are absent.
    """
    _need_symbolic(frame)
    df = frame.df
    for leaf in frame.leaves:
        if isinstance(deleted, DataFrame):
            gone, key = deleted.select(F.col(quoted(deleted.columns[0])).alias("__gone")).distinct(), variable_name(leaf)
        elif leaf.space in deleted:
            rows = deleted[leaf.space]
            gone, key = rows.select(_ids_of(leaf, rows, 0).alias("__gone")).distinct(), F.col(leaf.column)
        else:
            continue
        df = df.join(gone, key == F.col("__gone"), "left_anti")
    if frame.has_names:
        if not isinstance(deleted, DataFrame):
            raise ValueError("this relation has variables by name only; give the deleted ones by name")
        gone = deleted.select(F.col(quoted(deleted.columns[0])).alias("__gone")).distinct()
        own = df.select(NAMES, F.explode(NAMES).alias("__v")).join(gone, F.col("__v") == F.col("__gone"), "left_semi")
        df = df.join(own.select(F.col(NAMES).alias("__dead")).distinct(), F.col(NAMES) == F.col("__dead"), "left_anti")
    return replace(frame, df=df)


def specialise(frame: KFrame, target: Semiring, values: Sources | None = None) -> KFrame:
    """The image of the annotations in a scalar semiring: variables take ``values``, all others one.

    N[X] maps into every commutative semiring; a coefficient c is the one added c times, which a :class:`Weight` tells by
    ``natural``. B[X] maps where addition and multiplication are idempotent and absorb each other, as a Weight with
    ``lattice`` promises, and into B. Values of zero delete.
    """
    _need_symbolic(frame)
    if target.symbolic:
        raise ValueError("a valuation maps into a scalar semiring")
    weight = target.weight
    if weight is None:
        if values is not None:
            raise ValueError("use without() to delete variables; all others are true in B")
        return KFrame(frame.df.select(*frame.key_columns), frame.attrs, target)
    if not frame.semiring.keeps_exponents and not weight.lattice:
        raise ValueError(f"B[X] has no image in {target.name}, which is no lattice")
    f = frame
    factors: list[Column] = []
    if f.weighted:
        if weight.natural is None:
            raise ValueError(f"{target.name} does not say what a coefficient means (Weight.natural)")
        factors.append(weight.natural(F.col(WEIGHT)).cast(weight.dtype))
    df = f.df
    for i, leaf in enumerate(f.leaves):
        if values is None or not (isinstance(values, DataFrame) or leaf.space in values):
            continue
        given = values if isinstance(values, DataFrame) else values[leaf.space]
        ids = F.col(quoted(given.columns[0])) if isinstance(values, DataFrame) else _ids_of(leaf, given, 1)
        own = given.select(ids.alias("__id"), weight.given(F.col(quoted(given.columns[-1]))).alias(f"__value{i}"))
        key = variable_name(leaf) if isinstance(values, DataFrame) else F.col(leaf.column)
        df = df.join(own, key == F.col("__id"), "left").drop("__id")
        factors.append(F.coalesce(F.col(f"__value{i}"), weight.lit_one()))
    if f.has_names and values is not None:
        if not isinstance(values, DataFrame):
            raise ValueError("this relation has variables by name only; give their values by name")
        own = values.select(F.col(quoted(values.columns[0])).alias("__id"), weight.given(F.col(quoted(values.columns[-1]))).alias("__value"))
        terms = df.select(NAMES).distinct().select(NAMES, F.explode(NAMES).alias("__v")).join(own, F.col("__v") == F.col("__id"))
        # One value for each factor of a term, so bounded by its length.
        product = F.aggregate(F.collect_list("__value"), weight.lit_one(), lambda a, b: weight.times(a, b).cast(weight.dtype))
        terms = terms.groupBy(F.col(NAMES).alias("__term")).agg(product.alias("__of_names"))
        df = df.join(terms, F.col(NAMES) == F.col("__term"), "left").drop("__term")
        factors.append(F.coalesce(F.col("__of_names"), weight.lit_one()))
    columns = list(f.key_columns)
    if factors:
        total = factors[0]
        for x in factors[1:]:
            total = weight.times(total, x)
        columns.append(total.cast(weight.dtype).alias(WEIGHT))
    df = df.select(*columns)
    if factors:
        df = df.where(~weight.is_zero(F.col(WEIGHT)))
    return KFrame(df, f.attrs, target, weighted=bool(factors))


class Aggregated:
    """Groups whose aggregate values follow the provenance (elements of the semimodule of annotations and values).

    The value of COUNT, SUM, MIN or MAX in a group is a formal sum of annotation ⊗ value over the group's tuples. It is
    kept in row form, a row for each term and value, and becomes a number under a valuation: ``under`` deletes source rows or gives them
    multiplicities. A HAVING condition is likewise open until then. N[X] aggregates with multiplicities; B[X] over
    the distinct tuples that are still there.
    """

    def __init__(self, frame: KFrame, by: tuple[str, ...], aggregates: Mapping[str, tuple[str, str]], conditions: tuple[str, ...] = ()):
        from provframe.operators.extra import check_aggregates

        _need_symbolic(frame)
        frame._need(by)
        check_aggregates(frame, aggregates)
        used = list(dict.fromkeys(a for _, a in aggregates.values() if a != "*"))
        # B[X] aggregates over tuples, and all attributes make one.
        self.frame = frame.project(*dict.fromkeys([*by, *used])) if frame.semiring.keeps_exponents else frame
        self.by, self.aggregates, self.conditions = tuple(by), dict(aggregates), conditions

    def having(self, condition: str) -> "Aggregated":
        """Groups that satisfy a SQL condition on the aggregates, whenever they get values."""
        return Aggregated(self.frame, self.by, self.aggregates, (*self.conditions, condition))

    def groups(self) -> KFrame:
        """The groups with the annotation of being there at all, as projection gives it; HAVING is not decided."""
        return self.frame.project(*self.by)

    def under(self, deleted: Sources | None = None, multiplicities: Sources | None = None) -> KFrame:
        """The groups and values in N (from N[X]) or B (from B[X]) after deleting source rows or giving them multiplicities."""
        f = self.frame if deleted is None else without(self.frame, deleted)
        if f.semiring.keeps_exponents:
            f = specialise(f, N, multiplicities)
        elif multiplicities is not None:
            raise ValueError("B[X] knows no multiplicities")
        else:
            from provframe.semirings import B

            f = specialise(f, B)
        result = f.group(self.by, **self.aggregates)
        for condition in self.conditions:
            result = result.where(condition)
        return result

    def elements(self, name: str = "term") -> DataFrame:
        """The formal sums in normal form: group, term, and for each aggregate the value that stands with the term.

        In N[X] the values at equal monomials of a group are added up by the aggregate, coefficients included. In B[X] a
        tuple keeps its clauses, each with the tuple's values.
        """
        from provframe.functions.render import _symbolic, _term_columns
        from provframe.operators.extra import _aggregate_columns

        if not self.frame.semiring.keeps_exponents:
            f = _symbolic(self.frame)
            values = [(F.lit(1).cast("bigint") if a == "*" else F.col(quoted(a))).alias(n) for n, (_, a) in self.aggregates.items()]
            return f.df.select(*[F.col(quoted(a)) for a in self.by], _term_columns(f)[0].alias(name), *values)
        f = self.frame.canonical()
        monomial = _term_columns(replace(f, weighted=False))[1]
        rows = replace(f, df=f.df.select(*f.key_columns, monomial.alias("__m"), *([WEIGHT] if f.weighted else [])))
        keys = [F.col(quoted(a)) for a in self.by]
        return rows.df.groupBy(*keys, F.col("__m").alias(name)).agg(*_aggregate_columns(rows, self.aggregates))

    def contributions(self, name: str = "variable") -> DataFrame:
        """COUNT and SUM of every group after deleting one variable, for each variable the group depends on.

        Deleting a source row takes, in N[X], the terms that hold its variable; in B[X], the tuples that hold it in all their
        clauses. Variables whose deletion takes nothing are left out; a COUNT of zero says that the group is gone.
        """
        wrong = [n for n, (fn, _) in self.aggregates.items() if fn.upper() not in ("COUNT", "SUM")]
        if wrong:
            raise ValueError(f"contributions are known for COUNT and SUM, not for {wrong}")
        exponents = self.frame.semiring.keeps_exponents
        f = self.frame.canonical() if exponents else self.frame.absorb()
        values = {}
        weight = F.col(WEIGHT) if exponents and f.weighted else F.lit(1)
        for n, (fn, a) in self.aggregates.items():
            x = F.lit(1) if a == "*" else F.col(quoted(a))
            values[n] = F.when(x.isNotNull(), weight if fn.upper() == "COUNT" else weight * x)
        names = names_array(f.leaves, f.has_names, True)
        by = tuple_key(self.by).alias("__g") if self.by else F.lit(0).alias("__g")
        kept = [F.col(quoted(a)) for a in self.by]
        if exponents:
            # An equal monomial may stand in several rows; each counts with its own coefficient.
            taken = f.df.select(by, *[v.alias(f"__{n}") for n, v in values.items()], F.explode(names).alias(name))
            whole = f.df.select(by, *kept, *[v.alias(f"__{n}") for n, v in values.items()])
        else:
            clauses = f.df.select(by, *kept, tuple_key(f.attrs).alias("__t"), *[v.alias(f"__{n}") for n, v in values.items()], names.alias("__vs"))
            columns = [F.first(f"__{n}").alias(f"__{n}") for n in values]
            tuples = clauses.groupBy("__g", "__t").agg(F.count(F.lit(1)).alias("__clauses"), *[F.first(quoted(a)).alias(a) for a in self.by], *columns)
            held = clauses.select("__t", F.explode("__vs").alias(name)).groupBy("__t", name).agg(F.count(F.lit(1)).alias("__held"))
            needed = held.join(tuples.withColumnRenamed("__t", "__tt"), (F.col("__t") == F.col("__tt")) & (F.col("__held") == F.col("__clauses")))
            taken = needed.select("__g", *[f"__{n}" for n in values], name)
            whole = tuples
        sums = [F.coalesce(F.sum(f"__{n}"), F.lit(0)) for n in values]
        lost = taken.groupBy("__g", name).agg(*[s.alias(f"__lost_{n}") for n, s in zip(values, sums)])
        total = whole.groupBy(F.col("__g").alias("__gg")).agg(*[F.first(quoted(a)).alias(a) for a in self.by], *[s.alias(f"__all_{n}") for n, s in zip(values, sums)])
        left = [(F.col(f"__all_{n}") - F.col(f"__lost_{n}")).cast("bigint" if self._integral(n) else "double").alias(n) for n in values]
        return lost.join(total, F.col("__g") == F.col("__gg")).select(*kept, F.col(quoted(name)), *left)

    def _integral(self, name: str) -> bool:
        fn, attr = self.aggregates[name]
        return fn.upper() == "COUNT" or self.frame.df.schema[attr].dataType.typeName() in ("byte", "short", "integer", "long")
