"""Witness columns: which source rows a derivation used.

A witness is stored as one struct column per *leaf* (an occurrence of a source
table in the plan) holding that row's identifying values in their native
types, so a product of relations only puts columns side by side. A NULL struct
says the leaf takes no part in this row's derivation.

Witnesses that arrive as ready-made variable names live in one
``array<string>`` column instead, and every layout can be turned into it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = "__names"
WEIGHT = "__n"
LEAF_PREFIX = "__w"


@dataclass(frozen=True)
class Leaf:
    """One struct column of row identifiers drawn from the variable space ``space``.

    ``named`` are attributes of the frame that hold identifiers of the leaf in every row. A ``spelled`` leaf holds
    the variable's name instead of identifiers.
    """

    column: str
    space: str
    ids: T.StructType
    optional: bool = False  # NULL in some rows
    named: tuple[str, ...] = ()
    spelled: bool = False

    @property
    def kind(self) -> tuple[str, str]:
        """Leaves of one kind draw from the same variables."""
        return self.space, "name" if self.spelled else self.ids.simpleString()

    def at(self, column: str) -> "Leaf":
        return replace(self, column=column)


def leaf_column(i: int) -> str:
    return f"{LEAF_PREFIX}{i}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spaces_apart(a: str, b: str) -> bool:
    """True when no variable of space ``a`` can spell like one of space ``b``."""
    return not (f"{a}_".startswith(f"{b}_") or f"{b}_".startswith(f"{a}_"))


def all_apart(spaces: Sequence[str]) -> bool:
    return all(spaces_apart(a, b) for a, b in combinations(spaces, 2))


def _id_text(value: Column, dtype: T.DataType, composite: bool) -> Column:
    text = value.cast("string")
    if isinstance(dtype, T.StringType):
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        if composite:  # keep ("a_b", "c") and ("a", "b_c") apart
            text = F.replace(text, F.lit("_"), F.lit("\\_"))
    return F.coalesce(text, F.lit("\\N"))


def variable_name(leaf: Leaf) -> Column:
    """``space_id1_id2``, or NULL when the leaf is absent."""
    fields = leaf.ids.fields
    struct = F.col(leaf.column)
    if leaf.spelled:
        return struct[fields[0].name]
    parts = [_id_text(struct[f.name], f.dataType, len(fields) > 1) for f in fields]
    name = F.concat_ws("_", F.lit(leaf.space), *parts)
    return F.when(struct.isNotNull(), name) if leaf.optional else name


def in_name_order(leaves: Sequence[Leaf]) -> list[Leaf]:
    """Leaves of spaces that are apart, in the order their variables always sort."""
    return sorted(leaves, key=lambda x: f"{x.space}_".encode())


def names_array(leaves: Sequence[Leaf], has_names: bool, distinct: bool) -> Column:
    """All variables of the row as one sorted array, with repeats unless ``distinct``."""
    parts: list[Column] = []
    if leaves:
        apart = not has_names and all_apart([x.space for x in leaves])
        own = F.array(*[variable_name(x) for x in (in_name_order(leaves) if apart else leaves)])
        if any(x.optional for x in leaves):
            own = F.array_compact(own)
        if apart:
            return own
        parts.append(own)
    if has_names:
        parts.append(F.col(NAMES))
    if not parts:
        return F.array().cast("array<string>")
    merged = parts[0] if len(parts) == 1 else F.concat(*parts)
    if distinct:
        merged = F.array_distinct(merged)
    return F.sort_array(merged)


def witness_size(leaves: Sequence[Leaf], has_names: bool) -> Column:
    """Number of variables in a canonical witness."""
    size: Column = F.lit(0)
    for leaf in leaves:
        size = size + (F.col(leaf.column).isNotNull().cast("int") if leaf.optional else F.lit(1))
    if has_names:
        size = size + F.size(NAMES)
    return size


def joined_names(leaves: Sequence[Leaf], glue: str, empty: str) -> Column:
    """Variables of leaves that are apart as one text, without building an array."""
    if not leaves:
        return F.lit(empty)
    text = F.concat_ws(glue, *[variable_name(x) for x in in_name_order(leaves)])
    if all(x.optional for x in leaves):
        text = F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))
    return text


def clause_text(names: Column) -> Column:
    return F.when(F.size(names) == 0, F.lit("True")).otherwise(
        F.concat(F.lit("("), F.array_join(names, " ∧ "), F.lit(")"))
    )


def monomial_text(names: Column) -> Column:
    """``a^2·b`` from a sorted array with repeats; ``1`` for the empty monomial."""

    def power(v: Column) -> Column:
        e = F.size(F.filter(names, lambda x: x == v))
        return F.when(e > 1, F.concat(v, F.lit("^"), e.cast("string"))).otherwise(v)

    factors = F.transform(F.array_distinct(names), power)
    return F.when(F.size(names) == 0, F.lit("1")).otherwise(F.array_join(factors, "·"))


def term_text(monomial: Column, coefficient: Column) -> Column:
    c = coefficient.cast("string")
    return (
        F.when(monomial == "1", c)
        .when(coefficient == 1, monomial)
        .otherwise(F.concat(c, F.lit("·"), monomial))
    )
