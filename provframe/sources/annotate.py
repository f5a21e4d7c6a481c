"""Turn a DataFrame into an annotated relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.frame import KFrame, _check_names, col_of, condition
from provframe.functions.witness import NAMES, WEIGHT, Leaf, leaf_column
from provframe.semirings import Semiring


def annotate(
    df: DataFrame,
    semiring: Semiring,
    table: str | None = None,
    ids: Sequence[str] | None = None,
    *,
    weight: str | Column | None = None,
    present: str | Column | None = None,
    unique: bool = False,
    keep: Sequence[str] | None = None,
) -> KFrame:
    """Annotate every row of ``df``.

    Without ``table`` each row gets the constant one. With ``table``, symbolic
    semirings give each row the variable ``table_id1_id2...`` made of its ``ids``
    values; without ``ids`` the name is a 128-bit hash of all columns. Rows that
    share their ids share a variable. Equal rows are one tuple, added up when the
    frame is merged.

    ``weight`` gives scalar annotations (or coefficients), ``present`` Boolean
    ones. Zeros are dropped; NULL weights, and in N negative or fractional ones,
    raise. ``unique=True`` promises
    that no two rows share their ids, which lets plans skip merging. ``keep``
    limits the attributes to these columns.
    """
    attrs = tuple(keep) if keep is not None else tuple(
        c for c in df.columns if c != weight and c != present
    )
    _check_names(attrs)
    missing = [c for c in list(attrs) + list(ids or []) if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; available: {df.columns}")
    if present is not None:
        df = df.where(condition(present) if not isinstance(present, str) else col_of(present))
    cols: list[Column] = [col_of(a) for a in attrs]
    leaves: tuple[Leaf, ...] = ()
    name = leaf_column(0)
    if semiring.symbolic and table is not None:
        if ids:
            parts = [col_of(c) for c in ids]
        else:
            everything = F.struct(*[col_of(c) for c in df.columns])
            parts = [F.md5(F.to_json(everything, {"ignoreNullFields": "false"}).cast("binary"))]
            unique = False
        cols.append(F.struct(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).alias(name))
    weighted = weight is not None
    if weighted:
        if semiring.weight is None:
            raise ValueError(f"{semiring.name} annotations have no weight")
        w = semiring.weight.given(col_of(weight) if isinstance(weight, str) else weight)
        cols.append(w.alias(WEIGHT))
    out = df.select(*cols)
    if weighted:
        out = out.where(~semiring.weight.is_zero(F.col(WEIGHT)))
    if semiring.symbolic and table is not None:
        leaves = (Leaf(name, table, out.schema[name].dataType, named=tuple(a for a in ids or () if a in attrs)),)
    return KFrame(
        out,
        attrs,
        semiring,
        leaves,
        weighted=weighted,
        keyed=unique and bool(leaves),
        sizes=frozenset({1}) if leaves else frozenset({0}),
    )


def from_terms(
    df: DataFrame, semiring: Semiring, names: str, coefficient: str | None = None
) -> KFrame:
    """A relation whose rows already hold one clause or monomial each.

    ``names`` is an ``array<string>`` of variable names: a clause, or a monomial
    in which a variable appears as often as its exponent. A tuple with several
    terms has several rows; a tuple with none, or with a NULL term, is absent.
    """
    if not semiring.symbolic:
        raise ValueError(f"{semiring.name} has no terms; use annotate()")
    attrs = tuple(c for c in df.columns if c not in (names, coefficient))
    _check_names(attrs)
    cols = [col_of(a) for a in attrs] + [col_of(names).alias(NAMES)]
    weighted = coefficient is not None
    if weighted:
        if semiring.weight is None:
            raise ValueError(f"{semiring.name} clauses have no coefficients")
        cols.append(semiring.weight.given(col_of(coefficient)).alias(WEIGHT))
    out = df.select(*cols).where(F.col(NAMES).isNotNull())
    if weighted:
        out = out.where(~semiring.weight.is_zero(F.col(WEIGHT)))
    return KFrame(out, attrs, semiring, has_names=True, weighted=weighted, sizes=None)
