"""Results: terms, text, packed annotations, statistics and variables.

A tuple's whole formula in one cell is only a presentation form, and one tuple
may own a large share of all terms. ``text`` and ``packed`` therefore number the
terms of every tuple in canonical order and put ``max_terms`` of them in a part:
read in order, the parts are the canonical formula, whatever its size. Terms are
numbered within stretches of the order that begin alike, and the stretches of a
tuple are added up, so a tuple is sorted in as many tasks as its terms have beginnings. Where one
tuple has a large share of all terms and these begin alike for long, ``text(spread=True)`` and
``numbered`` order them in ranges instead, which are written once. Where tuples hold the identifiers of a
source row, most have few terms: these are put in order where they are, and only the others numbered.
``stats`` and ``terms`` have no large cells at all.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provframe.frame import KFrame, check_results, col_of
from provframe.functions.witness import (
    NAMES,
    WEIGHT,
    all_apart,
    clause_text,
    joined_names,
    monomial_text,
    names_array,
    term_text,
    witness_size,
)

DEFAULT_MAX_TERMS = 100_000
#: Characters by which the order of a tuple's terms is cut into stretches.
STRETCH_CHARS = 40
#: A tuple of no more rows may be put in order in one cell, without numbering its terms.
AT_ONCE = 10_000
#: Tuples with more rows are told by a number below this, of their hash, so that their table stays small.
BUCKETS = 2**18
TERM, KEY, ORDER, STRETCH, BODY = "term", "__key", "__order", "__stretch", "__body"
HASH, BUCKET, MANY = "__hash", "__bucket", "__many"


def _symbolic(frame: KFrame) -> KFrame:
    if not frame.semiring.symbolic:
        raise ValueError(f"{frame.semiring.name} has scalar annotations; use result()")
    return frame.absorb()


def _names(f: KFrame) -> Column:
    if f.has_names and not f.leaves:
        return F.col(NAMES)  # canonical already
    return names_array(f.leaves, f.has_names, not f.semiring.keeps_exponents)


def _may_repeat(f: KFrame) -> bool:
    return f.has_names or not all_apart([x.space for x in f.leaves])


def _weight(f: KFrame) -> Column:
    return F.col(WEIGHT) if f.weighted else f.semiring.weight.lit_one()


def _term_columns(f: KFrame) -> tuple[Column, Column]:
    """(text, sort key) of a row's term. Polynomials sort by monomial, not by coefficient."""
    side_by_side = not _may_repeat(f)
    if not f.semiring.keeps_exponents:
        if side_by_side and any(not x.optional for x in f.leaves):
            text = F.concat(F.lit("("), joined_names(f.leaves, " ∧ ", ""), F.lit(")"))
        else:
            text = clause_text(_names(f))
        return text, text
    if side_by_side:
        monomial = joined_names(f.leaves, "·", "1")
    else:
        monomial = monomial_text(_names(f))
    return term_text(monomial, _weight(f)), monomial


def terms(frame: KFrame, name: str = TERM) -> DataFrame:
    """One row per clause or monomial of every tuple: the annotation in full, unpacked."""
    f = _symbolic(frame)
    check_results(f.attrs, name)
    return f.df.select(*f.key_columns, _term_columns(f)[0].alias(name))


def _unmerged(frame: KFrame) -> KFrame:
    """Canonical witnesses, added up already only where absorption needs it or the frame is so anyway."""
    if not frame.semiring.symbolic:
        raise ValueError(f"{frame.semiring.name} has scalar annotations; use result()")
    from provframe.operators.absorb import may_absorb

    absorbs = frame.semiring.weight is None and not frame.absorbed and may_absorb(frame)
    return frame.absorb() if absorbs else frame.canonical()


def _parts(f: KFrame, order: Column, stretch: Column, body, max_terms: int, finish, name: str, part: str) -> DataFrame:
    """Terms by tuple and part, in order. ``body`` makes the term of its order key and weight.

    Tuples that hold the identifiers of a source row are mostly many, with few terms each. There the rows of equal identifiers are
    counted first, without witnesses, which bounds the terms of their tuples. Tuples of few rows are one part, collected by tuple: where
    a join has dealt the rows by identifiers, they don't move again. The others, of which there may be none, are numbered.
    """
    check_results(f.attrs, part, name)
    if not any(len(x.named) == len(x.ids) for x in f.leaves):
        return _numbered_parts(f, order, stretch, body, max_terms, finish, name, part)
    ids = [col_of(a) for a in f.attrs if any(a in x.named for x in f.leaves)]
    hashed = F.xxhash64(*ids)
    sizes = f.df.groupBy(hashed.alias(HASH), *ids).agg(F.count(F.lit(1)).alias("__size"))
    many = F.broadcast(
        sizes.where(F.col("__size") > min(max_terms, AT_ONCE)).select(F.pmod(HASH, F.lit(BUCKETS)).alias(BUCKET)).distinct().withColumn(MANY, F.lit(True))
    )
    rows = f.df.select(hashed.alias(HASH), *f.key_columns, order.alias(ORDER), *([F.col(WEIGHT)] if f.weighted else []))
    # An outer join, as an anti join would be pushed below the frame's joins, whose moves it would keep waiting.
    few = rows.join(many, F.pmod(HASH, F.lit(BUCKETS)) == F.col(BUCKET), "left").where(F.col(MANY).isNull())
    rest = replace(f, df=f.df.join(many, F.pmod(hashed, F.lit(BUCKETS)) == F.col(BUCKET), "left_semi"))
    by_tuple = [F.col(HASH), *f.key_columns]
    weight, weighted = f.semiring.weight, f.weighted
    if not f.is_merged and weight is not None:
        total = weight.total(F.col(WEIGHT) if weighted else None).alias(WEIGHT)
        few, weighted = few.groupBy(*by_tuple, ORDER).agg(total), True
    distinct = f.is_merged or weight is not None
    collected, in_order = _in_order(body, F.col(WEIGHT) if weighted else weight and weight.lit_one(), distinct)
    whole = few.groupBy(*by_tuple).agg(collected.alias(BODY)).select(*f.key_columns, F.lit(0).alias(part), finish(in_order).alias(name))
    return whole.unionByName(_numbered_parts(rest, order, stretch, body, max_terms, finish, name, part))


def _in_order(body, weight: Column | None, distinct: bool = True) -> tuple[Column, Column]:
    """How the terms of a part are collected, and the terms in order of what was collected."""
    if body is None:  # a term is its own order key
        return (F.collect_list if distinct else F.collect_set)(ORDER), F.sort_array(BODY)
    # The term repeats its order key, so it is made once the rows have moved.
    return F.collect_list(F.struct(F.col(ORDER).alias("o"), weight.alias("w"))), F.transform(F.sort_array(BODY), lambda t: body(t["o"], t["w"]))


def _numbered_parts(f: KFrame, order: Column, stretch: Column, body, max_terms: int, finish, name: str, part: str) -> DataFrame:
    """:func:`_parts` of tuples with any number of terms.

    Rows move twice: dealt by (tuple, stretch), which also serves adding up equal
    terms and numbering them, and by (tuple, part). What is added up over a
    tuple in between is a count for each stretch, read from the same shuffle.
    """
    weight = f.semiring.weight
    rows = f.df.select(
        *f.key_columns, _tuple_id(f.attrs).alias(KEY), stretch.alias(STRETCH), order.alias(ORDER), *([F.col(WEIGHT)] if f.weighted else [])
    ).repartition(KEY, STRETCH)
    weighted = f.weighted
    if not f.is_merged:
        if weight is None:
            rows = rows.distinct()
        else:
            total = weight.total(F.col(WEIGHT) if weighted else None).alias(WEIGHT)
            rows, weighted = rows.groupBy(*f.key_columns, KEY, STRETCH, ORDER).agg(total), True
    within = Window.partitionBy(KEY, STRETCH).orderBy(ORDER)
    sizes = rows.groupBy(KEY, STRETCH).agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(KEY).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(KEY, STRETCH, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__n_in", F.row_number().over(within)).join(before, [KEY, STRETCH])
    number = F.floor((F.col("__before") + F.col("__n_in") - 1) / F.lit(max_terms)).cast("int")
    collected, in_order = _in_order(body, F.col(WEIGHT) if weighted else weight and weight.lit_one())
    return (
        numbered.groupBy(KEY, number.alias("__part"))
        .agg(*[F.first(a).alias(f"__a{i}") for i, a in enumerate(f.key_columns)], collected.alias(BODY))  # max_terms at most
        .select(
            *[F.col(f"__a{i}").alias(a) for i, a in enumerate(f.attrs)],
            F.col("__part").alias(part),
            finish(in_order).alias(name),
        )
    )


def _tuple_id(attrs) -> Column:
    """A tuple's 128-bit hash: short, without floating-point fields, and the same column in every step, so that Spark sees the
    rows are dealt already. NULLs are marked, as hashing passes over them."""
    columns = [F.col("`" + a.replace("`", "``") + "`") for a in attrs]
    marks = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns])
    return F.struct(F.xxhash64(marks, *columns).alias("a"), F.xxhash64(F.lit("second"), *columns, marks).alias("b"))


def numbered(frame: KFrame, name: str = TERM, number: str = "number") -> DataFrame:
    """The terms of every tuple with their place in canonical order, from 0.

    Terms are dealt by ranges of (tuple, order) and written with the number of their range, so a tuple of any size is
    ordered by many tasks, whatever its terms look like.
    """
    from provframe.operators.ordering import BY, before, in_ranges

    f = _symbolic(frame)
    check_results(f.attrs, name, number)
    term, order = _term_columns(f)
    rows = f.df.select(*f.key_columns, _tuple_id(f.attrs).alias(BY), order.alias(ORDER), term.alias(name))
    found = before(in_ranges(rows, [(ORDER, False)]), [(ORDER, False)], {"__n": F.lit(1).cast("bigint")})
    return found.select(*f.key_columns, F.coalesce("__n", F.lit(0).cast("bigint")).alias(number), name)


def text(frame: KFrame, max_terms: int | None = None, name: str = "annotation", part: str = "part", spread: bool = False) -> DataFrame:
    """Canonical text per tuple: ``(a ∧ b) ∨ (c)`` or ``2·t1^2 + t1·t3``.

    Term number k of a tuple, from 0 in canonical order, is in part ``k / max_terms``;
    the parts of a tuple, joined in order, are its canonical text. ``spread`` orders the terms by
    :func:`numbered`, for tuples with very many terms that begin alike; the result is the same.
    """
    if spread:
        check_results(frame.attrs, name, part)
        rows = numbered(frame, "__term", "__number").withColumn(part, F.floor(F.col("__number") / F.lit(max_terms or DEFAULT_MAX_TERMS)).cast("int"))
        keys = frame.key_columns
        grouped = rows.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct("__number", "__term"))).alias(BODY))  # max_terms at most
        return grouped.select(*keys, part, F.array_join(F.col(BODY)["__term"], " + " if frame.semiring.keeps_exponents else " ∨ ").alias(name))
    f = _unmerged(frame)
    exponents = f.semiring.keeps_exponents
    order = _term_columns(f)[1]
    return _parts(
        f,
        order,
        F.substring(order, 1, STRETCH_CHARS),
        term_text if exponents and (f.weighted or not f.is_merged) else None,  # with coefficient one a term is its monomial
        max_terms or DEFAULT_MAX_TERMS,
        lambda c: F.array_join(c, " + " if exponents else " ∨ "),
        name,
        part,
    )


def packed(frame: KFrame, max_terms: int | None = None, name: str = "annotation", part: str = "part") -> DataFrame:
    """Tuples with their annotation as one value.

    B: true; N: the multiplicity; B[X]: array of clauses, each an array of
    variables; N[X]: array of (m: [(v, e)], c). Symbolic forms carry ``part``
    as in :func:`text`.
    """
    if not frame.semiring.symbolic:
        if frame.semiring.weight is None:
            check_results(frame.attrs, name)
            return frame.merge().df.withColumn(name, F.lit(True))
        return frame.result(name)
    f = _unmerged(frame)
    names = _names(f)
    first = F.struct(*[F.coalesce(F.get(names, F.lit(k)), F.lit("")).alias(f"v{k}") for k in range(2)])
    if not f.semiring.keeps_exponents:
        return _parts(f, names, first, None, max_terms or DEFAULT_MAX_TERMS, lambda c: c, name, part)
    monomial = F.transform(
        F.array_distinct(names),
        lambda v: F.struct(v.alias("v"), F.size(F.filter(names, lambda x: x == v)).alias("e")),
    )
    first = F.coalesce(F.get(names, F.lit(0)), F.lit(""))
    body = lambda o, w: F.struct(o.alias("m"), w.alias("c"))
    return _parts(f, monomial, first, body, max_terms or DEFAULT_MAX_TERMS, lambda c: c, name, part)


def digest_of(text_column: Column) -> Column:
    """First 32 bits of the MD5 of a term, as a number that can be summed."""
    return F.conv(F.substring(F.md5(text_column.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _spelled_pairs(frame: KFrame) -> KFrame:
    """A join's distinct pairs, with names made before the rows were paired, if that is all the frame is; else the frame."""
    if frame.pairs is None or not frame.semiring.symbolic or frame.is_merged:
        return frame
    from provframe.operators.pairs import merged

    return merged(frame, spelled=True) or frame


def stats(frame: KFrame, digest: bool = False) -> DataFrame:
    """Size of each tuple's annotation, by plain pre-aggregated sums.

    B[X]: ``clauses, literals``. N[X]: ``terms, coefficients`` (their sum) and
    ``degree`` (variables of all monomials, with repeats). ``digest`` adds an
    order-free checksum over the terms' text, which compares formulas too large
    to print.
    """
    measures = ("terms", "coefficients", "degree") if frame.semiring.keeps_exponents else ("clauses", "literals")
    check_results(frame.attrs, *measures, *(["digest"] if digest else []))
    if digest:
        found = _hashed_pairs(frame, measures)
        if found is not None:
            return found
    f = _symbolic(_spelled_pairs(frame) if digest else frame)
    size = witness_size(f.leaves, f.has_names)
    if f.semiring.keeps_exponents:
        aggs = [
            F.count(F.lit(1)).alias("terms"),
            F.sum(_weight(f)).cast("bigint").alias("coefficients"),
            F.sum(size).cast("bigint").alias("degree"),
        ]
    else:
        aggs = [
            F.count(F.lit(1)).alias("clauses"),
            F.sum(size).cast("bigint").alias("literals"),
        ]
    if digest:
        aggs.append(F.sum(digest_of(_term_columns(f)[0])).cast("bigint").alias("digest"))
    return f.df.groupBy(*f.key_columns).agg(*aggs)


def _hashed_pairs(frame: KFrame, measures: tuple[str, ...]) -> DataFrame | None:
    """:func:`stats` of a join's pairs, added up where they meet, if that is all the frame is."""
    if frame.pairs is None or not frame.semiring.symbolic:
        return None
    from provframe.operators.absorb import may_absorb
    from provframe.operators.hashed import DIGEST, TERMS, sums

    if frame.semiring.weight is None and may_absorb(frame):
        return None
    found = sums(frame)
    if found is None:
        return None
    alone, repeated = found
    # Each pair is a term of its own, with all leaves once and coefficient one.
    literals = (F.col(TERMS) * F.lit(len(frame.leaves))).alias(measures[-1])
    rows = alone.select(*frame.key_columns, *[F.col(TERMS).alias(m) for m in measures[:-1]], literals, F.col(DIGEST).alias("digest"))
    for part in repeated:
        rows = rows.unionByName(stats(part, digest=True))
    return rows.groupBy(*frame.key_columns).agg(*[F.sum(m).cast("bigint").alias(m) for m in (*measures, "digest")])


def total_stats(frame: KFrame) -> DataFrame:
    """One row: tuples, clauses (or terms) and literals (or degree) of the whole relation."""
    per_tuple = stats(frame)
    measures = per_tuple.columns[len(frame.attrs):]
    return per_tuple.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in measures],
    )


def differences(left: KFrame, right: KFrame) -> DataFrame:
    """Terms that only one of two relations has, ``side`` 1 for the left, -1 for the right.

    Both are brought into canonical form and compared term by term in one
    grouping; no formula is put together. Scalar annotations are compared as
    (tuple, value).
    """
    left._need_same_semiring(right)
    if left.attrs != right.attrs:
        raise ValueError(f"schemas differ: {list(left.attrs)} and {list(right.attrs)}")

    def side(f: KFrame, sign: int) -> DataFrame:
        if f.semiring.symbolic:
            rows = terms(f)
        elif f.semiring.weight is not None:
            rows = f.result(TERM)
        else:
            rows = f.result().withColumn(TERM, F.lit(True))
        return rows.withColumn("side", F.lit(sign))

    check_results(left.attrs, TERM, "side")
    both = side(left, 1).unionByName(side(right, -1))
    keys = [*left.key_columns, F.col(TERM)]
    return both.groupBy(*keys).agg(F.sum("side").cast("int").alias("side")).where("side <> 0")


def variables(frame: KFrame, name: str = "variable") -> DataFrame:
    """The distinct variables of each tuple's annotation, one per row."""
    f = _symbolic(frame)
    check_results(f.attrs, name)
    return f.df.select(*f.key_columns, F.explode(_names(f)).alias(name)).distinct()


def one_witness(frame: KFrame) -> KFrame:
    """Keep each tuple's smallest monomial (or clause), with coefficient one."""
    f = _symbolic(frame).as_names()
    df = f.df.groupBy(*f.key_columns).agg(F.min(NAMES).alias(NAMES))
    return replace(f, df=df, leaves=(), has_names=True, weighted=False, merged=True, keyed=False)
