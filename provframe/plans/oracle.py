"""SQL (DuckDB dialect) that computes annotations directly, for comparison.

Each helper takes the FROM/WHERE of an ordinary query and the SQL expressions of
the variables of the rows it joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from provframe.functions.render import DEFAULT_MAX_TERMS

VARIABLE = {
    "nation": "'nation_' || {p}n_nationkey",
    "region": "'region_' || {p}r_regionkey",
    "supplier": "'supplier_' || {p}s_suppkey",
    "customer": "'customer_' || {p}c_custkey",
    "orders": "'orders_' || {p}o_orderkey",
    "part": "'part_' || {p}p_partkey",
    "partsupp": "'partsupp_' || {p}ps_partkey || '_' || {p}ps_suppkey",
    "lineitem": "'lineitem_' || {p}l_orderkey || '_' || {p}l_linenumber || '_' || {p}l_partkey"
    " || '_' || {p}l_suppkey || '_' || {p}l_shipdate",
}

PARTSUPP = (
    "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) partsupp"
)
NATION_COLUMNS = ("n_nationkey", "n_name", "n_regionkey")


def var(table: str, alias: str | None = None) -> str:
    return VARIABLE[table].format(p=f"{alias}_" if alias else "")


def nation_as(alias: str) -> str:
    cols = ", ".join(f"{c} AS {alias}_{c}" for c in NATION_COLUMNS)
    return f"(SELECT {cols} FROM nation) {alias}"


def rows(attrs: str, source: str) -> str:
    return f"SELECT DISTINCT {attrs} FROM {source}"


def nat(attrs: str, source: str) -> str:
    names = _names(attrs)
    return (
        f"SELECT {names}, count(*)::BIGINT AS n FROM (SELECT {attrs} FROM {source}) GROUP BY {names}"
    )


def _names(attrs: str) -> str:
    return ", ".join(a.split(" AS ")[-1].strip() for a in attrs.split(", "))


def clauses(attrs: str, source: str, variables: Sequence[str]) -> str:
    """(attrs, cl): distinct clauses as sorted lists, before absorption."""
    items = ", ".join(variables)
    return f"SELECT DISTINCT {attrs}, list_sort(list_distinct([{items}])) AS cl FROM {source}"


CLAUSE_TEXT = "CASE WHEN len(cl) = 0 THEN 'True' ELSE '(' || array_to_string(cl, ' ∧ ') || ')' END"
HASH = "('0x' || substr(md5({t}), 1, 8))::BIGINT"
DIGEST = f"sum({HASH})::BIGINT AS digest"


def _with_parts(names: str, term: str, terms_sql: str, max_terms: int = DEFAULT_MAX_TERMS) -> str:
    """Part k of a tuple holds its terms number k * max_terms and following, in order."""
    return (
        f"SELECT *, ((row_number() OVER (PARTITION BY {names} ORDER BY {term}) - 1) // {max_terms})::INTEGER AS part "
        f"FROM ({terms_sql})"
    )


def bx_text_of(names: str, clause_sql: str) -> str:
    terms = f"SELECT {names}, {CLAUSE_TEXT} AS t FROM ({clause_sql})"
    return (
        f"SELECT {names}, part, string_agg(t, ' ∨ ' ORDER BY t) AS annotation "
        f"FROM ({_with_parts(names, 't', terms)}) GROUP BY {names}, part"
    )


def bx_stats_of(names: str, clause_sql: str) -> str:
    return (
        f"SELECT {names}, count(*)::BIGINT AS clauses, sum(len(cl))::BIGINT AS literals, "
        f"{DIGEST.format(t=CLAUSE_TEXT)} FROM ({clause_sql}) GROUP BY {names}"
    )


def bx_text(attrs: str, source: str, variables: Sequence[str]) -> str:
    return bx_text_of(_names(attrs), clauses(attrs, source, variables))


def bx_stats(attrs: str, source: str, variables: Sequence[str]) -> str:
    return bx_stats_of(_names(attrs), clauses(attrs, source, variables))


def monomials(attrs: str, source: str, variables: Sequence[str]) -> str:
    """(attrs, mono, c): sorted variable lists with repeats, and coefficients."""
    items = ", ".join(variables)
    names = _names(attrs)
    return (
        f"SELECT {names}, mono, count(*)::BIGINT AS c FROM "
        f"(SELECT {attrs}, list_sort([{items}]) AS mono FROM {source}) GROUP BY {names}, mono"
    )


MONOMIAL_TEXT = (
    "CASE WHEN len(mono) = 0 THEN '1' ELSE array_to_string(list_transform("
    "list_sort(list_distinct(mono)), lambda v: CASE WHEN len(list_filter(mono, lambda x: x = v)) > 1 "
    "THEN v || '^' || len(list_filter(mono, lambda x: x = v)) ELSE v END), '·') END"
)
TERM_TEXT = "CASE WHEN mt = '1' THEN c::VARCHAR WHEN c = 1 THEN mt ELSE c || '·' || mt END"


def nx_text(attrs: str, source: str, variables: Sequence[str]) -> str:
    return nx_text_of(_names(attrs), monomials(attrs, source, variables))


def nx_text_of(names: str, monomial_sql: str) -> str:
    terms = f"SELECT {names}, {MONOMIAL_TEXT} AS mt, c FROM ({monomial_sql})"
    return (
        f"SELECT {names}, part, string_agg({TERM_TEXT}, ' + ' ORDER BY mt) AS annotation "
        f"FROM ({_with_parts(names, 'mt', terms)}) GROUP BY {names}, part"
    )


def nx_stats(attrs: str, source: str, variables: Sequence[str]) -> str:
    return nx_stats_of(_names(attrs), monomials(attrs, source, variables))


def nx_stats_of(names: str, monomial_sql: str) -> str:
    return (
        f"SELECT {names}, count(*)::BIGINT AS terms, sum(c)::BIGINT AS coefficients, "
        f"sum(len(mono))::BIGINT AS degree, {DIGEST.format(t=TERM_TEXT)} "
        f"FROM (SELECT {names}, mono, {MONOMIAL_TEXT} AS mt, c FROM ({monomial_sql})) GROUP BY {names}"
    )
