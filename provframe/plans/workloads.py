"""Composite workloads: joins collapsed onto few tuples, wide formulas, products.

They keep the shape of hand-written operator chains while every input is a whole
table. Formulas that grow with the data are reported by size and checksum.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from provframe.frame import Dedup, KFrame
from provframe.plans import oracle
from provframe.plans.oracle import var
from provframe.plans.registry import Tables, counted, register, tables

HOW = Dedup.HOW_PROVENANCE


def nation_region(t: Tables) -> KFrame:
    return t.nation.cross(t.region).where("n_regionkey = r_regionkey").project("r_name").dedup(HOW)


def supplier_region(t: Tables) -> KFrame:
    return (
        t.supplier.cross(t.nation)
        .where("s_nationkey = n_nationkey")
        .cross(t.region)
        .where("n_regionkey = r_regionkey")
        .project("r_name")
        .dedup(HOW)
    )


def building_orders(t: Tables) -> KFrame:
    return (
        t.customer.where("c_mktsegment = 'BUILDING'")
        .cross(t.orders.early("o_custkey"))
        .where("c_custkey = o_custkey")
        .project("c_mktsegment")
        .dedup(HOW)
    )


def orders_by_flag(t: Tables) -> KFrame:
    return (
        t.orders.cross(t.lineitem.early("l_orderkey", "l_returnflag"))
        .where("o_orderkey = l_orderkey")
        .project("l_returnflag")
        .dedup(HOW)
    )


def asia_lineitems(t: Tables) -> KFrame:
    asia = t.region.where("r_name = 'ASIA'")
    return (
        t.supplier.cross(t.nation)
        .where("s_nationkey = n_nationkey")
        .cross(asia)
        .where("n_regionkey = r_regionkey")
        .cross(t.lineitem.early("l_suppkey"))
        .where("s_suppkey = l_suppkey")
        .project("r_name")
        .dedup(HOW)
    )


_CHAINS = {
    # name: (chain, attribute, FROM/WHERE, tables, small enough for text)
    "b1": (
        nation_region, "r_name",
        "nation, region WHERE n_regionkey = r_regionkey", ("nation", "region"), True,
    ),
    "b2": (
        supplier_region, "r_name",
        "supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
        ("supplier", "nation", "region"), True,
    ),
    "b3": (
        building_orders, "c_mktsegment",
        "customer, orders WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey",
        ("customer", "orders"), False,
    ),
    "b4": (
        orders_by_flag, "l_returnflag",
        "orders, lineitem WHERE o_orderkey = l_orderkey", ("orders", "lineitem"), False,
    ),
    "b5": (
        asia_lineitems, "r_name",
        "lineitem, supplier, nation, region WHERE s_suppkey = l_suppkey "
        "AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'",
        ("lineitem", "supplier", "nation", "region"), False,
    ),
}


def _symbolic(chain, semiring: str, as_text: bool):
    def query(spark, path):
        f = chain(tables(spark, path, semiring))
        return f.text() if as_text else f.stats(digest=True)

    return query


def _oracle(attrs: str, source: str, variables: list[str], semiring: str, as_text: bool) -> str:
    make = {
        ("B[X]", True): oracle.bx_text,
        ("B[X]", False): oracle.bx_stats,
        ("N[X]", True): oracle.nx_text,
        ("N[X]", False): oracle.nx_stats,
    }[semiring, as_text]
    return make(attrs, source, variables)


for _name, (_chain, _attr, _source, _tabs, _text) in _CHAINS.items():
    _vars = [var(x) for x in _tabs]
    register(
        f"{_name}_bool",
        lambda s, d, c=_chain: c(tables(s, d, "B")).result(),
        oracle.rows(_attr, _source),
    )
    register(
        f"{_name}_nat",
        lambda s, d, c=_chain: counted(c(tables(s, d, "N"))),
        oracle.nat(_attr, _source),
    )
    for _sr, _tag in (("B[X]", "bx"), ("N[X]", "nx")):
        register(
            f"{_name}_{_tag}",
            _symbolic(_chain, _sr, _text),
            _oracle(_attr, _source, _vars, _sr, _text),
        )


# ---- one operator under load ---------------------------------------------------------


def selection_control(t: Tables) -> KFrame:
    return t.orders.where("o_totalprice > 250000").project("o_orderkey", "o_orderpriority")


def projection_collision(t: Tables) -> KFrame:
    return t.orders.project(F.lit("K").alias("key"))


def union_wide(t: Tables) -> KFrame:
    key = F.lit("K").alias("key")
    return t.customer.project(key).msum(t.supplier.project(key))


def cross_dense(t: Tables) -> KFrame:
    return t.supplier.project("s_suppkey").cross(t.nation.project("n_nationkey"))


def cross_then_projection(t: Tables) -> KFrame:
    """Both sides keep nothing that the projection keeps, so each may be added up before."""
    left = t.supplier.early(F.lit("X").alias("const"))
    return left.cross(t.nation.early(F.lit("Y").alias("other"))).project("const")


def multiply_wide(t: Tables) -> KFrame:
    """One tuple with a clause per supplier times one tuple with a clause per nation."""
    a = t.supplier.project(F.lit("a").alias("a")).merge()
    b = t.nation.project(F.lit("b").alias("b")).merge()
    return a.cross(b)


def dedup_downstream(t: Tables, strategy: Dedup) -> KFrame:
    wide = t.supplier.project("s_nationkey").dedup(strategy)
    return wide.cross(t.region.project("r_regionkey"))


_SUPPLIER_NATION = [var("supplier"), var("nation")]
_LOADS = {
    "b6": (
        selection_control, "o_orderkey, o_orderpriority",
        "orders WHERE o_totalprice > 250000", [var("orders")], True,
    ),
    "b7": (projection_collision, "'K' AS key", "orders", [var("orders")], False),
    "b9": (
        cross_dense, "s_suppkey, n_nationkey", "supplier, nation", _SUPPLIER_NATION, True,
    ),
    "b10": (cross_then_projection, "'X' AS const", "supplier, nation", _SUPPLIER_NATION, False),
    "b11": (multiply_wide, "'a' AS a, 'b' AS b", "supplier, nation", _SUPPLIER_NATION, False),
    "b12_how": (
        lambda t: dedup_downstream(t, HOW), "s_nationkey, r_regionkey", "supplier, region",
        [var("supplier"), var("region")], False,
    ),
}

for _name, (_chain, _attr, _source, _vars, _text) in _LOADS.items():
    register(
        f"{_name}_nat", lambda s, d, c=_chain: counted(c(tables(s, d, "N"))), oracle.nat(_attr, _source)
    )
    for _sr, _tag in (("B[X]", "bx"), ("N[X]", "nx")):
        register(
            f"{_name}_{_tag}",
            _symbolic(_chain, _sr, _text),
            _oracle(_attr, _source, _vars, _sr, _text),
        )

_BOTH = (
    f"(SELECT 'K' AS key, {var('customer')} AS v FROM customer "
    f"UNION ALL SELECT 'K' AS key, {var('supplier')} AS v FROM supplier)"
)
register("b8_nat", lambda s, d: counted(union_wide(tables(s, d, "N"))), oracle.nat("key", _BOTH))
register("b8_bx", _symbolic(union_wide, "B[X]", False), oracle.bx_stats("key", _BOTH, ["v"]))
register("b8_nx", _symbolic(union_wide, "N[X]", False), oracle.nx_stats("key", _BOTH, ["v"]))

_ONCE = "(SELECT DISTINCT s_nationkey FROM supplier), region"
for _sr, _tag, _make in (("B[X]", "bx", oracle.bx_text), ("N[X]", "nx", oracle.nx_text)):
    register(
        f"b12_exists_{_tag}",
        lambda s, d, sr=_sr: dedup_downstream(tables(s, d, sr), Dedup.EXISTENCE).text(),
        _make("s_nationkey, r_regionkey", _ONCE, [var("region")]),
    )
register(
    "b12_exists_nat",
    lambda s, d: counted(dedup_downstream(tables(s, d, "N"), Dedup.EXISTENCE)),
    oracle.nat("s_nationkey, r_regionkey", _ONCE),
)

# ---- sizes of a whole result -----------------------------------------------------------

for _name in ("b2", "b3", "b5"):
    _chain, _attr, _source, _tabs, _ = _CHAINS[_name]
    register(
        f"formula_stats_{_name}",
        lambda s, d, c=_chain: c(tables(s, d, "B[X]")).total_stats(),
        'SELECT count(*)::BIGINT AS "rows", sum(clauses)::BIGINT AS clauses, '
        "sum(literals)::BIGINT AS literals FROM ("
        + oracle.bx_stats(_attr, _source, [var(x) for x in _tabs])
        + ")",
    )
