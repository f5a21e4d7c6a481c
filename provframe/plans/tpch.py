"""The adapted TPC-H queries, in all four semirings.

Each is SELECT DISTINCT over a product of tables with one predicate, without
aggregates. The tables at hand lack some columns, so predicates on those are
left out, and the modulo filters that only reduced the data are left out too.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from provframe.frame import Dedup, KFrame
from provframe.plans import oracle
from provframe.plans.registry import Tables, counted, register, tables


@dataclass(frozen=True)
class Adapted:
    """``tables`` lists the FROM clause, ``table`` or ``table alias``.

    ``early`` names tables that only contribute one join key: (own predicate,
    key). They are reduced to that key with :meth:`KFrame.early` before the join.
    """

    select: tuple[str, ...]
    tables: tuple[str, ...]
    where: str
    collapses: bool = False  # few tuples with formulas that grow with the data
    early: dict[str, tuple[str, str]] = field(default_factory=dict)

    def frame(self, t: Tables) -> KFrame:
        parts = []
        for entry in self.tables:
            name, _, alias = entry.partition(" ")
            f = getattr(t, name)
            if name in self.early:
                own, key = self.early[name]
                f = f.where(own).early(key)
            parts.append(f.alias(alias) if alias else f)
        return reduce(KFrame.cross, parts).where(self.where).project(*self.select)

    def source(self) -> str:
        out = []
        for entry in self.tables:
            name, _, alias = entry.partition(" ")
            if alias:
                out.append(oracle.nation_as(alias))
            else:
                out.append(oracle.PARTSUPP if name == "partsupp" else name)
        own = [predicate for predicate, _ in self.early.values()]
        return f"{', '.join(out)} WHERE {' AND '.join([self.where, *own])}"

    def variables(self) -> list[str]:
        out = []
        for entry in self.tables:
            name, _, alias = entry.partition(" ")
            out.append(oracle.var(name, alias or None))
        return out


ADAPTED = {
    "q3": Adapted(
        ("l_orderkey", "o_orderdate"),
        ("customer", "orders", "lineitem"),
        "c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey "
        "AND o_orderdate < DATE '1998-03-15'",
        early={"lineitem": ("l_shipdate > DATE '1998-03-15'", "l_orderkey")},
    ),
    "q5": Adapted(
        ("n_name",),
        ("customer", "orders", "lineitem", "supplier", "nation", "region"),
        "c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey "
        "AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey "
        "AND n_regionkey = r_regionkey AND r_name = 'ASIA' "
        "AND o_orderdate >= DATE '1996-01-01' "
        "AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR",
        collapses=True,
    ),
    "q7": Adapted(
        ("n1_n_name", "n2_n_name"),
        ("supplier", "lineitem", "orders", "customer", "nation n1", "nation n2"),
        "s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey "
        "AND s_nationkey = n1_n_nationkey AND c_nationkey = n2_n_nationkey "
        "AND ((n1_n_name = 'NATION_1' AND n2_n_name = 'NATION_2') "
        "OR (n1_n_name = 'NATION_2' AND n2_n_name = 'NATION_1')) "
        "AND l_shipdate >= DATE '1995-01-01' AND l_shipdate <= DATE '1998-12-31'",
        collapses=True,
    ),
    "q10": Adapted(
        ("c_custkey", "c_name", "c_acctbal", "n_name"),
        ("customer", "orders", "lineitem", "nation"),
        "c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' "
        "AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH "
        "AND c_nationkey = n_nationkey",
        early={"lineitem": ("l_returnflag = 'R'", "l_orderkey")},
    ),
    "q11": Adapted(
        ("ps_partkey",),
        ("partsupp", "supplier", "nation"),
        "ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'",
    ),
    "q16": Adapted(
        ("p_brand", "p_type", "p_size"),
        ("partsupp", "part", "supplier"),
        "p_partkey = ps_partkey AND ps_suppkey = s_suppkey AND p_brand <> 'Brand#4' "
        "AND p_type NOT LIKE 'MED%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) "
        "AND s_name NOT LIKE '%7'",
    ),
    "q18": Adapted(
        ("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
        ("customer", "orders", "lineitem"),
        "c_custkey = o_custkey AND o_orderkey = l_orderkey",
        early={"lineitem": ("true", "l_orderkey")},
    ),
    "q19": Adapted(
        ("l_partkey", "p_partkey"),
        ("lineitem", "part"),
        "((p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 "
        "AND l_quantity <= 30 AND p_size BETWEEN 1 AND 25) "
        "OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 "
        "AND l_quantity <= 40 AND p_size BETWEEN 1 AND 30))",
    ),
}


def run(name: str, semiring: str, spark: SparkSession, path: str, strategy=Dedup.HOW_PROVENANCE) -> DataFrame:
    q = ADAPTED[name]
    f = q.frame(tables(spark, path, semiring)).dedup(strategy)
    if semiring == "B":
        return f.result()
    if semiring == "N":
        return counted(f)
    return f.stats(digest=True) if q.collapses else f.text()


for _name, _q in ADAPTED.items():
    _attrs, _source, _vars = ", ".join(_q.select), _q.source(), _q.variables()
    _symbolic = (
        (oracle.bx_stats, oracle.nx_stats) if _q.collapses else (oracle.bx_text, oracle.nx_text)
    )
    register(f"{_name}_bool", lambda s, d, n=_name: run(n, "B", s, d), oracle.rows(_attrs, _source))
    register(f"{_name}_nat", lambda s, d, n=_name: run(n, "N", s, d), oracle.nat(_attrs, _source))
    register(f"{_name}_bx", lambda s, d, n=_name: run(n, "B[X]", s, d), _symbolic[0](_attrs, _source, _vars))
    register(f"{_name}_nx", lambda s, d, n=_name: run(n, "N[X]", s, d), _symbolic[1](_attrs, _source, _vars))
    register(
        f"{_name}_nat_exists",
        lambda s, d, n=_name: run(n, "N", s, d, Dedup.EXISTENCE),
        f"SELECT DISTINCT {_attrs}, 1::BIGINT AS n FROM {_source}",
    )
    register(
        f"{_name}_bx_exists",
        lambda s, d, n=_name: ADAPTED[n].frame(tables(s, d, "B[X]")).dedup(Dedup.EXISTENCE).terms(),
        f"SELECT DISTINCT {_attrs}, 'True' AS term FROM {_source}",
    )
