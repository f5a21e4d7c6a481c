"""Selection with every kind of predicate, over whole tables, counting in N."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from provframe.plans import oracle
from provframe.plans.oracle import var
from provframe.plans.registry import counted, register, tables


@dataclass(frozen=True)
class Selection:
    table: str
    where: str
    select: str


# One SQL text serves Spark and the comparison.
SELECTIONS = {
    "sel_eq": Selection("orders", "o_orderstatus = 'F'", "o_orderpriority"),
    "sel_ne": Selection("part", "p_brand <> 'Brand#1'", "p_type"),
    "sel_lt": Selection("lineitem", "l_quantity < 10", "l_returnflag"),
    "sel_le": Selection("lineitem", "l_quantity <= 10", "l_returnflag"),
    "sel_gt": Selection("lineitem", "l_extendedprice > 50000", "l_linestatus"),
    "sel_ge": Selection("customer", "c_acctbal >= 0", "c_mktsegment"),
    "sel_value_attr": Selection("part", "25 <= p_size", "p_type"),
    "sel_attr_attr": Selection("lineitem", "l_orderkey > l_partkey", "l_returnflag"),
    "sel_value_value": Selection("supplier", "2 > 1", "s_nationkey"),
    "sel_and": Selection("orders", "o_orderstatus = 'O' AND o_totalprice > 100000", "o_orderpriority"),
    "sel_or": Selection("orders", "o_orderstatus = 'O' OR o_totalprice > 400000", "o_orderpriority"),
    "sel_not": Selection("orders", "NOT o_orderstatus = 'O'", "o_orderpriority"),
    "sel_nested": Selection(
        "orders",
        "NOT (o_orderstatus = 'O' OR o_orderpriority = '5-LOW') AND (o_totalprice < 50000 OR o_totalprice > 300000)",
        "o_orderpriority, o_orderstatus",
    ),
    "sel_precedence": Selection(
        "orders",
        "o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_totalprice > 300000",
        "o_orderstatus",
    ),
    "sel_in": Selection("part", "p_size IN (49, 14, 23, 45, 19, 3, 36, 9)", "p_brand"),
    "sel_not_in": Selection("part", "p_size NOT IN (49, 14, 23, 45, 19, 3, 36, 9)", "p_brand"),
    "sel_in_text": Selection("customer", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_mktsegment"),
    "sel_like": Selection("part", "p_type LIKE 'MED%'", "p_brand, p_type"),
    "sel_not_like": Selection("part", "p_type NOT LIKE 'MED%'", "p_brand"),
    "sel_like_one": Selection("supplier", "s_name LIKE 'Supplier#_______1_'", "s_nationkey"),
    "sel_between": Selection("part", "p_size BETWEEN 5 AND 14", "p_type"),
    "sel_between_columns": Selection(
        "lineitem", "l_suppkey BETWEEN l_linenumber AND l_partkey", "l_returnflag"
    ),
    "sel_modulo": Selection("lineitem", "l_orderkey % 7 = l_linenumber % 7", "l_returnflag"),
    "sel_modulo_column": Selection("lineitem", "l_partkey % l_linenumber = 0", "l_linenumber"),
    "sel_modulo_value": Selection("lineitem", "60 % l_linenumber = 0", "l_linenumber"),
    "sel_date": Selection("orders", "o_orderdate < DATE '1996-07-01'", "o_orderstatus"),
    "sel_date_interval": Selection(
        "orders",
        "o_orderdate >= DATE '1996-01-31' + INTERVAL '1' MONTH "
        "AND o_orderdate < DATE '1996-02-29' + INTERVAL '1' YEAR - INTERVAL '10' DAY",
        "o_orderdate",
    ),
    "sel_coerce_date": Selection("orders", "o_orderdate >= '1999-01-01'", "o_orderstatus"),
    "sel_coerce_number": Selection("part", "p_size = '10'", "p_brand"),
    "sel_coerce_decimal": Selection(
        "lineitem", "CAST(l_discount AS DECIMAL(15,2)) >= 0.05 AND l_quantity > '40'", "l_returnflag"
    ),
    "sel_events": Selection("events", "event_type = 'click' AND value > 10", "user_id"),
    "sel_documents": Selection("documents", "lang <> 'fr' AND text LIKE '%the%'", "lang, source"),
    "sel_pages": Selection("pages", "url LIKE 'http://%' AND html LIKE '%<p>%'", "page_id"),
}


def _columns(select: str) -> list[str]:
    return [c.strip() for c in select.split(",")]


def _run(q: Selection, spark, path):
    t = tables(spark, path, "N")
    if q.table in ("events", "documents", "pages"):
        from provframe.semirings import N
        from provframe.sources.annotate import annotate

        frame = annotate(spark.read.parquet(f"{path.rstrip('/')}/{q.table}.parquet"), N)
    else:
        frame = getattr(t, q.table)
    return counted(frame.where(q.where).project(*_columns(q.select)))


for _name, _q in SELECTIONS.items():
    register(
        _name,
        lambda s, d, q=_q: _run(q, s, d),
        oracle.nat(_q.select, f"{_q.table} WHERE {_q.where}"),
    )


def sel_like_column(spark, path):
    """The pattern is a column."""
    part = tables(spark, path, "N").part
    pattern = F.concat(F.lower(F.substring("p_type", 1, 1)), F.lit("%")).alias("pattern")
    return counted(part.project("p_name", "p_type", pattern).where("p_name LIKE pattern").project("p_type"))


register(
    "sel_like_column",
    sel_like_column,
    oracle.nat("p_type", "part WHERE p_name LIKE lower(substr(p_type, 1, 1)) || '%'"),
)


def sel_is_null(spark, path):
    """Customers without a large finished order."""
    t = tables(spark, path, "N")
    large = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 300000")
    joined = t.customer.left_outer(large, [("c_custkey", "o_custkey")])
    return counted(joined.where("o_orderkey IS NULL").project("c_nationkey"))


register(
    "sel_is_null",
    sel_is_null,
    oracle.nat(
        "c_nationkey",
        "customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' "
        "AND o_totalprice > 300000 WHERE o_orderkey IS NULL",
    ),
)


def sel_null_safe(spark, path):
    """Three-valued ``=`` drops NULLs, ``<=>`` pairs them; projection keeps them as one value."""
    t = tables(spark, path, "N")
    small = F.expr("nullif(l_linenumber, 1)").alias("a")
    flag = F.expr("nullif(CAST(l_quantity AS INT), 1)").alias("b")
    return counted(t.lineitem.project(small, flag).where("a <=> b").project("a"))


register(
    "sel_null_safe",
    sel_null_safe,
    "SELECT a, count(*)::BIGINT AS n FROM (SELECT nullif(l_linenumber, 1) AS a, "
    "nullif(CAST(l_quantity AS INT), 1) AS b FROM lineitem) "
    "WHERE a IS NOT DISTINCT FROM b GROUP BY a",
)


def sel_python(spark, path):
    """A predicate written in Python."""
    part = tables(spark, path, "N").part
    return counted(
        part.where(lambda name: name.str[::-1] > name, columns=["p_name"], vectorized=True).project("p_type")
    )


register(
    "sel_python", sel_python, oracle.nat("p_type", "part WHERE reverse(p_name) > p_name")
)

for _sr, _tag, _make in (("B[X]", "bx", oracle.bx_text), ("N[X]", "nx", oracle.nx_text)):
    register(
        f"sel_{_tag}",
        lambda s, d, sr=_sr: tables(s, d, sr)
        .customer.where("c_acctbal BETWEEN 0 AND 5000")
        .project("c_nationkey", "c_mktsegment")
        .text(),
        _make(
            "c_nationkey, c_mktsegment", "customer WHERE c_acctbal BETWEEN 0 AND 5000", [var("customer")]
        ),
    )
register(
    "sel_bool",
    lambda s, d: tables(s, d, "B").customer.where("c_acctbal < 0").project("c_nationkey", "c_mktsegment").result(),
    oracle.rows("c_nationkey, c_mktsegment", "customer WHERE c_acctbal < 0"),
)
