"""Queries that go beyond the row form: aggregates under deletions, valuations, order, as-of and overlap joins, semi-joins, grouping
sets, circuits, and semirings of sets and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from provframe.frame import Dedup
from provframe.functions.structured import LINEAGE, WHY, cheapest, clearance, variables_of
from provframe.plans import oracle
from provframe.plans.algebra import MIN_PLUS, in_all
from provframe.plans.oracle import var
from provframe.plans.registry import as_bigint, counted, register, tables
from provframe.semirings import B, N
from provframe.session import tune
from provframe.sources.annotate import annotate

HOW = Dedup.HOW_PROVENANCE


def raw(spark, path, table, where=None):
    df = tune(spark).read.parquet(f"{path.rstrip('/')}/{table}.parquet")
    return df if where is None else df.where(where)


def deletions(spark, path):
    """Source rows that are gone: customers in debt and open orders."""
    return {
        "customer": raw(spark, path, "customer", "c_acctbal < 0").select("c_custkey"),
        "orders": raw(spark, path, "orders", "o_orderstatus = 'P'").select("o_orderkey"),
    }


LEFT_OVER = "customer, orders WHERE c_custkey = o_custkey AND c_acctbal >= 0 AND o_orderstatus <> 'P'"
BOUGHT = "customer, orders WHERE c_custkey = o_custkey"


def bought(t):
    return t.customer.join(t.orders, [("c_custkey", "o_custkey")])


# ---- aggregates that follow the provenance -----------------------------------------------

SALES = dict(items=("COUNT", "*"), total=("SUM", "o_orderkey"), mean=("AVG", "o_orderkey"), low=("MIN", "o_orderkey"), high=("MAX", "o_orderkey"))
SALES_SQL = (
    "count(*)::BIGINT AS items, sum(o_orderkey)::BIGINT AS total, sum(o_orderkey)::DOUBLE / count(o_orderkey) AS mean, "
    "min(o_orderkey) AS low, max(o_orderkey) AS high"
)


def sales(spark, path):
    return bought(tables(spark, path, "N[X]")).aggregate(["c_nationkey", "o_orderpriority"], **SALES)


register(
    "agg_elements_nx",  # the formal sums themselves: which values stand with which monomial
    lambda s, d: (lambda t: t.supplier.join(t.nation, [("s_nationkey", "n_nationkey")]).aggregate(["n_regionkey"], n=("COUNT", "*"), total=("SUM", "s_suppkey")))(
        tables(s, d, "N[X]")
    ).elements(),
    f"SELECT n_regionkey, {var('nation')} || '·' || {var('supplier')} AS term, count(*)::BIGINT AS n, sum(s_suppkey)::BIGINT AS total "
    "FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY ALL",
)
register(
    "agg_deleted_nx",  # all values again after source rows are gone, from the annotated relation alone
    lambda s, d: sales(s, d).under(deletions(s, d)).support(),
    f"SELECT c_nationkey, o_orderpriority, {SALES_SQL} FROM {LEFT_OVER} GROUP BY ALL",
)
register(
    "agg_having_nx",  # HAVING is decided under the deletion
    lambda s, d: sales(s, d).having("items > 3 AND low % 2 = 1").under(deletions(s, d)).support(),
    f"SELECT c_nationkey, o_orderpriority, {SALES_SQL} FROM {LEFT_OVER} GROUP BY ALL HAVING items > 3 AND low % 2 = 1",
)
register(
    "agg_multiplicity_nx",  # source rows that count none, once or twice
    lambda s, d: sales(s, d).under(multiplicities={"orders": raw(s, d, "orders").selectExpr("o_orderkey", "o_orderkey % 3 AS n")}).support(),
    "SELECT c_nationkey, o_orderpriority, sum(n)::BIGINT AS items, sum(n * o_orderkey)::BIGINT AS total, "
    "sum(n * o_orderkey)::DOUBLE / sum(n) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high "
    f"FROM (SELECT c_nationkey, o_orderpriority, o_orderkey, o_orderkey % 3 AS n FROM {BOUGHT}) WHERE n > 0 GROUP BY ALL",
)
register(
    "agg_deleted_bx",  # over the distinct tuples that are still there
    lambda s, d: bought(tables(s, d, "B[X]"))
    .project("c_mktsegment", "o_orderpriority", "c_nationkey")
    .aggregate(["c_mktsegment"], pairs=("COUNT", "*"), total=("SUM", "c_nationkey"), top=("MAX", "c_nationkey"))
    .under(deletions(s, d))
    .support(),
    "SELECT c_mktsegment, count(*)::BIGINT AS pairs, sum(c_nationkey)::BIGINT AS total, max(c_nationkey) AS top "
    f"FROM (SELECT DISTINCT c_mktsegment, o_orderpriority, c_nationkey FROM {LEFT_OVER}) GROUP BY c_mktsegment",
)
register(
    "agg_contributions_nx",  # every group without any one of its source rows
    lambda s, d: bought(tables(s, d, "N[X]")).aggregate(["c_nationkey"], items=("COUNT", "*"), total=("SUM", "o_orderkey")).contributions(),
    f"WITH j AS (SELECT c_nationkey, o_orderkey, {var('customer')} AS c, {var('orders')} AS o FROM {BOUGHT}), "
    "g AS (SELECT c_nationkey, count(*) AS items, sum(o_orderkey) AS total FROM j GROUP BY c_nationkey), "
    "v AS (SELECT c_nationkey, v AS variable, count(*) AS items, sum(o_orderkey) AS total FROM "
    "(SELECT c_nationkey, o_orderkey, unnest([c, o]) AS v FROM j) GROUP BY ALL) "
    "SELECT c_nationkey, variable, (g.items - v.items)::BIGINT AS items, (g.total - v.total)::BIGINT AS total FROM g JOIN v USING (c_nationkey)",
)
register(
    "agg_contributions_bx",  # a tuple goes with a row that all its clauses need
    lambda s, d: tables(s, d, "B[X]").orders.project("o_orderpriority", "o_custkey").aggregate(["o_orderpriority"], customers=("COUNT", "*")).contributions(),
    f"WITH p AS (SELECT o_orderpriority, o_custkey, min({var('orders')}) AS v, count(*) AS n FROM orders GROUP BY ALL), "
    "g AS (SELECT o_orderpriority, count(*) AS customers FROM p GROUP BY ALL) "
    "SELECT o_orderpriority, v AS variable, (customers - 1)::BIGINT AS customers FROM p JOIN g USING (o_orderpriority) WHERE n = 1",
)

# ---- valuations ------------------------------------------------------------------------

register(
    "without_bx",
    lambda s, d: bought(tables(s, d, "B[X]")).project("c_nationkey", "o_orderpriority").without(deletions(s, d)).stats(digest=True),
    oracle.bx_stats("c_nationkey, o_orderpriority", LEFT_OVER, [var("customer"), var("orders")]),
)
register(
    "specialise_nat",
    lambda s, d: counted(
        bought(tables(s, d, "N[X]"))
        .project("c_nationkey")
        .specialise(N, {"customer": raw(s, d, "customer").selectExpr("c_custkey", "c_custkey % 2 AS n"), "orders": raw(s, d, "orders").selectExpr("o_orderkey", "o_orderkey % 3 AS n")})
    ),
    f"SELECT c_nationkey, sum((c_custkey % 2) * (o_orderkey % 3))::BIGINT AS n FROM {BOUGHT} GROUP BY c_nationkey HAVING n > 0",
)
register(
    "specialise_min_plus",
    lambda s, d: bought(tables(s, d, "N[X]"))
    .project("c_nationkey")
    .specialise(
        MIN_PLUS,
        {"customer": raw(s, d, "customer").selectExpr("c_custkey", "CAST(c_custkey AS DOUBLE) AS cost"), "orders": raw(s, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS DOUBLE) AS cost")},
    )
    .result(),
    f"SELECT c_nationkey, min(c_custkey + o_orderkey)::DOUBLE AS n FROM {BOUGHT} GROUP BY c_nationkey",
)
register(
    "specialise_clearance_bx",  # who may see that a nation has customers with orders of a kind
    lambda s, d: bought(tables(s, d, "B[X]"))
    .project("c_nationkey", "o_orderpriority")
    .specialise(clearance(9), {"customer": raw(s, d, "customer").selectExpr("c_custkey", "CAST(c_custkey % 10 AS INT) AS level"), "orders": raw(s, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 8 AS INT) AS level")})
    .result(),
    "SELECT c_nationkey, o_orderpriority, min(greatest(c_custkey % 10, o_orderkey % 8))::INTEGER AS n "
    f"FROM {BOUGHT} GROUP BY ALL HAVING n < 9",
)

# ---- order -----------------------------------------------------------------------------

_RANKS = (
    "rank() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey DESC) AS rank, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey DESC) AS dense, "
    "(sum(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey DESC))::BIGINT AS lines"
)


def ranked(t):
    return t.lineitem.project("l_returnflag", "l_suppkey", "l_linenumber").ranked(["l_returnflag"], [("l_suppkey", "desc")], dense="dense", running={"lines": "l_linenumber"})


register(
    "rank_nat",  # ranks and running sums of the expanded rows
    lambda s, d: counted(ranked(tables(s, d, "N"))),
    f"SELECT *, count(*)::BIGINT AS n FROM (SELECT l_returnflag, l_suppkey, l_linenumber, {_RANKS} FROM lineitem) GROUP BY ALL",
)
register(
    "rank_bool",
    lambda s, d: ranked(tables(s, d, "B")).result(),
    f"SELECT l_returnflag, l_suppkey, l_linenumber, {_RANKS} FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem)",
)
register(
    "rank_bx",  # over the support, with the annotations
    lambda s, d: ranked(tables(s, d, "B[X]")).stats(digest=True),
    oracle.bx_stats(
        "l_returnflag, l_suppkey, l_linenumber, rank, dense, lines",
        f"lineitem JOIN (SELECT l_returnflag, l_suppkey, l_linenumber, {_RANKS} FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem)) "
        "USING (l_returnflag, l_suppkey, l_linenumber)",
        [var("lineitem")],
    ),
)
register(
    "rank_all_nat",  # one order over the whole relation, no key
    lambda s, d: counted(tables(s, d, "N").orders.project("o_orderdate", "o_orderpriority").ranked([], ["o_orderdate"])),
    "SELECT o_orderdate, o_orderpriority, rank, count(*)::BIGINT AS n FROM "
    "(SELECT o_orderdate, o_orderpriority, rank() OVER (ORDER BY o_orderdate) AS rank FROM orders) GROUP BY ALL",
)
_TOP = "row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber DESC, l_suppkey)"
register(
    "top_nat",  # expanded rows: the last tuple may be cut
    lambda s, d: counted(tables(s, d, "N").lineitem.project("l_returnflag", "l_suppkey", "l_linenumber").top(50, ["l_returnflag"], [("l_linenumber", "desc")])),
    f"SELECT l_returnflag, l_suppkey, l_linenumber, count(*)::BIGINT AS n FROM (SELECT *, {_TOP} AS place FROM lineitem) WHERE place <= 50 GROUP BY ALL",
)
register(
    "top_bx",
    lambda s, d: tables(s, d, "B[X]").lineitem.project("l_returnflag", "l_suppkey", "l_linenumber").top(50, ["l_returnflag"], [("l_linenumber", "desc")]).text(),
    oracle.bx_text(
        "l_returnflag, l_suppkey, l_linenumber",
        f"lineitem JOIN (SELECT l_returnflag, l_suppkey, l_linenumber, {_TOP} AS place FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem)) "
        "USING (l_returnflag, l_suppkey, l_linenumber) WHERE place <= 50",
        [var("lineitem")],
    ),
)

register(
    "text_spread_bx",  # terms ordered in ranges
    lambda s, d: tables(s, d, "B[X]").lineitem.project("l_returnflag").text(max_terms=1000, spread=True),
    (
        "SELECT l_returnflag, part, string_agg(t, ' ∨ ' ORDER BY t) AS annotation FROM (SELECT *, ((row_number() OVER (PARTITION BY l_returnflag ORDER BY t) - 1) // 1000)::INTEGER AS part "
        f"FROM (SELECT DISTINCT l_returnflag, '(' || {var('lineitem')} || ')' AS t FROM lineitem)) GROUP BY ALL"
    ),
)

# ---- as-of and overlap joins, semi-joins, grouping sets -------------------------------------

in_all(
    "asof",  # each urgent order with the latest other order of its customer up to then
    lambda t: t.orders.where("o_orderpriority = '1-URGENT'").alias("a").asof(
        t.orders.where("o_orderpriority <> '1-URGENT'").alias("b"), [("a_o_custkey", "b_o_custkey")], "a_o_orderdate", "b_o_orderdate"
    ).project("a_o_orderstatus", "b_o_orderpriority"),
    "a.o_orderstatus AS a_o_orderstatus, b.o_orderpriority AS b_o_orderpriority",
    "orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = '1-URGENT' AND b.o_orderpriority <> '1-URGENT' "
    "JOIN (SELECT x.o_orderkey AS k, max(y.o_orderdate) AS t FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND y.o_orderdate <= x.o_orderdate "
    "WHERE x.o_orderpriority = '1-URGENT' AND y.o_orderpriority <> '1-URGENT' GROUP BY x.o_orderkey) m ON m.k = a.o_orderkey AND b.o_orderdate = m.t",
    ["'orders_' || a.o_orderkey", "'orders_' || b.o_orderkey"], stats=True,
)
in_all(
    "asof_all",  # one stream without any key
    lambda t: t.supplier.asof(t.customer, None, "s_acctbal", "c_acctbal").project("c_mktsegment", "s_nationkey"),
    "c_mktsegment, s_nationkey",
    "supplier JOIN customer ON c_acctbal = (SELECT max(c2.c_acctbal) FROM customer c2 WHERE c2.c_acctbal <= s_acctbal)",
    [var("supplier"), var("customer")],
)
in_all(
    "join_overlap",  # intervals from 1 to 2,048 long on one side, from 1 to 512 on the other
    lambda t: t.supplier.join(
        t.customer,
        overlaps=(("s_acctbal - power(2, s_suppkey % 12)", "s_acctbal"), ("c_acctbal", "c_acctbal + power(2, c_custkey % 10)")),
    ).project("s_nationkey", "c_mktsegment"),
    "s_nationkey, c_mktsegment",
    "supplier, customer WHERE s_acctbal - power(2, s_suppkey % 12) <= c_acctbal + power(2, c_custkey % 10) AND c_acctbal <= s_acctbal",
    [var("supplier"), var("customer")], stats=True,
)
_HAS_LARGE = "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"
in_all(
    "semi",
    lambda t: t.customer.semi(t.orders.where("o_totalprice > 300000"), [("c_custkey", "o_custkey")]).project("c_nationkey"),
    "c_nationkey", f"customer WHERE {_HAS_LARGE}", [var("customer")],
)
in_all(
    "semi_how",  # the annotation says which orders make the EXISTS true
    lambda t: t.customer.semi(t.orders.where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], HOW).project("c_nationkey"),
    "c_nationkey", "customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 300000", [var("customer"), var("orders")],
)
in_all(
    "not_in",
    lambda t: t.customer.not_in("c_custkey", t.orders.where("o_totalprice > 300000"), "o_custkey").project("c_nationkey"),
    "c_nationkey", "customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", [var("customer")],
)
_SETS = (
    "(SELECT c_nationkey AS nation, c_mktsegment AS segment, 0::BIGINT AS grouping, * FROM customer UNION ALL "
    "SELECT c_nationkey, NULL, 1, * FROM customer UNION ALL SELECT NULL, c_mktsegment, 2, * FROM customer UNION ALL SELECT NULL, NULL, 3, * FROM customer)"
)
in_all(
    "grouping_sets",
    lambda t: t.customer.rename({"c_nationkey": "nation", "c_mktsegment": "segment"}).grouping_sets([["nation", "segment"], ["nation"], ["segment"], []]),
    "nation, segment, grouping", _SETS, [var("customer")], stats=True,
)

# ---- circuits ----------------------------------------------------------------------------


def chain(t):
    """Customers, orders and line items by nation, added up after each join."""
    orders = t.orders.circuit().join(t.lineitem.circuit(), [("o_orderkey", "l_orderkey")]).project("o_custkey", "o_orderpriority")
    return t.customer.circuit().join(orders, [("c_custkey", "o_custkey")]).project("c_nationkey", "o_orderpriority")


register(
    "circuit_chain",
    lambda s, d: chain(tables(s, d, "N[X]")).derivations(),
    "SELECT c_nationkey, o_orderpriority, count(*)::BIGINT AS terms, (3 * count(*))::BIGINT AS degree "
    "FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL",
)
register(
    "circuit_wide_product",  # as many terms as pairs of orders and line items, in work for their sum
    lambda s, d: (lambda t: t.orders.circuit().project("o_orderstatus").cross(t.lineitem.circuit().project("l_returnflag")))(tables(s, d, "N[X]")).derivations(),
    "SELECT o_orderstatus, l_returnflag, (a.n * b.n)::BIGINT AS terms, (2 * a.n * b.n)::BIGINT AS degree FROM "
    "(SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) a, (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) b",
)
register(
    "circuit_wide_product_size",
    lambda s, d: (lambda t: t.orders.circuit().project("o_orderstatus").cross(t.lineitem.circuit().project("l_returnflag")))(tables(s, d, "N[X]")).size(),
    "SELECT (a + b + a * b)::BIGINT AS gates, (m + n + 2 * a * b)::BIGINT AS edges FROM (SELECT count(DISTINCT o_orderstatus) AS a, count(*) AS m FROM orders), "
    "(SELECT count(DISTINCT l_returnflag) AS b, count(*) AS n FROM lineitem)",
)
register(
    "circuit_multiplicity",
    lambda s, d: as_bigint(chain(tables(s, d, "N[X]")).evaluate(N, {"orders": raw(s, d, "orders").selectExpr("o_orderkey", "o_orderkey % 3 AS n")}).result(), "n"),
    "SELECT c_nationkey, o_orderpriority, sum(o_orderkey % 3)::BIGINT AS n "
    "FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL HAVING n > 0",
)
register(
    "circuit_cheapest",
    lambda s, d: chain(tables(s, d, "N[X]")).evaluate(MIN_PLUS, {"lineitem": raw(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice AS cost")}).result(),
    "SELECT c_nationkey, o_orderpriority, min(l_extendedprice) AS n FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL",
)
register(
    "circuit_minus_deleted",  # nations with customers but no suppliers, once some of either are gone
    lambda s, d: (
        lambda t: t.customer.circuit().project("c_nationkey", "c_mktsegment").rename({"c_nationkey": "nation"}).project("nation")
        .minus(t.supplier.circuit().rename({"s_nationkey": "nation"}).project("nation"))
    )(tables(s, d, "B[X]"))
    .evaluate(B, deleted={"customer": raw(s, d, "customer", "c_acctbal < 0").select("c_custkey"), "supplier": raw(s, d, "supplier", "s_suppkey % 3 <> 0").select("s_suppkey")})
    .result(),
    "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal >= 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0",
)
register(
    "circuit_anti_deleted",  # segments and nations of customers who have no order left
    lambda s, d: (lambda t: t.customer.circuit().anti(t.orders.circuit(), [("c_custkey", "o_custkey")]).project("c_mktsegment", "c_nationkey"))(tables(s, d, "B[X]"))
    .evaluate(B, deleted={"orders": raw(s, d, "orders", "o_totalprice < 250000").select("o_orderkey")})
    .result(),
    "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 250000)",
)

# ---- semirings of sets, levels and lists ---------------------------------------------------


def with_elements(spark, path, semiring, table, keep, element):
    return annotate(raw(spark, path, table).withColumn("w", element), semiring, weight="w", keep=keep)


def by_nation(spark, path, semiring, of_customer, of_order):
    customers = with_elements(spark, path, semiring, "customer", ["c_custkey", "c_nationkey"], of_customer)
    orders = with_elements(spark, path, semiring, "orders", ["o_custkey", "o_orderpriority"], of_order)
    return customers.join(orders, [("c_custkey", "o_custkey")]).project("c_nationkey", "o_orderpriority").result()


def _named(spark, path, semiring):
    name = lambda table, key: variables_of(F.concat(F.lit(f"{table}_"), F.col(key)))
    return by_nation(spark, path, semiring, name("customer", "c_custkey"), name("orders", "o_orderkey"))


def _joined(df, glue):
    """Sets as text, which every engine sorts and compares alike."""
    sets = F.transform("n", lambda x: F.array_join(x, glue))
    return df.withColumn("n", F.array_join(F.array_sort(sets), " | "))


register(
    "why_sets",
    lambda s, d: _joined(_named(s, d, WHY), " "),
    f"SELECT c_nationkey, o_orderpriority, string_agg({var('customer')} || ' ' || {var('orders')}, ' | ' ORDER BY {var('customer')} || ' ' || {var('orders')}) AS n "
    f"FROM {BOUGHT} GROUP BY ALL",
)
register(
    "lineage",
    lambda s, d: _joined(_named(s, d, LINEAGE), " "),
    f"SELECT c_nationkey, o_orderpriority, string_agg(v, ' ' ORDER BY v) AS n FROM (SELECT DISTINCT c_nationkey, o_orderpriority, unnest([{var('customer')}, {var('orders')}]) AS v "
    f"FROM {BOUGHT}) GROUP BY ALL",
)
register(
    "clearance",
    lambda s, d: by_nation(s, d, clearance(9), F.expr("CAST(c_custkey % 10 AS INT)"), F.expr("CAST(o_orderkey % 8 AS INT)")),
    f"SELECT c_nationkey, o_orderpriority, min(greatest(c_custkey % 10, o_orderkey % 8))::INTEGER AS n FROM {BOUGHT} AND c_custkey % 10 < 9 GROUP BY ALL",
)
register(
    "cheapest_three",
    lambda s, d: by_nation(s, d, cheapest(3), F.expr("array(CAST(c_custkey AS DOUBLE))"), F.expr("array(CAST(o_orderkey AS DOUBLE))")).withColumn("n", F.array_join(F.transform("n", lambda x: x.cast("bigint").cast("string")), " ")),
    "SELECT c_nationkey, o_orderpriority, string_agg(cost::BIGINT::VARCHAR, ' ' ORDER BY cost) AS n FROM (SELECT c_nationkey, o_orderpriority, c_custkey + o_orderkey AS cost, "
    f"row_number() OVER (PARTITION BY c_nationkey, o_orderpriority ORDER BY c_custkey + o_orderkey) AS place FROM {BOUGHT}) WHERE place <= 3 GROUP BY ALL",
)
