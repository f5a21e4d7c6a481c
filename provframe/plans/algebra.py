"""One query or more per operator: projection, product, join, sum, deduplication,
absorption, annotation access, loading, and the further algebra operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from provframe.frame import Dedup
from provframe.plans import oracle
from provframe.plans.oracle import var
from provframe.plans.registry import as_bigint, counted, register, tables
from provframe.semirings import N, Semiring, Weight
from provframe.session import scratch_folder, tune
from provframe.sources.annotate import annotate
from provframe.sources.tables import load_tables, read_table
from provframe.sources.typed_csv import load_csv, write_tables

HOW, EXISTS = Dedup.HOW_PROVENANCE, Dedup.EXISTENCE


def in_all(name, build, attrs, source, variables, *, stats=False, only=("B", "N", "B[X]", "N[X]")):
    """Register one plan in several semirings."""
    for sr in only:
        if sr == "B":
            tag, sql = "bool", oracle.rows(attrs, source)
            query = lambda s, d: build(tables(s, d, "B")).result()
        elif sr == "N":
            tag, sql = "nat", oracle.nat(attrs, source)
            query = lambda s, d: counted(build(tables(s, d, "N")))
        else:
            tag = "bx" if sr == "B[X]" else "nx"
            make = getattr(oracle, f"{tag}_{'stats' if stats else 'text'}")
            sql = make(attrs, source, variables)
            if stats:
                query = lambda s, d, sr=sr: build(tables(s, d, sr)).stats(digest=True)
            else:
                query = lambda s, d, sr=sr: build(tables(s, d, sr)).text()
        register(f"{name}_{tag}", query, sql)


# ---- projection ------------------------------------------------------------------------

in_all(
    "proj",
    lambda t: t.customer.project("c_mktsegment", "c_nationkey"),
    "c_mktsegment, c_nationkey", "customer", [var("customer")],
)
in_all(
    "proj_collapse",
    lambda t: t.lineitem.project("l_returnflag", "l_linestatus"),
    "l_returnflag, l_linestatus", "lineitem", [var("lineitem")], stats=True,
)
in_all(
    "proj_star",  # no projection: all columns, equal rows added up
    lambda t: t.part,
    "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice", "part", [var("part")],
)

# ---- product and join ------------------------------------------------------------------

in_all(
    "cross",
    lambda t: t.supplier.project("s_nationkey").cross(t.region.project("r_name")),
    "s_nationkey, r_name", "supplier, region", [var("supplier"), var("region")],
)
in_all(
    "join_equi",
    lambda t: t.customer.cross(t.nation).where("c_nationkey = n_nationkey").project("n_name", "c_mktsegment"),
    "n_name, c_mktsegment", "customer, nation WHERE c_nationkey = n_nationkey",
    [var("customer"), var("nation")],
)
in_all(
    "join_on",
    lambda t: t.orders.join(t.customer, [("o_custkey", "c_custkey")]).project("c_nationkey", "o_orderpriority"),
    "c_nationkey, o_orderpriority", "orders, customer WHERE o_custkey = c_custkey",
    [var("orders"), var("customer")], stats=True,
)
in_all(
    "join_theta",
    lambda t: t.lineitem.cross(t.part)
    .where("p_partkey = l_partkey AND (l_quantity < p_size OR p_type LIKE 'M%')")
    .project("p_type", "l_returnflag"),
    "p_type, l_returnflag",
    "lineitem, part WHERE p_partkey = l_partkey AND (l_quantity < p_size OR p_type LIKE 'M%')",
    [var("lineitem"), var("part")], stats=True,
)
in_all(
    "join_range",  # no equality at all: an equi-join on bins of the value
    lambda t: t.supplier.join(
        t.nation, between=("s_acctbal", "n_nationkey * 300", "n_nationkey * 300 + 1000", 1000)
    ).project("n_name"),
    "n_name",
    "supplier, nation WHERE s_acctbal BETWEEN n_nationkey * 300 AND n_nationkey * 300 + 1000",
    [var("supplier"), var("nation")],
)
in_all(
    "join_range_days",  # both sides grow: line items shipped within two days of an order and worth a fifth of it
    lambda t: t.lineitem.join(
        t.orders,
        between=("unix_date(DATE(l_shipdate))", "unix_date(DATE(o_orderdate))", "unix_date(DATE(o_orderdate)) + 2"),
        above=("l_extendedprice", "o_totalprice / 5"),
    ).project("l_returnflag", "o_orderpriority"),
    "l_returnflag, o_orderpriority",
    "lineitem, orders WHERE l_extendedprice > o_totalprice / 5 "
    "AND l_shipdate::DATE BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 2",
    [var("lineitem"), var("orders")], stats=True,
)
in_all(
    "cross_chain",  # neighbours in the chain are not connected; Catalyst reorders
    lambda t: t.supplier.cross(t.customer)
    .cross(t.lineitem)
    .cross(t.orders)
    .where("l_suppkey = s_suppkey AND o_custkey = c_custkey AND l_orderkey = o_orderkey")
    .project("s_nationkey", "c_nationkey"),
    "s_nationkey, c_nationkey",
    "supplier, customer, lineitem, orders "
    "WHERE l_suppkey = s_suppkey AND o_custkey = c_custkey AND l_orderkey = o_orderkey",
    [var("supplier"), var("customer"), var("lineitem"), var("orders")], stats=True,
)


def self_join(t):
    """Each supplier with itself: in N[X] its variable squared, in B[X] once."""
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.cross(b).where("a_s_suppkey = b_s_suppkey").project("a_s_nationkey")


_TWICE = f"(SELECT s_nationkey AS a_s_nationkey, {var('supplier')} AS v FROM supplier)"
in_all("selfjoin", self_join, "a_s_nationkey", _TWICE, ["v", "v"])


def neighbours(t):
    """Suppliers with their own nation and every nation of the same region."""
    n1, n2 = t.nation.alias("n1"), t.nation.alias("n2")
    return (
        t.supplier.cross(n1)
        .where("s_nationkey = n1_n_nationkey")
        .cross(n2)
        .where("n1_n_regionkey = n2_n_regionkey")
        .project("n1_n_regionkey")
    )


_NEIGHBOURS = (
    f"supplier, {oracle.nation_as('n1')}, {oracle.nation_as('n2')} "
    "WHERE s_nationkey = n1_n_nationkey AND n1_n_regionkey = n2_n_regionkey"
)
_NEIGHBOUR_VARS = [var("supplier"), var("nation", "n1"), var("nation", "n2")]
in_all(
    "selfjoin_nation", neighbours, "n1_n_regionkey", _NEIGHBOURS, _NEIGHBOUR_VARS,
    only=("B", "N", "N[X]"),
)
# In B[X] {supplier, own nation} is inside every clause naming a second nation too.
register(
    "selfjoin_nation_bx",
    lambda s, d: neighbours(tables(s, d, "B[X]")).text(),
    oracle.bx_text(
        "n_regionkey AS n1_n_regionkey",
        "supplier, nation WHERE s_nationkey = n_nationkey",
        [var("supplier"), var("nation")],
    ),
)

# ---- multiset sum and union --------------------------------------------------------------


def nation_keys(t):
    return t.customer.project(F.col("c_nationkey").alias("nationkey")).msum(
        t.supplier.project(F.col("s_nationkey").alias("nationkey"))
    )


_KEYS = (
    f"(SELECT c_nationkey AS nationkey, {var('customer')} AS v FROM customer UNION ALL "
    f"SELECT s_nationkey AS nationkey, {var('supplier')} AS v FROM supplier)"
)
in_all("msum", nation_keys, "nationkey", _KEYS, ["v"])


def doubled(t):
    r = t.orders.project("o_orderpriority")
    return r.msum(r)


_DOUBLED = "(SELECT * FROM orders UNION ALL SELECT * FROM orders)"
in_all("msum_self", doubled, "o_orderpriority", _DOUBLED, [var("orders")], stats=True)

register(
    "union_distinct",
    lambda s, d: tables(s, d, "B")
    .customer.project(F.col("c_nationkey").alias("nationkey"))
    .union(tables(s, d, "B").supplier.project(F.col("s_nationkey").alias("nationkey")))
    .result(),
    "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
)
register(
    "union_distinct_bx_how",
    lambda s, d: nation_keys(tables(s, d, "B[X]")).dedup(HOW).text(),
    oracle.bx_text("nationkey", _KEYS, ["v"]),
)


def union_chain(t):
    """UNION chains from the left; the last branch is UNION ALL."""
    key = lambda f, c: f.project(F.col(c).alias("k"))
    return (
        key(t.customer, "c_nationkey")
        .union(key(t.supplier, "s_nationkey"))
        .union_all(key(t.nation, "n_nationkey"))
    )


register(
    "union_chain_nat",
    lambda s, d: counted(union_chain(tables(s, d, "N"))),
    "SELECT k, count(*)::BIGINT AS n FROM (SELECT * FROM (SELECT c_nationkey AS k FROM customer "
    "UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey FROM nation) GROUP BY k",
)

# ---- deduplication -------------------------------------------------------------------------

for _sr, _tag, _one in (("B[X]", "bx", "True"), ("N[X]", "nx", "1")):
    register(
        f"dedup_exists_{_tag}",
        lambda s, d, sr=_sr: tables(s, d, sr).orders.project("o_custkey").dedup(EXISTS).text(),
        f"SELECT DISTINCT o_custkey, 0::INTEGER AS part, '{_one}' AS annotation FROM orders",
    )
register(
    "dedup_exists_nat",
    lambda s, d: counted(tables(s, d, "N").orders.project("o_custkey").dedup(EXISTS)),
    "SELECT DISTINCT o_custkey, 1::BIGINT AS n FROM orders",
)
in_all(
    "dedup_how", lambda t: t.orders.project("o_custkey").dedup(HOW), "o_custkey", "orders", [var("orders")]
)

# ---- absorption ------------------------------------------------------------------------------


def mixed_depth(t):
    """Clauses of one and two variables: an order alone, or with its customer.

    A finished order needs nothing else, so it absorbs its longer clause.
    """
    alone = t.orders.where("o_orderstatus = 'F'").project("o_custkey")
    with_customer = t.orders.join(t.customer, [("o_custkey", "c_custkey")]).project("o_custkey")
    return alone.msum(with_customer)


_MIXED = (
    "SELECT o_custkey, ['orders_' || o_orderkey] AS cl FROM orders WHERE o_orderstatus = 'F' UNION "
    "SELECT o_custkey, list_sort(['orders_' || o_orderkey, 'customer_' || c_custkey]) AS cl "
    "FROM orders, customer WHERE o_custkey = c_custkey AND o_orderstatus <> 'F'"
)
register(
    "absorb_mixed",
    lambda s, d: mixed_depth(tables(s, d, "B[X]")).text(),
    oracle.bx_text_of("o_custkey", _MIXED),
)
register(
    "absorb_mixed_hot",  # the same clauses, all on five tuples
    lambda s, d: mixed_priority(tables(s, d, "B[X]")).stats(digest=True),
    oracle.bx_stats_of("o_orderpriority", _MIXED.replace("SELECT o_custkey", "SELECT o_orderpriority")),
)
register(
    "absorb_none_nx",  # polynomials keep both terms
    lambda s, d: mixed_depth(tables(s, d, "N[X]")).stats(digest=True),
    oracle.nx_stats_of(
        "o_custkey",
        "SELECT o_custkey, ['orders_' || o_orderkey] AS mono, 1::BIGINT AS c FROM orders "
        "WHERE o_orderstatus = 'F' UNION ALL "
        "SELECT o_custkey, list_sort(['orders_' || o_orderkey, 'customer_' || c_custkey]), 1 "
        "FROM orders, customer WHERE o_custkey = c_custkey",
    ),
)


def mixed_priority(t):
    alone = t.orders.where("o_orderstatus = 'F'").project("o_orderpriority")
    both = t.orders.join(t.customer, [("o_custkey", "c_custkey")]).project("o_orderpriority")
    return alone.msum(both)


def with_constant(t):
    """Tuples known for certain (annotation one) absorb every clause."""
    sure = t.orders.where("o_totalprice > 480000").project("o_custkey").dedup(EXISTS)
    return t.orders.project("o_custkey").msum(sure)


register(
    "absorb_constant",
    lambda s, d: with_constant(tables(s, d, "B[X]")).text(),
    oracle.bx_text_of(
        "o_custkey",
        "SELECT DISTINCT o_custkey, CASE WHEN sure THEN []::VARCHAR[] ELSE [v] END AS cl FROM "
        "(SELECT o_custkey, 'orders_' || o_orderkey AS v, "
        "max(o_totalprice) OVER (PARTITION BY o_custkey) > 480000 AS sure FROM orders)",
    ),
)

# ---- reading annotations ------------------------------------------------------------------------

_CO = "customer, orders WHERE c_custkey = o_custkey"


def customer_orders(t):
    return t.customer.join(t.orders, [("c_custkey", "o_custkey")]).project("c_nationkey")


for _sr, _tag in (("B[X]", "bx"), ("N[X]", "nx")):
    register(
        f"vars_{_tag}",
        lambda s, d, sr=_sr: customer_orders(tables(s, d, sr)).variables(),
        f"SELECT DISTINCT c_nationkey, unnest([{var('customer')}, {var('orders')}]) AS variable FROM {_CO}",
    )
    register(
        f"lookup_{_tag}",
        lambda s, d, sr=_sr: customer_orders(tables(s, d, sr)).lookup(c_nationkey=7).text(),
        getattr(oracle, f"{_tag}_text")(
            "c_nationkey", f"{_CO} AND c_nationkey = 7", [var("customer"), var("orders")]
        ),
    )
register(
    "lookup_nat",
    lambda s, d: as_bigint(
        customer_orders(tables(s, d, "N")).annotation_of(c_nationkey=7), "annotation"
    ),
    f"SELECT c_nationkey, count(*)::BIGINT AS annotation FROM {_CO} AND c_nationkey = 7 GROUP BY c_nationkey",
)
register(
    "one_witness",
    lambda s, d: customer_orders(tables(s, d, "N[X]")).one_witness().text(),
    "SELECT c_nationkey, 0::INTEGER AS part, array_to_string(min(mono), '·') AS annotation FROM "
    f"(SELECT c_nationkey, list_sort([{var('customer')}, {var('orders')}]) AS mono FROM {_CO}) "
    "GROUP BY c_nationkey",
)
register(
    "term_count",
    lambda s, d: doubled(tables(s, d, "N[X]")).stats(),
    "SELECT o_orderpriority, count(DISTINCT o_orderkey)::BIGINT AS terms, 2 * count(*)::BIGINT AS coefficients, "
    "count(DISTINCT o_orderkey)::BIGINT AS degree FROM orders GROUP BY o_orderpriority",
)
register(
    "terms_bx",
    lambda s, d: customer_orders(tables(s, d, "B[X]")).terms(),
    f"SELECT DISTINCT c_nationkey, '(' || array_to_string(list_sort([{var('customer')}, {var('orders')}]), ' ∧ ') "
    f"|| ')' AS term FROM {_CO}",
)
register(
    "packed_bool",
    lambda s, d: tables(s, d, "B").orders.project("o_custkey").packed(),
    "SELECT DISTINCT o_custkey, true AS annotation FROM orders",
)
register(
    "packed_bx",
    lambda s, d: _flat(customer_orders(tables(s, d, "B[X]")).packed(max_terms=1000), "array_join(t, '+')"),
    "SELECT c_nationkey, ((row_number() OVER w - 1) // 1000)::INTEGER AS part, ((row_number() OVER w - 1) % 1000)::INTEGER AS at, "
    "array_to_string(cl, '+') AS term FROM "
    f"({oracle.clauses('c_nationkey', _CO, [var('customer'), var('orders')])}) WINDOW w AS (PARTITION BY c_nationkey ORDER BY cl)",
)
register(
    "packed_nx",
    lambda s, d: _flat(
        doubled(tables(s, d, "N[X]")).packed(max_terms=1000),
        "concat_ws('+', transform(t.m, x -> concat(x.v, '^', x.e)), CAST(t.c AS STRING))",
    ),
    "SELECT o_orderpriority, ((row_number() OVER w - 1) // 1000)::INTEGER AS part, ((row_number() OVER w - 1) % 1000)::INTEGER AS at, "
    f"v || '^1+2' AS term FROM (SELECT o_orderpriority, {var('orders')} AS v FROM orders) "
    "WINDOW w AS (PARTITION BY o_orderpriority ORDER BY v)",
)


def _flat(df, term):
    """The terms of packed parts, with their place."""
    return df.select(df.columns[0], "part", F.posexplode("annotation").alias("at", "t")).select(
        df.columns[0], "part", "at", F.expr(term).alias("term")
    )


for _sr, _tag, _build, _glue in (
    ("B[X]", "bx", oracle.clauses, " ∨ "),
    ("N[X]", "nx", oracle.monomials, " + "),
):
    # Several parts per tuple; the other side builds the whole sorted text and cuts it.
    register(
        f"text_parts_{_tag}",
        lambda s, d, sr=_sr: customer_orders(tables(s, d, sr)).text(max_terms=70),
        "SELECT c_nationkey, k::INTEGER AS part, array_to_string(whole[k * 70 + 1 : k * 70 + 70], "
        f"'{_glue}') AS annotation FROM (SELECT c_nationkey, list(t ORDER BY o) AS whole FROM (SELECT c_nationkey, "
        + (
            f"{oracle.CLAUSE_TEXT} AS t, {oracle.CLAUSE_TEXT} AS o FROM ("
            if _tag == "bx"
            else f"{oracle.TERM_TEXT} AS t, mt AS o FROM (SELECT c_nationkey, c, {oracle.MONOMIAL_TEXT} AS mt FROM ("
        )
        + _build("c_nationkey", _CO, [var("customer"), var("orders")])
        + (")" if _tag == "bx" else "))")
        + ") GROUP BY c_nationkey), generate_series(0, 100000) g(k) WHERE k * 70 < len(whole)",
    )


def distributed_and_not(t):
    """R ⨝ (S ⊎ T) against (R ⨝ S) ⊎ (R ⨝ T)."""
    r = t.nation.project("n_nationkey")
    s = t.customer.project(F.col("c_nationkey").alias("k"))
    u = t.supplier.where("s_acctbal > 0").project(F.col("s_nationkey").alias("k"))
    on = [("n_nationkey", "k")]
    return r.join(s.msum(u), on), r.join(s, on).msum(r.join(u, on)), r.join(s, on)


register(
    "equal_plans",
    lambda s, d: (
        lambda x: x[0].differences(x[1]).agg(F.count(F.lit(1)).alias("differences")).crossJoin(
            x[0].terms().agg(F.count(F.lit(1)).alias("terms"))  # one row each
        )
    )(distributed_and_not(tables(s, d, "N[X]"))),
    "SELECT 0::BIGINT AS differences, (SELECT count(*) FROM nation, customer WHERE c_nationkey = n_nationkey) + "
    "(SELECT count(*) FROM nation, supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS terms",
)
register(
    "unequal_plans",  # without T, its terms are the difference
    lambda s, d: (lambda x: x[0].differences(x[2]))(distributed_and_not(tables(s, d, "N[X]"))),
    f"SELECT n_nationkey, s_nationkey AS k, {var('nation')} || '·' || {var('supplier')} AS term, "
    "1::INTEGER AS side FROM nation, supplier WHERE n_nationkey = s_nationkey AND s_acctbal > 0",
)
register(
    "support_size",
    lambda s, d: tables(s, d, "N").lineitem.project("l_partkey").support().agg(
        F.count(F.lit(1)).alias("support")
    ),
    "SELECT count(DISTINCT l_partkey)::BIGINT AS support FROM lineitem",
)
register(
    "support_items",
    lambda s, d: tables(s, d, "B[X]").lineitem.project("l_suppkey").support(),
    "SELECT DISTINCT l_suppkey FROM lineitem",
)

# ---- loading --------------------------------------------------------------------------------------

register(
    "load_merge",  # equal rows of a bag are one tuple
    lambda s, d: counted(
        annotate(
            tune(s).read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity"), N
        )
    ),
    oracle.nat("l_partkey, l_suppkey, l_quantity", "lineitem"),
)
register(
    "load_weights",  # multiplicities given by a column; zero means absent
    lambda s, d: counted(
        annotate(
            tune(s).read.parquet(f"{d}/lineitem.parquet").selectExpr(
                "l_suppkey", "CAST(l_quantity AS INT) % 10 AS w"
            ),
            N,
            weight="w",
        )
    ),
    "SELECT l_suppkey, sum(CAST(l_quantity AS INT) % 10)::BIGINT AS n FROM lineitem "
    "GROUP BY l_suppkey HAVING sum(CAST(l_quantity AS INT) % 10) > 0",
)
register(
    "load_present",
    lambda s, d: annotate(
        tune(s).read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey", "o_orderstatus = 'F' AS here"),
        tables(s, d, "B").orders.semiring,
        present="here",
    ).result(),
    "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
register(
    "load_constant_bx",  # no variables: every annotation is True
    lambda s, d: load_tables(tune(s), d, tables(s, d, "B[X]").semiring, ["orders"], variables=False)["orders"]
    .project("o_custkey")
    .text(),
    "SELECT DISTINCT o_custkey, 0::INTEGER AS part, 'True' AS annotation FROM orders",
)
register(
    "load_constant_nx",
    lambda s, d: load_tables(tune(s), d, tables(s, d, "N[X]").semiring, ["orders"], variables=False)["orders"]
    .project("o_custkey")
    .text(),
    "SELECT o_custkey, 0::INTEGER AS part, count(*)::VARCHAR AS annotation FROM orders GROUP BY o_custkey",
)
register(
    "load_conform",
    lambda s, d: read_table(tune(s), d, "orders", conform=True),
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(15,2) AS o_totalprice, "
    "o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders",
)
register(
    "load_limit",  # the row cap of the loader is the feature
    lambda s, d: counted(load_tables(tune(s), d, N, ["orders"], limit=100)["orders"].project("o_orderkey", "o_custkey")),
    "SELECT o_orderkey, o_custkey, 1::BIGINT AS n FROM orders ORDER BY o_orderkey LIMIT 100",
)


def csv_roundtrip(spark, path):
    """Write orders, line items and customers as typed CSV, load them, join. Nothing is cast or rounded.

    A number column has four decimals, and some regions are called like the column.
    """
    tune(spark)
    folder = scratch_folder(spark, "typed-csv")
    rows = {t: read_table(spark, path, t) for t in ("customer", "orders", "lineitem", "region")}
    rows["lineitem"] = rows["lineitem"].withColumn("l_tax", F.expr("CAST(l_tax AS DECIMAL(15,4)) + l_linenumber * 0.0001BD"))
    rows["region"] = rows["region"].select("r_name").union(rows["region"].selectExpr("'r_name'"))
    write_tables(spark, rows, folder)
    frames = load_csv(spark, folder, N, rows)
    return counted(
        frames["customer"]
        .join(frames["orders"], [("c_custkey", "o_custkey")])
        .join(frames["lineitem"], [("o_orderkey", "l_orderkey")])
        .where("l_shipdate > o_orderdate AND l_tax >= 0.0503")
        .project("c_mktsegment", "l_returnflag", F.col("o_orderdate").cast("string").alias("day"), F.col("l_tax").cast("decimal(15,4)").alias("tax"))
        .msum(
            frames["region"].project(
                F.col("r_name").alias("c_mktsegment"), F.lit("-").alias("l_returnflag"), F.lit("-").alias("day"), F.lit(0).cast("decimal(15,4)").alias("tax")
            )
        )
    )


register(
    "load_csv_roundtrip",
    csv_roundtrip,
    "SELECT c_mktsegment, l_returnflag, day, tax, count(*)::BIGINT AS n FROM ("
    "SELECT c_mktsegment, l_returnflag, strftime(o_orderdate, '%Y-%m-%d') AS day, l_tax::DECIMAL(15,4) + l_linenumber * 0.0001 AS tax "
    "FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey "
    "AND l_shipdate > o_orderdate AND l_tax::DECIMAL(15,4) + l_linenumber * 0.0001 >= 0.0503 "
    "UNION ALL SELECT r_name, '-', '-', 0 FROM region UNION ALL SELECT 'r_name', '-', '-', 0 FROM region) GROUP BY ALL",
)

# ---- further scalar semirings: zeros that arise from sums and products ---------------------------

MOD4 = Semiring(
    "Z/4",
    weight=Weight(
        dtype="bigint",
        zero=0,
        one=1,
        plus=lambda c: F.sum(c) % 4,
        times=lambda a, b: (a * b) % 4,
        total_of_ones=lambda: F.count(F.lit(1)) % 4,
    ),
)
MIN_PLUS = Semiring(
    "min-plus",
    weight=Weight(
        dtype="double",
        zero=float("inf"),
        one=0.0,
        plus=F.min,
        times=lambda a, b: a + b,
        total_of_ones=lambda: F.lit(0.0),
        zero_sum_free=True,
        zero_divisor_free=True,
    ),
)


def weighted(spark, path, semiring, table, keep, weight):
    return annotate(tune(spark).read.parquet(f"{path}/{table}.parquet").withColumn("w", F.expr(weight)), semiring, weight="w", keep=keep)


def mod4_orders(s, d):
    return weighted(s, d, MOD4, "orders", ["o_custkey", "o_orderstatus"], "o_orderkey % 4")


def mod4_customers(s, d):
    return weighted(s, d, MOD4, "customer", ["c_custkey", "c_nationkey"], "c_custkey % 4")


_MOD4 = "(sum(w) % 4)::BIGINT AS n"
register(
    "mod4_sum",
    lambda s, d: mod4_orders(s, d).project("o_custkey").result(),
    f"SELECT o_custkey, {_MOD4} FROM (SELECT o_custkey, o_orderkey % 4 AS w FROM orders) GROUP BY ALL HAVING sum(w) % 4 <> 0",
)
register(
    "mod4_product",  # 2 x 2 is zero: the pair is absent
    lambda s, d: mod4_orders(s, d).join(mod4_customers(s, d), [("o_custkey", "c_custkey")]).project("c_nationkey", "o_orderstatus").result(),
    f"SELECT c_nationkey, o_orderstatus, {_MOD4} FROM (SELECT c_nationkey, o_orderstatus, (o_orderkey % 4) * (c_custkey % 4) % 4 AS w "
    "FROM orders, customer WHERE o_custkey = c_custkey) GROUP BY ALL HAVING sum(w) % 4 <> 0",
)
register(
    "mod4_msum",
    lambda s, d: mod4_orders(s, d).project("o_custkey").msum(mod4_customers(s, d).project(F.col("c_custkey").alias("o_custkey"))).result(),
    f"SELECT o_custkey, {_MOD4} FROM (SELECT o_custkey, o_orderkey % 4 AS w FROM orders UNION ALL SELECT c_custkey, c_custkey % 4 FROM customer) "
    "GROUP BY ALL HAVING sum(w) % 4 <> 0",
)
register(
    "mod4_exists",  # deduplication and support see no tuple whose annotations add up to zero
    lambda s, d: mod4_orders(s, d).project("o_custkey").dedup(EXISTS).result(),
    "SELECT o_custkey, 1::BIGINT AS n FROM (SELECT o_custkey, o_orderkey % 4 AS w FROM orders) GROUP BY o_custkey HAVING sum(w) % 4 <> 0",
)
register(
    "mod4_anti",  # an order status whose orders of a customer add up to zero is no match
    lambda s, d: mod4_customers(s, d).anti(mod4_orders(s, d).project("o_custkey"), [("c_custkey", "o_custkey")]).result(),
    f"SELECT c_custkey, c_nationkey, {_MOD4} FROM (SELECT c_custkey, c_nationkey, c_custkey % 4 AS w FROM customer "
    "WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_orderkey % 4) % 4 <> 0)) "
    "GROUP BY ALL HAVING sum(w) % 4 <> 0",
)
register(
    "mod4_outer",
    lambda s, d: mod4_customers(s, d).left_outer(mod4_orders(s, d), [("c_custkey", "o_custkey")]).project("c_nationkey", "o_orderstatus").result(),
    f"WITH o AS (SELECT o_custkey, o_orderstatus, sum(o_orderkey % 4) % 4 AS w FROM orders GROUP BY ALL HAVING sum(o_orderkey % 4) % 4 <> 0) "
    f"SELECT c_nationkey, o_orderstatus, {_MOD4} FROM (SELECT c_nationkey, o_orderstatus, (c_custkey % 4) * coalesce(o.w, 1) % 4 AS w "
    "FROM customer LEFT JOIN o ON c_custkey = o_custkey) GROUP BY ALL HAVING sum(w) % 4 <> 0",
)
register(
    "min_plus",  # cheapest way to each nation: an order and its customer
    lambda s, d: weighted(s, d, MIN_PLUS, "orders", ["o_custkey"], "CAST(o_orderkey AS DOUBLE)")
    .join(weighted(s, d, MIN_PLUS, "customer", ["c_custkey", "c_nationkey"], "CAST(c_custkey AS DOUBLE)"), [("o_custkey", "c_custkey")])
    .project("c_nationkey")
    .result(),
    "SELECT c_nationkey, min(o_orderkey + c_custkey)::DOUBLE AS n FROM orders, customer WHERE o_custkey = c_custkey GROUP BY c_nationkey",
)


def deep_and_shallow(t):
    """Clauses of one to four variables on one tuple: rows of chains of different depth."""
    chain = t.lineitem.join(t.orders, [("l_orderkey", "o_orderkey")])
    with_customer = chain.join(t.customer, [("o_custkey", "c_custkey")])
    with_nation = with_customer.join(t.nation, [("c_nationkey", "n_nationkey")])
    key = "o_orderpriority"
    return (
        with_nation.project(key)
        .msum(with_customer.where("c_mktsegment = 'BUILDING'").project(key))
        .msum(chain.where("l_returnflag = 'R'").project(key))
        .msum(t.orders.where("o_orderstatus = 'F'").project(key))
    )


register(
    "absorb_depths",
    lambda s, d: deep_and_shallow(tables(s, d, "B[X]")).stats(digest=True),
    oracle.bx_stats_of(
        "o_orderpriority",
        f"SELECT o_orderpriority, [{var('orders')}] AS cl FROM orders WHERE o_orderstatus = 'F' UNION "
        f"SELECT o_orderpriority, list_sort(CASE WHEN l_returnflag = 'R' THEN [{var('lineitem')}, {var('orders')}] "
        f"WHEN c_mktsegment = 'BUILDING' THEN [{var('lineitem')}, {var('orders')}, {var('customer')}] "
        f"ELSE [{var('lineitem')}, {var('orders')}, {var('customer')}, {var('nation')}] END) AS cl "
        "FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey "
        "AND c_nationkey = n_nationkey AND o_orderstatus <> 'F'",
    ),
)

# ---- renaming, outer and anti joins, set operators, division, grouping ---------------------------

in_all(
    "x_rename",
    lambda t: t.supplier.rename({"s_suppkey": "id", "s_nationkey": "nation"}).project("nation"),
    "s_nationkey AS nation", "supplier", [var("supplier")],
)
in_all(
    "x_alias",
    lambda t: t.supplier.alias("s1").where("s1_s_acctbal > 0").project("s1_s_nationkey"),
    "s_nationkey AS s1_s_nationkey", "supplier WHERE s_acctbal > 0", [var("supplier")],
)
in_all(
    "x_join",
    lambda t: t.customer.join(
        t.supplier, [("c_nationkey", "s_nationkey")], where="c_custkey = s_suppkey"
    ).project("c_nationkey", "s_suppkey"),
    "c_nationkey, s_suppkey",
    "customer, supplier WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey",
    [var("customer"), var("supplier")],
)
in_all(
    "x_anti",
    lambda t: t.customer.anti(
        t.orders.where("o_orderstatus = 'F' AND o_totalprice > 400000"), [("c_custkey", "o_custkey")]
    ).project("c_mktsegment", "c_nationkey"),
    "c_mktsegment, c_nationkey",
    "customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey "
    "AND o_orderstatus = 'F' AND o_totalprice > 400000)",
    [var("customer")],
)
in_all(
    "x_anti_theta",  # no equality: found by bins, removed by equi anti join
    lambda t: t.supplier.anti(
        t.nation, between=("s_acctbal", "n_nationkey * 300", "n_nationkey * 300 + 100", 100)
    ).project("s_nationkey"),
    "s_nationkey",
    "supplier WHERE NOT EXISTS (SELECT 1 FROM nation "
    "WHERE s_acctbal BETWEEN n_nationkey * 300 AND n_nationkey * 300 + 100)",
    [var("supplier")],
)


def outer(t):
    return t.customer.left_outer(
        t.orders, [("c_custkey", "o_custkey")], where="o_totalprice > 400000"
    ).project("c_nationkey", "o_orderstatus")


_OUTER = "customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"
_OUTER_SYMBOLIC = (
    f"(SELECT c_nationkey, o_orderstatus, CASE WHEN o_orderkey IS NULL THEN [{var('customer')}] "
    f"ELSE [{var('customer')}, {var('orders')}] END AS vs FROM {_OUTER})"
)
in_all("x_outer", outer, "c_nationkey, o_orderstatus", _OUTER, [], only=("B", "N"))
register(
    "x_outer_bx",
    lambda s, d: outer(tables(s, d, "B[X]")).text(),
    oracle.bx_text_of(
        "c_nationkey, o_orderstatus",
        f"SELECT DISTINCT c_nationkey, o_orderstatus, list_sort(vs) AS cl FROM {_OUTER_SYMBOLIC}",
    ),
)
register(
    "x_outer_nx",
    lambda s, d: outer(tables(s, d, "N[X]")).text(),
    oracle.nx_text_of(
        "c_nationkey, o_orderstatus",
        "SELECT c_nationkey, o_orderstatus, list_sort(vs) AS mono, count(*)::BIGINT AS c "
        f"FROM {_OUTER_SYMBOLIC} GROUP BY c_nationkey, o_orderstatus, mono",
    ),
)


def outer_theta(t):
    return t.supplier.left_outer(
        t.region, between=("s_acctbal", "r_regionkey * 2000", "r_regionkey * 2000 + 500", 500)
    ).project("s_nationkey", "r_name")


_OUTER_THETA = "supplier LEFT JOIN region ON s_acctbal BETWEEN r_regionkey * 2000 AND r_regionkey * 2000 + 500"
in_all("x_outer_theta", outer_theta, "s_nationkey, r_name", _OUTER_THETA, [], only=("B", "N"))


def ordering_customers(t):
    return t.orders.project(F.col("o_custkey").alias("k")).intersect(
        t.customer.where("c_acctbal > 0").project(F.col("c_custkey").alias("k"))
    )


in_all(
    "x_intersect", ordering_customers, "o_custkey AS k",
    "orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 0",
    [var("orders"), var("customer")],
)


def order_minus(t):
    return t.orders.project(F.col("o_custkey").alias("k")).minus(
        t.customer.where("c_mktsegment = 'BUILDING'").project(F.col("c_custkey").alias("k"))
    )


register(
    "x_minus_bool",
    lambda s, d: order_minus(tables(s, d, "B")).result(),
    "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
)
register(
    "x_minus_nat",
    lambda s, d: counted(order_minus(tables(s, d, "N"))),
    "SELECT k, count(*)::BIGINT AS n FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL "
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY k",
)
register(
    "x_divide",  # customers with orders of every priority
    lambda s, d: (lambda o: o.project("o_custkey", "o_orderpriority").divide(o.project("o_orderpriority")))(
        tables(s, d, "B").orders
    ).result(),
    "SELECT o_custkey FROM orders GROUP BY o_custkey "
    "HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
)


def grouped(t):
    return t.lineitem.project("l_returnflag", "l_linestatus", "l_partkey", "l_linenumber").group(
        ["l_returnflag", "l_linestatus"],
        items=("COUNT", "*"),
        total=("SUM", "l_linenumber"),
        mean=("AVG", "l_linenumber"),
        low=("MIN", "l_partkey"),
        high=("MAX", "l_partkey"),
    )


_MEASURES = (
    "count(*)::BIGINT AS items, sum(l_linenumber)::BIGINT AS total, "
    "sum(l_linenumber)::DOUBLE / count(l_linenumber) AS mean, min(l_partkey) AS low, max(l_partkey) AS high"
)


register(
    "x_group_nat",
    lambda s, d: grouped(tables(s, d, "N")).support(),
    f"SELECT l_returnflag, l_linestatus, {_MEASURES} FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
register(
    "x_group_nat_weighted",  # the same totals from rows added up beforehand
    lambda s, d: tables(s, d, "N")
    .lineitem.project("l_returnflag", "l_linestatus", "l_partkey", "l_linenumber")
    .merge()
    .group(
        ["l_returnflag", "l_linestatus"],
        items=("COUNT", "*"),
        total=("SUM", "l_linenumber"),
        mean=("AVG", "l_linenumber"),
        low=("MIN", "l_partkey"),
        high=("MAX", "l_partkey"),
    )
    .support(),
    f"SELECT l_returnflag, l_linestatus, {_MEASURES} FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_SUPPORT = "(SELECT DISTINCT l_returnflag, l_linestatus, l_partkey, l_linenumber FROM lineitem)"
register(
    "x_group_bool",
    lambda s, d: grouped(tables(s, d, "B")).support(),
    f"SELECT l_returnflag, l_linestatus, {_MEASURES} FROM {_SUPPORT} GROUP BY l_returnflag, l_linestatus",
)


def grouped_customers(t):
    return t.customer.project("c_mktsegment", "c_nationkey").group(
        ["c_mktsegment"],
        nations=("COUNT", "c_nationkey"),
        top=("MAX", "c_nationkey"),
        sum_keys=("SUM", "c_nationkey"),
        mean_key=("AVG", "c_nationkey"),
        rows=("COUNT", "*"),
    )


register(
    "x_group_bx",
    lambda s, d: grouped_customers(tables(s, d, "B[X]")).stats(digest=True),
    "SELECT * FROM (SELECT c_mktsegment, count(DISTINCT c_nationkey)::BIGINT AS nations, "
    "max(c_nationkey) AS top, sum(DISTINCT c_nationkey)::BIGINT AS sum_keys, "
    "sum(DISTINCT c_nationkey)::DOUBLE / count(DISTINCT c_nationkey) AS mean_key, "
    "count(DISTINCT c_nationkey)::BIGINT AS rows FROM customer GROUP BY c_mktsegment) JOIN ("
    + oracle.bx_stats("c_mktsegment", "customer", [var("customer")])
    + ") USING (c_mktsegment)",
)
