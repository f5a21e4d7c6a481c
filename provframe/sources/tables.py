"""The eight benchmark tables: columns, row identifiers, Parquet loading."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provframe.frame import KFrame
from provframe.semirings import Semiring
from provframe.sources.annotate import annotate

# The published TPC-H column lists with their CSV type hints.
COLUMNS = {
    "nation": "n_nationkey INT, n_name STR, n_regionkey INT, n_comment STR",
    "region": "r_regionkey INT, r_name STR, r_comment STR",
    "supplier": "s_suppkey INT, s_name STR, s_address STR, s_nationkey INT, s_phone STR, "
    "s_acctbal DECIMAL, s_comment STR",
    "customer": "c_custkey INT, c_name STR, c_address STR, c_nationkey INT, c_phone STR, "
    "c_acctbal DECIMAL, c_mktsegment STR, c_comment STR",
    "orders": "o_orderkey INT, o_custkey INT, o_orderstatus STR, o_totalprice DECIMAL, "
    "o_orderdate DATE, o_orderpriority STR, o_clerk STR, o_shippriority INT, o_comment STR",
    "lineitem": "l_orderkey INT, l_partkey INT, l_suppkey INT, l_linenumber INT, "
    "l_quantity DECIMAL, l_extendedprice DECIMAL, l_discount DECIMAL, l_tax DECIMAL, "
    "l_returnflag STR, l_linestatus STR, l_shipdate DATE, l_commitdate DATE, "
    "l_receiptdate DATE, l_shipinstruct STR, l_shipmode STR, l_comment STR",
    "part": "p_partkey INT, p_name STR, p_mfgr STR, p_brand STR, p_type STR, p_size INT, "
    "p_container STR, p_retailprice DECIMAL, p_comment STR",
    "partsupp": "ps_partkey INT, ps_suppkey INT, ps_availqty INT, ps_supplycost DECIMAL, "
    "ps_comment STR",
}

SPARK_TYPES = {"INT": "bigint", "STR": "string", "DATE": "date", "DECIMAL": "decimal(15,2)"}

# Columns that name a row's variable. Line items have no small key: two may share
# (orderkey, linenumber), and now and then part and supplier too.
ROW_IDS = {
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
    "supplier": ["s_suppkey"],
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
    "part": ["p_partkey"],
    "partsupp": ["ps_partkey", "ps_suppkey"],
}


def hints(table: str) -> list[tuple[str, str]]:
    """[(column, type hint)] of a known table."""
    if table not in COLUMNS:
        raise ValueError(f"unknown table {table!r}; known tables: {', '.join(sorted(COLUMNS))}")
    return [tuple(c.split()) for c in COLUMNS[table].split(", ")]


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {SPARK_TYPES[h]}" for c, h in hints(table)))


SCHEMAS = tuple(COLUMNS)


def capped(df: DataFrame, limit: int | None, order_by: Sequence[str] | None = None) -> DataFrame:
    """At most ``limit`` rows; the same ones each time when ``order_by`` is given."""
    if limit is None:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def read_table(spark: SparkSession, path: str, table: str, conform: bool = False) -> DataFrame:
    """Known columns of one Parquet table that the file has, in schema order.

    ``conform`` casts to the table's types (dates, decimals). It is off by
    default: filters on a cast column do not reach the Parquet scan.
    """
    wanted = hints(table)
    df = spark.read.parquet(f"{path.rstrip('/')}/{table}.parquet")
    have = set(df.columns)
    return df.select(
        *[
            F.col(c).cast(SPARK_TYPES[h]).alias(c) if conform else F.col(c)
            for c, h in wanted
            if c in have
        ]
    )


def load_tables(
    spark: SparkSession,
    path: str,
    semiring: Semiring,
    tables: Iterable[str] | None = None,
    limit: int | None = None,
    conform: bool = False,
    variables: bool = True,
) -> dict[str, KFrame]:
    """Annotated relations by table name; ``variables=False`` annotates with one.

    Without ``tables``, tables that do not exist are skipped.
    """
    names = [t.lower() for t in tables] if tables is not None else list(SCHEMAS)
    out = {}
    for t in names:
        hints(t)
        try:
            df = read_table(spark, path, t, conform)
        except AnalysisException as e:
            if tables is None and e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        df = capped(df, limit, ROW_IDS[t])
        out[t] = annotate(df, semiring, t if variables else None, ROW_IDS[t] if variables else None)
    return out
