"""Where the plan modules list their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provframe.frame import KFrame
from provframe.semirings import BY_NAME, Semiring
from provframe.session import tune
from provframe.sources.annotate import annotate
from provframe.sources.tables import load_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Annotated tables of one data folder, loaded when first asked for."""

    def __init__(self, spark: SparkSession, path: str, semiring: Semiring):
        self.spark, self.path, self.semiring = spark, path, semiring
        self._loaded: dict[str, KFrame] = {}

    def __getattr__(self, name: str) -> KFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = self._partsupp() if name == "partsupp" else load_tables(
                self.spark, self.path, self.semiring, [name]
            )[name]
        return self._loaded[name]

    def _partsupp(self) -> KFrame:
        """The folder has no partsupp table: the (part, supplier) pairs of the line items."""
        pairs = (
            self.spark.read.parquet(f"{self.path.rstrip('/')}/lineitem.parquet")
            .selectExpr("l_partkey AS ps_partkey", "l_suppkey AS ps_suppkey")
            .distinct()
        )
        return annotate(
            pairs, self.semiring, "partsupp", ["ps_partkey", "ps_suppkey"], unique=True
        )


def tables(spark: SparkSession, path: str, semiring: Semiring | str) -> Tables:
    return Tables(tune(spark), path, BY_NAME[semiring] if isinstance(semiring, str) else semiring)


def as_bigint(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        *[df[c].cast("bigint").alias(c) if c in columns else df[c] for c in df.columns]
    )


def counted(frame: KFrame) -> DataFrame:
    """N result with a bigint multiplicity, which raises when it does not fit."""
    return as_bigint(frame.result("n"), "n")


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql
