"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

ROWS_PER_TASK = 20_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def dealt(table: DataFrame) -> DataFrame:
    """The rows of a table over as many tasks as their number needs.

    A row becomes a text many times its size, and judging texts takes CPU time: a table that is one small file would be
    one task's work, however many rows it has. A table that is read by enough tasks stays as it is.
    """
    wanted = -(-table.count() // ROWS_PER_TASK)
    if wanted <= 1 or table.rdd.getNumPartitions() >= wanted:
        return table
    return table.repartition(wanted, table.columns[0])


class Tables:
    """The given tables of one folder, and files derived from them by a portable SELECT."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derive(self, select: str) -> DataFrame:
        """Run a SELECT that both engines accept; only the tables it names are opened, their rows dealt over tasks."""
        for name in TABLES:
            if f" {name}" in select:
                dealt(getattr(self, name)).createOrReplaceTempView(name)
        return self.spark.sql(select)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH a AS (...), b AS (...) body``."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + body
