"""Where queries are registered with the SQL they are held against and the inventory rows they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}

#: Rows that unit tests cover (their input is no shared table), and rows not built with the reason.
TESTED: dict[str, str] = {x: "tests/test_operators.py::test_sources" for x in ("SC4", "SC8", "SC9", "SC10", "SC11", "SC12")}
LEFT_OUT: dict[str, str] = {
    "SC14": "needs a network and a browser; pages are read from a table",
    "G9": "Spark's partitions and tasks are this",
    "STR7": "a user interface's update rate",
    "STR8": "a user interface's log queue",
    "U8": "absent there as well",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a function (spark, tables) -> DataFrame; ``covers`` lists inventory ids, blank-separated."""

    def keep(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, Tables(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = f.__doc__
        QUERIES[key] = run
        COVERS[key] = tuple(covers.split())
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


class Tables:
    """Input tables by attribute; Spark prunes what a query does not use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise AttributeError(table)
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")
