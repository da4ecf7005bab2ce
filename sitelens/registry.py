"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with equivalent SQL over the same tables."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


#: Tasks for each core that rows are dealt to where much is made of each row.
TASKS_PER_CORE = 4


def spread(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows dealt to tasks by key. Rows that are few bytes in a file are one split, and one task, however much is made of them.

    With ``most``, the tasks grow in number with the rows, which are counted, so that one gets about so many at most.
    """
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, -(-rows.count() // most)) if most else tasks, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
