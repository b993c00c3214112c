"""Queries whose columns build on one another: each step is a column of the next query."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.functions.dialect import Dialect, Oracle, Spark

Steps = list[tuple[str, str]]
#: SQL of the rows, the steps, and the columns to return.
Plan = tuple[str, Steps, list[str]]
Build = Callable[[Dialect], Plan]


def bound(sql: str, tables: list[str]) -> str:
    """The statement with its tables as parameters, other braces kept."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return sql


def query(build: Build, tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """Step by step, so that each is analysed by itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, steps, columns = build(Spark())
        df = spark.sql(bound(source, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
        for name, expression in steps:
            df = df.selectExpr("*", f"{expression} AS {name}")
        return df.selectExpr(*columns)

    return run


def oracle(build: Build) -> str:
    source, steps, columns = build(Oracle())
    for name, expression in steps:
        source = f"SELECT *, {expression} AS {name} FROM ({source}) AS s"
    return f"SELECT {', '.join(columns)} FROM ({source}) AS s"
