"""Names of all queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.plans import amounts, catalog, comparing, containers, dataflow, files, guarding, pages, pagetext, relational, replies, reports, structured

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "language_detection"


def queries() -> dict[str, Query]:
    return catalog.queries() | relational.QUERIES | amounts.QUERIES | replies.QUERIES | reports.QUERIES | pages.QUERIES | pagetext.QUERIES | structured.QUERIES | guarding.QUERIES | comparing.QUERIES | containers.QUERIES | dataflow.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.oracle_sql() | relational.SQL | amounts.SQL | replies.SQL | reports.SQL | pages.SQL | pagetext.SQL | structured.SQL | guarding.SQL | comparing.SQL | containers.SQL | dataflow.SQL | files.SQL
