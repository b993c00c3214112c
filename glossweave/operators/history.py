"""The history table as DataFrames: rows in, rows out; the caller writes them (Parquet keeps no identity column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id long, source_text string, direction string, result_json string, timestamp string"
DIRECTION = "auto"


def created(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def added(history: DataFrame, rows: DataFrame) -> DataFrame:
    """``history`` with ``rows`` (source_text, result_json, timestamp) under new ids, in order of time.

    Ids go by ranges of sorted partitions, so no task numbers all new rows.
    """
    last = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    parted = rows.repartitionByRange("timestamp", "source_text").sortWithinPartitions("timestamp", "source_text").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    new = parted.withColumn("place", inside).join(F.broadcast(starts), "part")  # a row for each partition
    return history.unionByName(new.select((F.lit(last) + F.col("start") + F.col("place")).alias("id"), "source_text", F.lit(DIRECTION).alias("direction"), "result_json", "timestamp"))


def deleted(history: DataFrame, timestamps: DataFrame) -> DataFrame:
    """What is left after rows of the given timestamps went."""
    return history.join(timestamps.select("timestamp").distinct(), "timestamp", "left_anti").select(*history.columns)


def cleared(history: DataFrame) -> tuple[DataFrame, int]:
    """An empty history, and how many rows went."""
    return history.limit(0), history.count()


def recent(history: DataFrame, n: int = 50) -> DataFrame:
    return history.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def pruned(history: DataFrame, n: int = 500) -> DataFrame:
    return recent(history, n)
