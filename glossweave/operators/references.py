"""Texts of reference files, kept in a table by path, time and size, so that a run reads the files that changed and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.dialect import BLANKS

KEY = ["path", "mtime", "size"]
CACHE = "path string, mtime long, size long, text string, truncated boolean"


def cut(rows: DataFrame, most_chars: int) -> DataFrame:
    """path, mtime, size, text, truncated of rows with ``content``: line ends alike, no mark at the start, stripped, at most so many characters."""
    plain = F.regexp_replace(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", ""), "\r\n?", "\n")
    rows = rows.select(*KEY, F.btrim(F.coalesce(plain, F.lit("")), F.lit(BLANKS + "\x1c\x1d\x1e\x1f")).alias("whole"))
    return rows.select(*KEY, F.substring("whole", 1, most_chars).alias("text"), (F.char_length("whole") > most_chars).alias("truncated"))


def refreshed(listing: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame], most_chars: int) -> DataFrame:
    """The next version of ``cache`` for the files of ``listing`` (path, mtime, size): unchanged ones from the cache, the others by ``read``.

    ``read`` gets the keys of changed files and returns these with ``content``.  Files that are gone leave the cache.  ``reused`` says which is which.
    A file that can't be read is left out and tried again by the next run.
    """
    listing = listing.select(*KEY).distinct()
    kept = cache.join(listing, KEY, "left_semi").select(*KEY, "text", "truncated", F.lit(True).alias("reused"))
    changed = cut(read(listing.join(cache.select(*KEY), KEY, "left_anti")), most_chars).withColumn("reused", F.lit(False))
    return kept.unionByName(changed)


def refresh_folder(spark: SparkSession, folder: str, table: str, most_chars: int) -> DataFrame:
    """``refreshed`` for the files of a folder, with versions of the cache under ``table``.

    Content is read for changed files only, whose names the driver holds: references are files that people attach, not a corpus.
    Files without a byte have no text and are left out.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(n[2:]) for s in (fs.listStatus(fs_path) if fs.exists(fs_path) else []) if (n := s.getPath().getName()).startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    cache = spark.read.schema(CACHE).parquet(f"{table}/v={versions[-1]}") if versions else spark.createDataFrame([], CACHE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    keys = files.select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))

    def read(changed: DataFrame) -> DataFrame:
        paths = [r.path for r in changed.select("path").collect()]
        if not paths:
            return spark.createDataFrame([], "path string, mtime long, size long, content binary")
        return spark.read.format("binaryFile").load(paths).select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")

    out = f"{table}/v={versions[-1] + 1 if versions else 0}"
    refreshed(keys, cache, read, most_chars).write.parquet(out)
    return spark.read.parquet(out)
