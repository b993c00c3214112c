"""Queries of sources and sinks over files made from the tables, of the history table, and of framed streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.operators import history
from glossweave.sources import formats
from glossweave.streaming import framing

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parsed(files: DataFrame, kind: str) -> DataFrame:
    """Blocks of files given as rows (doc, content)."""

    def run(frames):  # noqa: ANN001, ANN202
        for df in frames:
            rows = [(doc, b[0], b[1], b[5], b[6]) for doc, raw in zip(df["doc"], df["content"], strict=True) for b in formats.PARSERS[kind](bytes(raw))]
            yield pd.DataFrame(rows, columns=["doc", "block", "text", "row", "col"]).astype({"row": "Int32", "col": "Int32"})

    return files.mapInPandas(run, "doc long, block string, text string, row int, col int")


def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one small table a document, in Latin letters, with a mark, semicolons and carriage returns."""
    content = F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(F.concat(F.lit("label;lang;source\r\nrow;"), F.col("lang"), F.lit(";"), F.col("source"), F.lit("\r\nnext;\"a;b\";"), F.col("lang"), F.lit("\r\n")), "UTF-8"))
    return _parsed(_read(spark, d, "documents").select(F.col("doc_id").alias("doc"), content.alias("content")), "csv").select("doc", "block", "text")


def txt_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("content"))
    blocks = _parsed(rows, "txt").where("block NOT LIKE '%chunk%'")
    return blocks.select("doc", "block", F.md5("text").alias("md5"))


def applied_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as paragraphs; every third one has a translation; the rest stays."""
    lines = _read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("row", "text")).withColumn("block", F.concat(F.lit("para_"), F.col("row").cast("string"))).withColumn("col", F.lit(0))
    told = lines.where("row % 3 = 0").select("doc", "block", F.reverse("text").alias("text"))
    return formats.texts_of(formats.apply_translations(lines, told)).select("doc", F.md5("value").alias("md5"))


def applied_csv(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations")
    cells = turns.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("row"), F.posexplode(F.array(F.col("role"), F.col("text"), F.lit("a;b"))).alias("col", "translated"))
    return formats.csv_of(cells, ";", "\r\n").select("doc", F.md5("value").alias("md5"))


def history_added(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select(F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("source_text"), F.to_json(F.struct("event_type")).alias("result_json"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("timestamp"))
    first = history.added(history.created(spark), e.where("source_text LIKE 'click%'"))
    both = history.added(first, e.where("source_text NOT LIKE 'click%'"))
    return history.deleted(both, e.where("source_text LIKE '%7'")).select("id", "source_text", "direction", "timestamp")


def sse_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as one event stream of uneven pieces, read back."""
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    turns = _read(spark, d, "conversations").select("conv_id", "turn", event.alias("event"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "event"))), lambda x: x["event"]), ": ping\n")
    bodies = turns.groupBy("conv_id").agg(F.concat(body, F.lit("data: {bad\n\ndata: [DONE]\n\ndata: {\"choices\":[{\"delta\":{\"content\":\"late\"}}]}\n\n")).alias("body"))
    pieces = bodies.select("conv_id", F.posexplode(F.regexp_extract_all("body", F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "chunk"))
    return framing.sse(pieces, "conv_id", "seq", "chunk").select("conv_id", F.md5("text").alias("md5"), "events")


def chunked_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Texts framed as chunks of a body, and taken out again."""
    parts = F.regexp_extract_all("text", F.lit("(?s).{1,100}"), F.lit(0))
    framed = F.concat(F.array_join(F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit(";x=y\r\n"), p, F.lit("\r\n"))), ""), F.lit("0\r\n\r\n"))
    return _read(spark, d, "conversations").select("conv_id", "turn", F.md5(framing.unchunked(F.encode(framed, "UTF-8"))).alias("md5"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (csv_cells, txt_paragraphs, applied_texts, applied_csv, history_added, sse_texts, chunked_bodies)}

_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL: dict[str, str] = {
    "csv_cells": """SELECT doc_id AS doc, unnest(['r0_c0', 'r0_c1', 'r0_c2', 'r1_c0', 'r1_c1', 'r1_c2', 'r2_c0', 'r2_c1', 'r2_c2']) AS block, unnest(['label', 'lang', 'source', 'row', lang, source, 'next', 'a;b', lang]) AS text FROM documents""",
    "txt_paragraphs": f"""SELECT doc_id AS doc, 'para_' || i AS block, md5(trim(line, {_BLANK})) AS md5 FROM ({_LINES}) WHERE trim(line, {_BLANK}) <> '' AND length(trim(line, {_BLANK})) <= 3000 AND NOT regexp_full_match(trim(line, {_BLANK}), '[0-9\\s.,+()/%-]*')""",
    "applied_texts": f"SELECT doc_id AS doc, md5(string_agg(CASE WHEN i % 3 = 0 AND trim(line, ' ') <> '' THEN reverse(line) ELSE line END, chr(10) || chr(10) ORDER BY i)) AS md5 FROM ({_LINES}) GROUP BY doc_id",
    "applied_csv": """SELECT conv_id AS doc, md5(string_agg(role || ';' || CASE WHEN regexp_matches(text, '[;"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ';"a;b"' || chr(13) || chr(10), '' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id""",
    "history_added": """WITH e AS (SELECT event_type || '-' || event_id AS source_text, strftime(ts, '%Y-%m-%dT%H:%M') AS timestamp FROM events),
h AS (SELECT *, row_number() OVER (ORDER BY source_text NOT LIKE 'click%', timestamp, source_text) AS id FROM e)
SELECT id, source_text, 'auto' AS direction, timestamp FROM h WHERE timestamp NOT IN (SELECT timestamp FROM e WHERE source_text LIKE '%7')""",
    "sse_texts": "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS md5, count(*) AS events FROM conversations GROUP BY conv_id",
    "chunked_bodies": "SELECT conv_id, turn, md5(text) AS md5 FROM conversations",
}
