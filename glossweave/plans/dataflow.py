"""Queries of the batch dataflow and of glossary matching, with a client that is a plain rule: reversed texts, failing on much text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.operators import terms, translating
from glossweave.sources import samples

Query = Callable[[SparkSession, str], DataFrame]
LIMIT, FAILS, CUTS = 900, 420, 5


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def client(texts: Column) -> Column:
    """Reversed texts; fails above ``FAILS`` characters, forgets the last of ``CUTS`` texts or more."""
    chars = F.aggregate(texts, F.lit(0), lambda a, t: a + F.char_length(t))
    told = F.transform(texts, F.reverse)
    return F.when((chars > FAILS) & (F.size(texts) > 1), None).otherwise(F.when(F.size(texts) >= CUTS, F.slice(told, F.lit(1), F.size(texts) - 1)).otherwise(told))


def translate_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").select("conv_id", "turn", "text")
    got = translating.translated(rows, "conv_id", "turn", "text", client, LIMIT)
    return got.select("conv_id", "turn", "depth", F.md5("out").alias("md5"), F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


def translate_summary(spark: SparkSession, d: str) -> DataFrame:
    got = translate_batches(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count("md5").alias("done"), F.count_if("mismatch").alias("odd"))
    lost = F.col("total") - F.col("done")
    parts = F.concat_ws(", ", F.when(lost > 0, F.concat(lost.cast("string"), F.lit(" blocks untranslated"))), F.when(F.col("odd") > 0, F.concat(F.col("odd").cast("string"), F.lit(" rows of odd count"))))
    return got.select("conv_id", F.when(parts == "", F.format_string("Success: %d/%d blocks translated", "done", "total")).otherwise(F.concat(F.lit("Completed with issues: "), parts)).alias("summary"))


def translate_units(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").select("conv_id", "turn", "text")
    return translating.once_each(rows, F.concat_ws("|", F.lit("en"), F.lit("minimal"), F.col("text")), "text", F.reverse).select("conv_id", "turn", F.md5("out").alias("md5"))


def translation_maps(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("k"), "md5")))
    return translate_units(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["md5"])), ",").alias("pairs"))


def retry_untranslated(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come back unchanged go through once more, others stay."""
    rows = _read(spark, d, "conversations").select("conv_id", "turn", "text")
    first = rows.withColumn("out", F.when(F.char_length("text") % 7 == 0, F.col("text")).otherwise(F.reverse("text")))
    again = first.where("out = text").select("conv_id", "turn", "text")
    again = translating.called(translating.packed(again, "conv_id", "turn", F.char_length("text"), 800), "conv_id", "turn", "text", lambda t: F.transform(t, lambda x: F.concat(F.lit("2:"), x)))
    return first.join(again.select("conv_id", "turn", F.col("out").alias("second")), ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("second").isNotNull().alias("retried"), F.md5(F.coalesce("second", "out")).alias("md5"))


def lru_cache(spark: SparkSession, d: str) -> DataFrame:
    return translating.lru_hits(_read(spark, d, "events"), "user_id", "event_id", "event_type", 3)


def glossary_load(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(samples.GLOSSARY)), "idx long, line string")
    return terms.loaded(lines).select("idx", "source", "target")


def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words of ``benchmark`` as terms, in texts of ``documents``."""
    words = _read(spark, d, "benchmark").select("item_id", F.expr("regexp_extract_all(lower(text), '[a-z0-9]+', 0)").alias("w"))
    pairs = words.select("item_id", F.posexplode("w").alias("i", "one"), F.col("w").alias("w")).select(
        (F.col("item_id") * 100000 + F.col("i")).alias("idx"), F.when(F.col("i") % 3 == 0, F.concat_ws("-", "one", F.get("w", F.col("i") + 1))).otherwise(F.col("one")).alias("source"),
        F.when(F.col("i") % 50 == 0, "k yen").otherwise(F.reverse("one")).alias("target"),
    )
    return terms.matched(_read(spark, d, "documents"), pairs, 40)


QUERIES: dict[str, Query] = {f.__name__: f for f in (translate_batches, translate_summary, translate_units, translation_maps, retry_untranslated, lru_cache, glossary_load, glossary_terms)}


def _level(depth: int, rows: str, limit: int) -> str:
    """Rows of one depth: packed, made distinct in a batch, answered."""
    n = f"l{depth}"
    return f"""
{n}_t AS (SELECT conv_id, turn, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {rows}),
{n}_w AS (
  SELECT conv_id, turn, text, n, r, 1 AS batch, CASE WHEN n > {limit} THEN 0 ELSE n END AS held, n <= {limit} AS open FROM {n}_t WHERE r = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.text, t.n, t.r, CASE WHEN w.open AND t.n <= {limit} AND w.held + t.n <= {limit} THEN w.batch ELSE w.batch + 1 END,
    CASE WHEN t.n > {limit} THEN 0 WHEN w.open AND w.held + t.n <= {limit} THEN w.held + t.n ELSE t.n END, t.n <= {limit}
  FROM {n}_w w JOIN {n}_t t ON t.conv_id = w.conv_id AND t.r = w.r + 1),
{n}_u AS (SELECT conv_id, batch, text, row_number() OVER (PARTITION BY conv_id, batch ORDER BY min(turn)) AS slot FROM {n}_w GROUP BY conv_id, batch, text),
{n}_b AS (SELECT conv_id, batch, count(*) AS c, sum(length(text)) > {FAILS} AND count(*) > 1 AS failed FROM {n}_u GROUP BY conv_id, batch),
{n} AS (
  SELECT w.conv_id, w.turn, w.text, {depth} AS depth, b.failed, CASE WHEN b.failed THEN NULL WHEN b.c >= {CUTS} AND u.slot = b.c THEN '' ELSE reverse(w.text) END AS out, NOT b.failed AND b.c >= {CUTS} AS mismatch
  FROM {n}_w w JOIN {n}_u u USING (conv_id, batch, text) JOIN {n}_b b USING (conv_id, batch))"""


_BATCHES = f"""WITH RECURSIVE {_level(0, 'conversations', LIMIT)}, {_level(1, '(SELECT * FROM l0 WHERE failed)', LIMIT // 2)}, {_level(2, '(SELECT * FROM l1 WHERE failed)', 300)},
got AS (SELECT * FROM l0 WHERE NOT failed UNION ALL SELECT * FROM l1 WHERE NOT failed UNION ALL SELECT * FROM l2)"""
_PAIRS = """SELECT item_id * 100000 + i - 1 AS idx, CASE WHEN (i - 1) % 3 = 0 THEN w[i] || coalesce('-' || w[i + 1], '') ELSE w[i] END AS source, CASE WHEN (i - 1) % 50 = 0 THEN 'k yen' ELSE reverse(w[i]) END AS target
  FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))"""

SQL: dict[str, str] = {
    "translate_batches": f"{_BATCHES} SELECT conv_id, turn, depth, md5(out) AS md5, mismatch FROM got",
    "translate_summary": f"""{_BATCHES} SELECT conv_id, CASE WHEN count(*) = count(out) AND count(*) FILTER (mismatch) = 0 THEN 'Success: ' || count(out) || '/' || count(*) || ' blocks translated'
  ELSE 'Completed with issues: ' || concat_ws(', ', CASE WHEN count(*) > count(out) THEN (count(*) - count(out)) || ' blocks untranslated' END, CASE WHEN count(*) FILTER (mismatch) > 0 THEN count(*) FILTER (mismatch) || ' rows of odd count' END) END AS summary FROM got GROUP BY conv_id""",
    "translate_units": "SELECT conv_id, turn, md5(reverse(text)) AS md5 FROM conversations",
    "translation_maps": "SELECT conv_id, string_agg(turn || '=' || md5(reverse(text)), ',' ORDER BY turn::VARCHAR) AS pairs FROM conversations GROUP BY conv_id",
    "retry_untranslated": "SELECT conv_id, turn, length(text) % 7 = 0 OR reverse(text) = text AS retried, md5(CASE WHEN length(text) % 7 = 0 OR reverse(text) = text THEN '2:' || text ELSE reverse(text) END) AS md5 FROM conversations",
    "lru_cache": """WITH e AS (SELECT user_id, event_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, before IS NOT NULL AND (SELECT count(DISTINCT x.event_type) FROM events x WHERE x.user_id = e.user_id AND x.event_id > e.before AND x.event_id < e.event_id) < 3 AS hit FROM e""",
    "glossary_terms": rf"""WITH g AS (SELECT * FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY idx) = 1),
f AS (SELECT DISTINCT idx, form, regexp_replace(form, '[\s_/\\-]+', '', 'g') AS c FROM (SELECT idx, unnest([source, target]) AS form FROM g) WHERE form <> ''),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS t, regexp_replace(lower(coalesce(text, '')), '[\s_/\\-]+', '', 'g') AS c FROM documents),
h AS (SELECT DISTINCT doc_id, idx FROM t JOIN f ON (length(f.c) >= 4 AND contains(t.c, f.c)) OR (length(f.c) < 4 AND regexp_matches(t.t, '(^|[^a-z0-9])' || f.form || '($|[^a-z0-9])'))),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY (source LIKE '%oku%' OR target LIKE '%oku%' OR target = 'k yen') DESC, greatest(length(source), length(target)) DESC, idx) AS place FROM h JOIN g USING (idx))
SELECT doc_id, count(*) AS n, count(*) > 40 AS truncated, string_agg(source, ',' ORDER BY place) FILTER (place <= 40) AS terms FROM r GROUP BY doc_id""",
    "glossary_load": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{t}')" for i, s, t in samples.GLOSSARY_ROWS) + ") AS g(idx, source, target)",
}
