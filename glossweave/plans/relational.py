"""Queries that join, group, rank and fold, each beside SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.functions.dialect import BLANKS, Oracle
from glossweave.operators import batching, glossary, layout, translating
from glossweave.streaming import deltas

Query = Callable[[SparkSession, str], DataFrame]
PAGE_H, PAGE_W = 900.0, 800.0
LIMIT = 600
ENDS, MESSAGE_ENDS = "。！？.!?\n", "。！？!?\n"
CHUNK = 3000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = translating.packed(_read(spark, d, "conversations"), "conv_id", "turn", F.char_length("text"), LIMIT)
    return rows.select("conv_id", "turn", F.char_length("text").cast("long").alias("size"), "batch")


def dedupe_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = batching.first_seen(_read(spark, d, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", "first", "slot", F.md5("text").alias("text_md5"))


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    keys = _read(spark, d, "documents").groupBy("lang", F.sha2(F.concat_ws("|", "lang", F.trim("text")), 256).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("b"))
    hits = F.sum(F.col("n") - 1)
    return keys.groupBy("lang").agg(
        hits.alias("hits"), F.count(F.lit(1)).alias("misses"), F.round(100.0 * hits / F.sum("n"), 1).alias("hit_rate"), F.round(F.sum("b") / 1024.0, 3).alias("kb")
    )


def glossary_topk(spark: SparkSession, d: str) -> DataFrame:
    terms = _read(spark, d, "benchmark").select(F.explode(glossary.words("text")).alias("term")).distinct()
    rules = terms.select("term", F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long").alias("rule"))
    return glossary.matches(_read(spark, d, "documents"), rules, 40)


def char_budget(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    kept = batching.within_budget(lines, "doc_id", "i", "line", 2000, 40)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used"))


def section_filter(spark: SparkSession, d: str) -> DataFrame:
    chosen = _read(spark, d, "labels").where("quality = 1").select("doc_id")
    return _read(spark, d, "documents").join(chosen, "doc_id", "left_semi").select("doc_id", "lang", "source")


def section_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = docs.withColumn("place", place).where("place <= 24").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(first, "source")


def _history(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("source_text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), "props")


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).orderBy(F.desc("timestamp"), F.desc("id")).limit(50).select("id", "source_text", "timestamp")


def history_search(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).where(F.lower("source_text").contains("click-1")).orderBy(F.desc("timestamp"), F.desc("id")).limit(20).select("id", "source_text", "timestamp")


def history_prune(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d)
    kept = h.orderBy(F.desc("timestamp"), F.desc("id")).limit(500).select("id")
    return h.join(kept, "id", "left_anti").agg(F.count(F.lit(1)).alias("deleted"), F.max("timestamp").alias("newest"))


def history_results(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return batching.exact_stats(_read(spark, d, "events"), "event_type", "value")


def bilingual_zip(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "documents").select((F.col("doc_id") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    left = lines.where("side = 0").select("pair", "i", F.col("line").alias("original"))
    right = lines.where("side = 1").select("pair", "i", F.col("line").alias("translated"))
    zipped = batching.zip_lines(left, right, ["pair", "i"])
    return zipped.select("pair", F.col("i").cast("long").alias("i"), F.md5(F.concat("original", F.lit("\n"), "translated")).alias("md5"))


def contiguous_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return batching.islands(rows, "l_orderkey", "l_linenumber")


def _chunks(spark: SparkSession, d: str, ends: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.posexplode(batching.chunked(F.col("text"), ends, CHUNK)).alias("i", "chunk"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("chunk").alias("md5"), F.char_length("chunk").cast("long").alias("n"))


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, ENDS)


def message_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Messages have no full stop among their sentence ends."""
    return _chunks(spark, d, MESSAGE_ENDS)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each line of each document, laid out by arithmetic; the document is the page."""
    lines = _read(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("box", "line"))
    n = F.char_length("line")
    lines = lines.withColumn("x0", ((F.col("box") * 97 + n * 13) % 560).cast("double")).withColumn("y0", ((F.col("box") * 61 + n * 7) % 840).cast("double"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("text", "title", "table", "figure", "footer")]), (n % 5 + 1).cast("int"))
    return lines.select("page", F.col("box").cast("long").alias("box"), "x0", "y0", (F.col("x0") + 20 + n % 200).alias("x1"), (F.col("y0") + 12 + n % 48).alias("y1"), label.alias("label"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return layout.overlaps(boxes(spark, d), 0.5)


def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    points = b.select("page", F.col("box").alias("point"), ((F.col("x0") * 3) % 800).alias("x"), ((F.col("y0") * 5) % 900).alias("y"))
    return layout.region_at(points, b)


def page_statistics(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_statistics(boxes(spark, d), PAGE_H, PAGE_W)


def coordinate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return layout.clusters(boxes(spark, d), "page", "x0", 5.0)


def double_copies(spark: SparkSession, d: str) -> DataFrame:
    """Events as copies; minutes of the table count as milliseconds, which gives gaps of the size that the rule is about."""
    e = _read(spark, d, "events").select("user_id", "event_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("ms"), F.col("event_type").alias("payload"))
    return deltas.double_copy_rows(e, "user_id", "event_id", "ms", "payload")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    line = F.format_string("%d. [[ID:%d]] %s", "i", "i", "text")
    numbered = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("items"))
    filled = F.replace(F.replace(F.lit("Style: {style}\n===INPUT_TEXT===\n{items}"), F.lit("{style}"), F.lit("minimal")), F.lit("{items}"), F.col("items"))
    marked = F.replace(filled, F.lit("===INPUT_TEXT==="), F.lit("Keep ids.\n===INPUT_TEXT==="))
    return numbered.select("conv_id", F.md5(marked).alias("md5"), F.char_length(marked).cast("long").alias("n"))


def languages_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.char_length("text")).alias("chars"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        batch_pack, dedupe_expand, cache_stats, glossary_topk, char_budget, section_filter, section_summary, history_recent, history_search, history_prune, history_results, latency_stats,
        bilingual_zip, contiguous_ranges, sentence_chunks, message_chunks, box_overlaps, region_lookup, page_statistics, coordinate_clusters, double_copies, prompts, languages_by_source,
    )
}

_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents"
_HISTORY = "SELECT event_id AS id, event_type || '-' || user_id AS source_text, strftime(ts, '%Y-%m-%dT%H:%M') AS timestamp, props FROM events"
_BOXES = f"""SELECT page, box, x0, y0, x0 + 20 + n % 200 AS x1, y0 + 12 + n % 48 AS y1, (['text', 'title', 'table', 'figure', 'footer'])[n % 5 + 1] AS label FROM (
  SELECT doc_id AS page, i AS box, length(line) AS n, ((i * 97 + length(line) * 13) % 560)::DOUBLE AS x0, ((i * 61 + length(line) * 7) % 840)::DOUBLE AS y0 FROM ({_LINES}))"""



def _chunks_sql(ends: str) -> str:
    ends = ends.replace("\n", "\\n")
    return f"""
WITH RECURSIVE p AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[^{ends}]*[{ends}]|[^{ends}]+'), lambda x: regexp_extract_all(x, '(?s).{{1,{CHUNK // 4}}}.{{0,{CHUNK // 4}}}.{{0,{CHUNK // 4}}}.{{0,{CHUNK // 4}}}'))) AS p FROM documents),
t AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS s FROM p),
r AS (
  SELECT doc_id, k, 0 AS i, length(s) AS held, s FROM t WHERE k = 1
  UNION ALL
  SELECT t.doc_id, t.k, CASE WHEN r.held + length(t.s) <= {CHUNK} THEN r.i ELSE r.i + 1 END, CASE WHEN r.held + length(t.s) <= {CHUNK} THEN r.held + length(t.s) ELSE length(t.s) END, t.s
  FROM r JOIN t ON t.doc_id = r.doc_id AND t.k = r.k + 1),
c AS (SELECT doc_id, i, trim(string_agg(s, '' ORDER BY k), {Oracle().text(BLANKS + chr(28) + chr(29) + chr(30) + chr(31))}) AS chunk FROM r GROUP BY doc_id, i)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, md5(chunk) AS md5, length(chunk) AS n FROM c WHERE chunk <> ''"""


SQL: dict[str, str] = {
    "batch_pack": f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (
  SELECT conv_id, turn, n, r, 1 AS batch, CASE WHEN n > {LIMIT} THEN 0 ELSE n END AS held, n <= {LIMIT} AS open FROM t WHERE r = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.n, t.r,
    CASE WHEN w.open AND t.n <= {LIMIT} AND w.held + t.n <= {LIMIT} THEN w.batch ELSE w.batch + 1 END,
    CASE WHEN t.n > {LIMIT} THEN 0 WHEN w.open AND w.held + t.n <= {LIMIT} THEN w.held + t.n ELSE t.n END, t.n <= {LIMIT}
  FROM w JOIN t ON t.conv_id = w.conv_id AND t.r = w.r + 1)
SELECT conv_id, turn, n AS size, batch FROM w""",
    "dedupe_expand": """
SELECT conv_id, turn, first, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS slot, md5(text) AS text_md5
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, text) AS first FROM conversations)""",
    "cache_stats": """
WITH k AS (SELECT lang, lang || '|' || trim(text, ' ') AS key, count(*) AS n, max(strlen(text)) AS b FROM documents GROUP BY ALL)
SELECT lang, sum(n - 1) AS hits, count(*) AS misses, round(100.0 * sum(n - 1) / sum(n), 1) AS hit_rate, round(sum(b) / 1024.0, 3) AS kb FROM k GROUP BY lang""",
    "glossary_topk": r"""
WITH g AS (
  SELECT DISTINCT term, ('0x' || substr(md5(term), 1, 8))::BIGINT AS rule
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM benchmark)),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM documents),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, rule) AS place FROM w JOIN g USING (term))
SELECT doc_id, count(*) AS n, count(*) > 40 AS truncated, string_agg(term, ',' ORDER BY place) FILTER (place <= 40) AS terms FROM r GROUP BY doc_id""",
    "char_budget": f"""
WITH l AS (SELECT * FROM ({_LINES}) WHERE trim(line, ' ') <> ''),
b AS (SELECT doc_id, sum(length(line) + 1) OVER w - 1 AS used, count(*) OVER w AS place FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, count(*) AS n, max(used) AS used FROM b WHERE used <= 2000 AND place <= 40 GROUP BY doc_id""",
    "section_filter": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "section_summary": """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT source, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (place <= 24) AS first_ids FROM d GROUP BY source""",
    "history_recent": f"SELECT id, source_text, timestamp FROM ({_HISTORY}) ORDER BY timestamp DESC, id DESC LIMIT 50",
    "history_search": f"SELECT id, source_text, timestamp FROM ({_HISTORY}) WHERE source_text ILIKE '%click-1%' ORDER BY timestamp DESC, id DESC LIMIT 20",
    "history_prune": f"WITH h AS ({_HISTORY}) SELECT count(*) AS deleted, max(timestamp) AS newest FROM h WHERE id NOT IN (SELECT id FROM h ORDER BY timestamp DESC, id DESC LIMIT 500)",
    "history_results": f"SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, max(id) AS last FROM ({_HISTORY}) GROUP BY ALL",
    "latency_stats": """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type),
j AS (SELECT *, greatest(1, least(19 * (n + 1) // 20, n - 1)) AS j FROM s)
SELECT event_type, n, v[1] AS least, v[n] AS most, round(list_sum(v) / n, 6) AS mean, round((v[(n + 1) // 2] + v[n // 2 + 1]) / 2, 6) AS p50,
  round(CASE WHEN n >= 20 THEN (v[j] * (20 - (19 * (n + 1) - 20 * j)) + v[j + 1] * (19 * (n + 1) - 20 * j)) / 20 ELSE v[n] END, 6) AS p95 FROM j""",
    "bilingual_zip": f"""
WITH l AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, i, line FROM ({_LINES}))
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.i, b.i) AS i, md5(coalesce(a.line, '') || chr(10) || coalesce(b.line, '')) AS md5
FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.pair = b.pair AND a.i = b.i""",
    "contiguous_ranges": """
WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'),
g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM r)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM g GROUP BY l_orderkey, island""",
    "sentence_chunks": _chunks_sql(ENDS),
    "message_chunks": _chunks_sql(MESSAGE_ENDS),
    "box_overlaps": f"""
WITH b AS ({_BOXES}), p AS (
  SELECT a.page, a.box AS a, b.box AS b,
    (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS ratio
  FROM b a JOIN b ON a.page = b.page AND a.box <> b.box AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT page, a, b, round(ratio, 6) AS ratio FROM p WHERE ratio >= 0.5""",
    "region_lookup": f"""
WITH b AS ({_BOXES}), p AS (SELECT page, box AS point, (x0 * 3) % 800 AS x, (y0 * 5) % 900 AS y FROM b)
SELECT p.page, p.point, coalesce(arg_max(b.label, b.box), 'background') AS label
FROM p LEFT JOIN b ON b.page = p.page AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY p.page, p.point""",
    "page_statistics": f"""
WITH b AS (SELECT *, (y1 - y0) > 2 * (x1 - x0) AS tall, (x1 - x0) * (y1 - y0) AS area FROM ({_BOXES}))
SELECT page, count(*) AS n, greatest(10, min(x0)) AS "left", greatest(10, {PAGE_W} - max(x1))::DOUBLE AS "right", greatest(10, min(y0)) AS top, greatest(10, {PAGE_H} - max(y1))::DOUBLE AS bottom,
  count(*) FILTER ((y0 + y1) / 2 < 0.05 * {PAGE_H}) AS header, count(*) FILTER ((y0 + y1) / 2 > 0.95 * {PAGE_H}) AS footer, count(*) FILTER (x1 - x0 < 32 OR y1 - y0 < 32) AS noise,
  CASE WHEN count(*) >= 3 AND count(*) FILTER (tall) >= 0.7 * count(*) THEN 'right2left' ELSE 'top2bottom' END AS direction,
  CASE WHEN coalesce(sum(area) FILTER (tall), 0) / sum(area) >= 0.7 THEN 'right2left' ELSE 'top2bottom' END AS direction_by_area
FROM b GROUP BY page""",
    "coordinate_clusters": f"""
WITH v AS (SELECT DISTINCT page, x0 FROM ({_BOXES})),
g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) > 5 THEN 1 ELSE 0 END AS new FROM v),
c AS (SELECT page, x0, sum(new) OVER (PARTITION BY page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT page, cluster::BIGINT AS cluster, count(*) AS n, round(avg(x0), 6) AS mean FROM c GROUP BY page, cluster""",
    "double_copies": """
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, floor(epoch_us(ts) / 60000000)::BIGINT AS ms, event_type AS p, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 60000000), event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, ms, i, p AS last, ms AS at, '' AS fired, -1000000000 AS fired_at, false AS hit FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, ms, i, CASE WHEN now THEN '' ELSE p END, ms, CASE WHEN now THEN p ELSE fired END, CASE WHEN now THEN ms ELSE fired_at END, now FROM (
    SELECT e.user_id, e.event_id, e.ms, e.i, e.p, r.fired, r.fired_at, e.p = r.last AND e.ms - r.at BETWEEN 20 AND 2500 AND (r.fired <> e.p OR e.ms - r.fired_at >= 1200) AS now FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, ms FROM r WHERE hit""",
    "prompts": """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, 'Style: minimal' || chr(10) || 'Keep ids.' || chr(10) || '===INPUT_TEXT===' || chr(10) || string_agg(i || '. [[ID:' || i || ']] ' || text, chr(10) ORDER BY i) AS prompt FROM t GROUP BY conv_id)
SELECT conv_id, md5(prompt) AS md5, length(prompt) AS n FROM p""",
    "languages_by_source": "SELECT source, lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY source, lang",
}
