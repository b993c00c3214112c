"""Queries on the language of replies, whole and while they stream."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import guards
from glossweave.functions.dialect import Dialect, Oracle, Spark
from glossweave.plans import steps
from glossweave.sources import samples
from glossweave.streaming import guard

MORE = ["２兆5,000億円", "2兆円", "▲300億", "−1,200億円 and 3万円", "△12円", "「quoted」、・", "売上 300億円", "ﾊﾟｰﾄ", "Sales 5億円、up", "100万円円"]


def _texts(d: Dialect) -> str:
    return f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT id + 100000000, text FROM ({samples.values(samples.TEXTS + MORE, d)}) AS s(id, text)"


def reply_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Spark()
    rows = spark.sql(steps.bound(_texts(d), ["documents"]), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.withColumn("form", guards.english_forms(F.col("text")))
    return rows.selectExpr("id", "md5(form) AS md5", f"{guards.mismatch(d, 'text', 'form', "'en'")} AS not_english", f"{guards.mismatch(d, 'text', 'form', "'JP'")} AS not_japanese")


def pieces(d: Dialect) -> str:
    """Turns as streams: pieces of two or seven characters every 20 to 140 ms, every fourth conversation with the whole text so far; rare letters of some are Japanese."""
    shown = f"CASE WHEN conv_id % 3 = 0 THEN {d.translate('text', 'qxzj', 'のがを人')} ELSE text END"
    width = "CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 7 END"
    count = d.div(f"(length(text) + {width} - 1)", f"({width})")
    each = {
        "spark": f"SELECT conv_id, turn, {shown} AS shown, {width} AS width, explode(sequence(CAST(1 AS BIGINT), CAST({count} AS BIGINT))) AS seq FROM conversations WHERE text <> ''",
        "oracle": f"SELECT conv_id, turn, {shown} AS shown, {width} AS width, unnest(range(1, {count} + 1)) AS seq FROM conversations WHERE text <> ''",
    }[d.name]
    start = "CAST((seq - 1) * width AS INT)"
    piece = f"CASE WHEN conv_id % 4 = 1 THEN substr(shown, 1, {start} + width) ELSE substr(shown, {start} + 1, width) END"
    return f"SELECT conv_id * 1000 + turn AS stream_id, seq, seq * (20 + conv_id % 5 * 30) AS ms, {piece} AS text FROM ({each}) AS e"


def stream_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(steps.bound(pieces(Spark()), ["conversations"]), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return guard.previews(rows).selectExpr("stream_id", "seq", "ms", "kind", "md5(preview) AS md5", "CAST(length(preview) AS BIGINT) AS n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (reply_languages, stream_previews)}


def _languages_sql() -> str:
    """Compatibility forms of the characters that the built-in texts have; the tables have none."""
    d = Oracle()
    x = "coalesce(text, '')"
    for c in sorted(set("".join(samples.TEXTS + MORE))):
        if (n := unicodedata.normalize("NFKC", c)) != c and c != "ﾟ":
            x = f"replace({x}, {d.text(c)}, {d.text(n)})"
    x = f"replace({x}, 'ハﾟ', 'パ')"
    x = d.strip(x)
    for a, b in guards.PUNCTUATION.items():
        x = f"replace({x}, {d.text(a)}, {d.text(b)})"
    number, sign = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)", r"(?:[▲△+−-])?\s*"
    signed = "CASE left(m, 1) WHEN '▲' THEN '-' WHEN '△' THEN '△' WHEN '+' THEN '+' WHEN '-' THEN '-' WHEN '−' THEN '−' ELSE '' END"
    amount = lambda unit: f"coalesce(try_cast(replace(regexp_extract(m, '([0-9,]+){unit}', 1), ',', '') AS BIGINT), 0)"
    say = lambda n, unit: f"{signed} || format('{{:,}}', {n}) || {unit}"
    large = d.rewrite("f", rf"{sign}(?:{number}兆(?:{number}億)?|{number}億)円?", "m", say(f"({amount('兆')} * 10000 + {amount('億')})", "CASE WHEN right(m, 1) = '円' THEN ' oku yen' ELSE ' oku' END"))
    man = d.rewrite("g", rf"{sign}{number}万円", "m", say(f"({amount('万円')} * 10)", "'k yen'"))
    yen = d.rewrite("h", rf"{sign}{number}円", "m", say(amount("円"), "' yen'"))
    return (
        f"SELECT id, md5(form) AS md5, {guards.mismatch(d, 'text', 'form', chr(39) + 'en' + chr(39))} AS not_english, {guards.mismatch(d, 'text', 'form', chr(39) + 'jp' + chr(39))} AS not_japanese "
        f"FROM (SELECT *, {yen} AS form FROM (SELECT *, {man} AS h FROM (SELECT *, {large} AS g FROM (SELECT *, {x} AS f FROM ({_texts(d)}) AS t) AS a) AS b) AS c) AS e"
    )


SQL: dict[str, str] = {
    "reply_languages": _languages_sql(),
    "stream_previews": f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ms, seq) AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM ({pieces(Oracle())}) AS e),
r AS (
  SELECT stream_id, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS ms, '' AS t, '' AS shown, -1000000000000000 AS last, true AS asks, false AS closed, '' AS kind FROM p WHERE i = 1
  UNION ALL
  SELECT stream_id, i, seq, ms, u, CASE WHEN kind = 'shown' THEN u ELSE shown END, CASE WHEN kind = 'shown' THEN ms ELSE last END, still, closed OR kind = 'closed', kind FROM (
    SELECT *, asks AND (u = shown OR length(prefix) < 256) AS still, CASE WHEN closed OR u = shown THEN '' WHEN asks AND regexp_matches(prefix, {Oracle().text(guards.NOT_ENGLISH)}) THEN 'closed' WHEN ms - last < 80 AND abs(length(u) - length(shown)) < 3 THEN '' ELSE 'shown' END AS kind FROM (
      SELECT *, left(ltrim(u, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 256) AS prefix FROM (
        SELECT p.stream_id, p.i, p.seq, p.ms, r.shown, r.last, r.asks, r.closed, CASE WHEN r.closed THEN r.t WHEN r.t <> '' AND starts_with(p.text, r.t) THEN p.text ELSE r.t || p.text END AS u FROM r JOIN p ON p.stream_id = r.stream_id AND p.i = r.i + 1)))),
o AS (
  SELECT stream_id, seq, ms, kind, CASE kind WHEN 'shown' THEN t ELSE '' END AS preview FROM r WHERE kind <> ''
  UNION ALL SELECT r.stream_id, r.seq, r.ms, 'last', t FROM r JOIN p ON p.stream_id = r.stream_id AND p.i = r.i AND p.i = p.n WHERE NOT closed AND t <> shown)
SELECT stream_id, seq, ms, kind, md5(preview) AS md5, length(preview) AS n FROM o""",
}
