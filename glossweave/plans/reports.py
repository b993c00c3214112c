"""Queries with a statement for each engine: reports, history, files as rows, and small text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.functions import forms as f
from glossweave.functions.dialect import Dialect
from glossweave.functions.text import filled
from glossweave.operators import sheets
from glossweave.plans import steps
from glossweave.sources import samples

FORMULAS = ["a+b", "x^2", "∑", "π"]
LABELS = ["glossary.csv", "glossary"]


def text_rules(d: Dialect) -> steps.Plan:
    source = f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM ({samples.values(samples.FORMS, d)}) AS a(id, text)"
    x, formulas = filled(d, "text"), d.array(*[d.text(v) for v in FORMULAS])
    todo = [
        ("unescaped", f.unescaped(d, x)), ("uncited", f.without_citations(d, x, LABELS)), ("restored", f.restored(d, x, formulas)), ("formulas", f.numbered_formulas(d, x, formulas)), ("devices", f.devices(d, x)),
        ("width", f"CAST({f.text_width(d, x, '10.5')} AS DOUBLE)"), ("model", f.is_translation_model(d, "text")), ("script", f.with_script(d, x)), ("n", d.integer(f"length({x})")),
    ]
    font = "CASE id % 4 WHEN 0 THEN 'ABCDEF+CMSY10' WHEN 1 THEN 'Arial' WHEN 2 THEN 'Latin Modern Math' ELSE '' END"
    todo += [("first_formula", f.is_formula_char(d, font, f"substr({x}, 1, 1)")), ("swapped", f.swapped(d, f"CASE WHEN id % 3 = 0 THEN '{f.DETECT}' ELSE 'en' END", f"CASE WHEN id % 5 = 0 THEN '{f.AUTO}' ELSE 'ja' END"))]
    todo += [("size", f.size_words(d, "(n * 337)", False)), ("bytes", f.size_words(d, "(n * n * n * 3)", True)), ("font_size", "CASE WHEN id % 2 = 0 THEN least(n / 100.0, greatest(n / 100.0 + 0.0, 8.0)) ELSE n / 100.0 END")]
    keep = ["unescaped", "uncited", "restored", "formulas", "devices", "width", "model", "script", "first_formula", "swapped", "size", "bytes"]
    return source, todo, ["id", *keep, "CAST(font_size AS DOUBLE) AS font_size"]


_H = {
    "spark": "SELECT event_id AS id, concat(event_type, '-', user_id) AS source_text, date_format(ts, \"yyyy-MM-dd'T'HH:mm\") AS timestamp, props, event_type, value, user_id FROM events ",
    "oracle": "SELECT event_id AS id, event_type || '-' || user_id AS source_text, strftime(ts, '%Y-%m-%dT%H:%M') AS timestamp, props, event_type, value, user_id FROM events ",
}
_PARTS = {
    "spark": "SELECT doc_id, i, part FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS i, part",
    "oracle": "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS part FROM documents ",
}

#: name -> (Spark statement, oracle statement, tables)
STATEMENTS: dict[str, tuple[str, str, list[str]]] = {
    "run_table": (
        "SELECT event_id, event_type, try_cast(get_json_object(props, '$.k') AS BIGINT) AS k, try_cast(get_json_object(props, '$.note') AS DOUBLE) AS note, try_cast(concat(event_type, value) AS DOUBLE) AS bad, try_cast(CAST(value AS STRING) AS DOUBLE) AS seconds FROM events ",
        "SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(json_extract_string(props, '$.note') AS DOUBLE) AS note, try_cast(event_type || value AS DOUBLE) AS bad, try_cast(value::VARCHAR AS DOUBLE) AS seconds FROM events ",
        ["events"],
    ),
    "selected_sections": (
        "SELECT source, CAST(size(filter(s, x -> x.selected)) AS BIGINT) AS selected, array_join(transform(filter(s, x -> x.selected), x -> CAST(x.i AS STRING)), ',') AS indices, CASE WHEN size(s) = 0 THEN CAST(0 AS BIGINT) ELSE CAST(size(s) AS BIGINT) END AS sections FROM (SELECT source, array_sort(collect_list(struct(doc_id AS i, n_chars % 3 = 0 AS selected))) AS s FROM documents GROUP BY source)",
        "SELECT source, count(*) FILTER (n_chars % 3 = 0) AS selected, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (n_chars % 3 = 0), '') AS indices, count(*) AS sections FROM documents GROUP BY source",
        ["documents"],
    ),
    "output_files": (
        "SELECT key, min_by(url, page_id) AS url, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, url, lower(regexp_replace(url, '[?].*$', '')) AS key FROM pages ) GROUP BY key",
        "SELECT key, arg_min(url, page_id) AS url, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, url, lower(split_part(url, '?', 1)) AS key FROM pages ) GROUP BY key",
        ["pages"],
    ),
    "warnings_by_source": (
        "SELECT source, array_join(array_sort(collect_set(w)), '|') AS warnings FROM (SELECT source, explode_outer(filter(array(CASE WHEN lang <> 'en' THEN concat('lang:', lang) END, CASE WHEN n_chars > 9000 THEN 'long' END, CASE WHEN n_chars < 30 THEN 'short' END), x -> x IS NOT NULL)) AS w FROM documents ) GROUP BY source",
        "SELECT source, coalesce(string_agg(DISTINCT w, '|' ORDER BY w), '') AS warnings FROM (SELECT source, 'lang:' || lang AS w FROM documents WHERE lang <> 'en' UNION ALL SELECT source, 'long' FROM documents WHERE n_chars > 9000 UNION ALL SELECT source, 'short' FROM documents WHERE n_chars < 30 UNION ALL SELECT source, NULL FROM documents) GROUP BY source",
        ["documents"],
    ),
    "batch_limits": (
        "SELECT event_id, coalesce(CASE WHEN k > 20 THEN k END, CASE WHEN user_id > 3 THEN user_id END, 0) AS batch_limit, CASE WHEN k > 20 THEN 'file' WHEN user_id > 3 THEN 'generic' END AS limit_source FROM (SELECT event_id, user_id, try_cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM events )",
        "SELECT event_id, CASE WHEN k > 20 THEN k WHEN user_id > 3 THEN user_id ELSE 0 END AS batch_limit, CASE WHEN k > 20 THEN 'file' WHEN user_id > 3 THEN 'generic' END AS limit_source FROM (SELECT event_id, user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events )",
        ["events"],
    ),
    "sweep_grid": (
        "SELECT region, ctx, chars, concat('- ', region, ' ctx=', ctx, ' chars=', chars) AS line FROM (SELECT r_name AS region, explode(array(2048, 4096)) AS ctx FROM region ) LATERAL VIEW explode(array(600, 1000, 1400)) c AS chars",
        "SELECT r_name AS region, ctx, chars, '- ' || r_name || ' ctx=' || ctx || ' chars=' || chars AS line FROM region, (VALUES (2048), (4096)) a(ctx), (VALUES (600), (1000), (1400)) b(chars)",
        ["region"],
    ),
    "log_tail": (
        "SELECT doc_id, md5(tail) AS tail_md5, contains(lower(tail), 'and') AS found FROM (SELECT doc_id, substring(text, greatest(CAST(doc_id % 40 AS INT), length(text) - 500) + 1) AS tail FROM documents )",
        "SELECT doc_id, md5(tail) AS tail_md5, contains(lower(tail), 'and') AS found FROM (SELECT doc_id, substr(text, greatest(doc_id % 40, length(text) - 500) + 1) AS tail FROM documents )",
        ["documents"],
    ),
    "recent_flags": (
        "SELECT event_id, coalesce(timestampdiff(SECOND, try_to_timestamp(raw), TIMESTAMP '2024-01-15 00:00:00') <= 604800, false) AS recent FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'never' WHEN 1 THEN '' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS raw FROM events )",
        "SELECT event_id, coalesce(date_diff('second', try_cast(raw AS TIMESTAMP), TIMESTAMP '2024-01-15 00:00:00') <= 604800, false) AS recent FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'never' WHEN 1 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events )",
        ["events"],
    ),
    "rechecked_times": (
        "SELECT event_id, CASE WHEN lag(event_type) OVER w = event_type THEN lag(event_id) OVER w ELSE event_id END AS stamped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
        "SELECT e.event_id, CASE WHEN p.event_type = e.event_type THEN p.event_id ELSE e.event_id END AS stamped FROM events e LEFT JOIN (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, event_type FROM events) p ON p.nxt = e.event_id",
        ["events"],
    ),
    "glossary_updates": (
        "SELECT doc_id, CASE WHEN new IS NULL THEN 'none' WHEN user = new THEN 'keep' WHEN user = old THEN 'replace' ELSE 'backup' END AS action FROM (SELECT doc_id, md5(lang) AS user, lead(md5(lang)) OVER w AS new, lag(md5(lang)) OVER w AS old FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))",
        "SELECT doc_id, CASE WHEN new IS NULL THEN 'none' WHEN lang = new THEN 'keep' WHEN lang = old THEN 'replace' ELSE 'backup' END AS action FROM (SELECT doc_id, lang, lead(lang) OVER w AS new, lag(lang) OVER w AS old FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))",
        ["documents"],
    ),
    "history_after_delete": (
        f"SELECT count_if(x.timestamp IS NULL) AS kept, count(x.timestamp) AS deleted, max(CASE WHEN x.timestamp IS NULL THEN id END) AS last_id FROM ({_H['spark']}) AS h LEFT JOIN (SELECT DISTINCT timestamp FROM ({_H['spark']}) WHERE id % 50 = 0) AS x ON x.timestamp = h.timestamp",
        f"WITH h AS ({_H['oracle']}), x AS (SELECT DISTINCT timestamp FROM h WHERE id % 50 = 0) SELECT count(*) FILTER (x.timestamp IS NULL) AS kept, count(x.timestamp) AS deleted, max(CASE WHEN x.timestamp IS NULL THEN id END) AS last_id FROM h LEFT JOIN x ON x.timestamp = h.timestamp",
        ["events"],
    ),
    "history_rows": (
        f"SELECT id, get_json_object(j, '$.source_text') AS source_text, coalesce(get_json_object(j, '$.output_language'), CASE WHEN get_json_object(j, '$.detected_language') = '日本語' THEN 'en' WHEN get_json_object(j, '$.detected_language') IS NOT NULL THEN 'jp' ELSE 'en' END) AS output_language, get_json_object(j, '$.options[0].explanation') AS explanation, get_json_object(j, '$.options[0].text') AS option_text, CAST(get_json_object(j, '$.options[0].char_count') AS BIGINT) AS chars FROM (SELECT id, to_json(named_struct('source_text', source_text, 'output_language', CASE WHEN id % 4 = 0 THEN 'en' END, 'detected_language', CASE id % 3 WHEN 0 THEN '日本語' WHEN 1 THEN '英語' END, 'options', array(named_struct('text', concat(event_type, ' \"q\"'), 'explanation', '', 'char_count', length(event_type) + 4)))) AS j FROM ({_H['spark']}))",
        f"SELECT id, source_text, CASE WHEN id % 4 = 0 OR id % 3 = 0 OR id % 3 = 2 THEN 'en' ELSE 'jp' END AS output_language, '' AS explanation, event_type || ' \"q\"' AS option_text, length(event_type) + 4 AS chars FROM ({_H['oracle']})",
        ["events"],
    ),
    "history_head": (
        f"SELECT id, source_text FROM (SELECT id, source_text, user_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS place FROM ({_H['spark']})) WHERE place <= 50",
        f"SELECT id, source_text FROM ({_H['oracle']}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) <= 50",
        ["events"],
    ),
    "bilingual_kinds": (
        "SELECT page_id, suffix, CASE WHEN suffix IN ('.xlsx', '.xls') THEN 'sheets' WHEN suffix = '.docx' THEN 'paragraphs' WHEN suffix = '.pptx' THEN 'slides' WHEN suffix = '.txt' THEN 'lines' END AS kind FROM (SELECT page_id, element_at(array('.xlsx', '.xls', '.xlsm', '.csv', '.docx', '.pptx', '.pdf', '.txt', '.msg'), CAST(page_id % 9 + 1 AS INT)) AS suffix FROM pages )",
        "SELECT page_id, suffix, CASE suffix WHEN '.xlsx' THEN 'sheets' WHEN '.xls' THEN 'sheets' WHEN '.docx' THEN 'paragraphs' WHEN '.pptx' THEN 'slides' WHEN '.txt' THEN 'lines' END AS kind FROM (SELECT page_id, (['.xlsx', '.xls', '.xlsm', '.csv', '.docx', '.pptx', '.pdf', '.txt', '.msg'])[page_id % 9 + 1] AS suffix FROM pages )",
        ["pages"],
    ),
    "scanned_files": (
        "SELECT file, max(chars) = 0 AS scanned FROM (SELECT doc_id div 4 AS file, doc_id % 4 AS page, CASE WHEN n_chars < 400 OR doc_id div 4 % 5 = 0 THEN 0 ELSE n_chars END AS chars FROM documents ) WHERE page < 3 GROUP BY file",
        "SELECT file, max(chars) = 0 AS scanned FROM (SELECT doc_id // 4 AS file, doc_id % 4 AS page, CASE WHEN n_chars < 400 OR (doc_id // 4) % 5 = 0 THEN 0 ELSE n_chars END AS chars FROM documents ) WHERE page < 3 GROUP BY file",
        ["documents"],
    ),
    "detection_samples": (
        f"SELECT doc_id, md5(substring(array_join(transform(slice(array_sort(collect_list(struct(i, part))), 1, 5), x -> x.part), ' '), 1, 500)) AS sample_md5 FROM (SELECT doc_id, i, part, count_if(true) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM ({_PARTS['spark']}) WHERE trim(part) <> '') WHERE place <= 5 GROUP BY doc_id",
        f"SELECT doc_id, md5(substr(string_agg(part, ' ' ORDER BY i), 1, 500)) AS sample_md5 FROM (SELECT doc_id, i, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM ({_PARTS['oracle']}) WHERE trim(part, ' ') <> '') WHERE place <= 5 GROUP BY doc_id",
        ["documents"],
    ),
    "pair_export": (
        "SELECT a.conv_id, a.turn, md5(a.text) AS original, md5(b.text) AS translated FROM (SELECT * FROM conversations ) a JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations ) b USING (conv_id, turn)",
        "SELECT conv_id, turn, md5(text) AS original, md5(nxt) AS translated FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) WHERE t = turn + 1",
        ["conversations"],
    ),
    "file_catalogue": (
        f"SELECT doc_id, count_if(trim(part) <> '') AS page_count, CASE WHEN count_if(trim(part) <> '') > 1 THEN count_if(trim(part) <> '') ELSE 0 END AS sections FROM ({_PARTS['spark']}) GROUP BY doc_id",
        f"SELECT doc_id, count(*) FILTER (trim(part, ' ') <> '') AS page_count, CASE WHEN count(*) FILTER (trim(part, ' ') <> '') > 1 THEN count(*) FILTER (trim(part, ' ') <> '') ELSE 0 END AS sections FROM ({_PARTS['oracle']}) GROUP BY doc_id",
        ["documents"],
    ),
    "interleaved_pages": (
        "SELECT source, doc_id, side, CAST(2 * (row_number() OVER (PARTITION BY source, side ORDER BY doc_id) - 1) + side AS BIGINT) AS place FROM (SELECT source, doc_id, explode(array(0, 1)) AS side FROM documents )",
        "SELECT source, doc_id, side, row_number() OVER (PARTITION BY source ORDER BY doc_id, side) - 1 AS place FROM documents, (VALUES (0), (1)) s(side)",
        ["documents"],
    ),
    "message_parts": (
        "SELECT doc_id, section, md5(part) AS md5 FROM (SELECT doc_id, i AS section, part FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS i, part) WHERE trim(part) <> ''",
        f"SELECT doc_id, i AS section, md5(part) AS md5 FROM ({_PARTS['oracle']}) WHERE trim(part, ' ') <> ''",
        ["documents"],
    ),
    "message_rebuild": (
        f"SELECT doc_id, md5(array_join(transform(array_sort(collect_list(struct(i, CASE WHEN trim(part) = '' THEN part ELSE reverse(part) END AS t))), x -> x.t), '\\n')) AS md5 FROM ({_PARTS['spark']}) GROUP BY doc_id",
        f"SELECT doc_id, md5(string_agg(CASE WHEN trim(part, ' ') = '' THEN part ELSE reverse(part) END, chr(10) ORDER BY i)) AS md5 FROM ({_PARTS['oracle']}) GROUP BY doc_id",
        ["documents"],
    ),
    "block_kinds": (
        "SELECT doc_id, CASE WHEN regexp_like(text, '[@#$%&*]{2}') THEN 'formula' WHEN n_chars < 120 THEN 'skipped' ELSE 'translated' END AS kind, CASE WHEN regexp_like(text, '[@#$%&*]{2}') THEN md5(text) WHEN n_chars < 120 THEN NULL ELSE md5(reverse(text)) END AS out FROM documents ",
        "SELECT doc_id, kind, CASE kind WHEN 'formula' THEN md5(text) WHEN 'translated' THEN md5(reverse(text)) END AS out FROM (SELECT *, CASE WHEN regexp_matches(text, '[@#$%&*]{2}') THEN 'formula' WHEN n_chars < 120 THEN 'skipped' ELSE 'translated' END AS kind FROM documents)",
        ["documents"],
    ),
    "copy_payloads": (
        "SELECT conv_id, md5(array_join(transform(array_sort(collect_list(struct(style, label, text))), x -> concat('[', x.label, ']\\n', x.text)), '\\n\\n')) AS md5, count(*) AS options FROM (SELECT conv_id, CAST(turn % 4 AS INT) AS style, element_at(array('standard', 'concise', 'minimal', 'other'), CAST(turn % 4 + 1 AS INT)) AS label, min_by(text, turn) AS text FROM conversations GROUP BY conv_id, turn % 4) GROUP BY conv_id",
        "SELECT conv_id, md5(string_agg('[' || (['standard', 'concise', 'minimal', 'other'])[style + 1] || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY style)) AS md5, count(*) AS options FROM (SELECT conv_id, turn % 4 AS style, arg_min(text, turn) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id",
        ["conversations"],
    ),
    "json_literals": (
        "SELECT doc_id, md5(substring(to_json(named_struct('a', text)), 6, length(to_json(named_struct('a', text))) - 6)) AS md5 FROM documents ",
        "SELECT doc_id, md5(to_json(text)::VARCHAR) AS md5 FROM documents ",
        ["documents"],
    ),
    "cache_keys": (
        "SELECT conv_id, turn, md5(concat_ws('|', 'en', 'minimal', text)) AS key_en, md5(concat_ws('|', 'jp', text)) AS key_jp FROM conversations ",
        "SELECT conv_id, turn, md5('en|minimal|' || text) AS key_en, md5('jp|' || text) AS key_jp FROM conversations ",
        ["conversations"],
    ),
    "limited_texts": (
        "SELECT conv_id, turn, substring(text, 1, CAST(greatest(0, 900 - before) AS INT)) AS kept, before + length(text) > 900 AS truncated FROM (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations )",
        "SELECT conv_id, turn, CASE WHEN before >= 900 THEN '' ELSE substr(text, 1, (900 - before)::INT) END AS kept, before + length(text) > 900 AS truncated FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)",
        ["conversations"],
    ),
    "merged_areas": (
        "SELECT a.l_orderkey, a.l_linenumber, coalesce(min(b.l_linenumber), 0) AS area FROM (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS r, l_suppkey % 10 AS c FROM lineitem ) a LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS r1, l_suppkey % 10 AS c1, l_partkey % 10 + l_quantity % 4 AS r2, l_suppkey % 10 + l_quantity % 3 AS c2 FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey = b.l_orderkey AND a.r BETWEEN b.r1 AND b.r2 AND a.c BETWEEN b.c1 AND b.c2 GROUP BY a.l_orderkey, a.l_linenumber",
        "SELECT l_orderkey, l_linenumber, coalesce(min(area), 0) AS area FROM (SELECT a.l_orderkey, a.l_linenumber, (SELECT min(b.l_linenumber) FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_orderkey = b.l_orderkey AND a.l_partkey % 10 >= b.l_partkey % 10 AND a.l_partkey % 10 <= b.l_partkey % 10 + b.l_quantity % 4 AND a.l_suppkey % 10 >= b.l_suppkey % 10 AND a.l_suppkey % 10 <= b.l_suppkey % 10 + b.l_quantity % 3) AS area FROM lineitem a) GROUP BY l_orderkey, l_linenumber",
        ["lineitem"],
    ),
}


def _spark(statement: str, tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(steps.bound(statement, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    return run


_SHEET_IDS = "concat(substring(source, 1, 4), CASE WHEN doc_id % 3 = 0 THEN '_x' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN '_A1' WHEN 1 THEN '_shape_2' WHEN 2 THEN '_BC12' ELSE '_a1' END)"


def sheet_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of sheets that hold for all documents, so there is no workbook to join on; numbers of shapes and names of charts alone count."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.select("source").distinct().selectExpr("explode(array(substring(source, 1, 4), concat(substring(source, 1, 4), '_x'))) AS sheet")
    found = sheets.routed(docs.selectExpr("doc_id", f"{_SHEET_IDS} AS id"), names, [])
    return found.where("regexp_like(suffix, '^([A-Z]+[0-9]+|shape_[0-9]+|chart_.+)$')").select("doc_id", "id", "sheet").distinct()


QUERIES = {name: _spark(s, tables) for name, (s, _, tables) in STATEMENTS.items()} | {"text_rules": steps.query(text_rules, ["documents"]), "sheet_routing": sheet_routing}
SQL = {name: o for name, (_, o, _) in STATEMENTS.items()} | {
    "text_rules": steps.oracle(text_rules),
    "sheet_routing": "SELECT doc_id, id, arg_max(sheet, length(sheet)) AS sheet FROM (SELECT doc_id, substr(source, 1, 4) || CASE WHEN doc_id % 3 = 0 THEN '_x' ELSE '' END || (['_A1', '_shape_2', '_BC12', '_a1'])[doc_id % 4 + 1] AS id FROM documents) d JOIN (SELECT DISTINCT unnest([substr(source, 1, 4), substr(source, 1, 4) || '_x']) AS sheet FROM documents) s ON starts_with(id, sheet || '_') AND regexp_matches(substr(id, length(sheet) + 2), '^([A-Z]+[0-9]+|shape_[0-9]+|chart_.+)$') GROUP BY doc_id, id",
}
