"""Queries whose columns are portable expressions over texts, lines, pairs and replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.functions import geometry as g
from glossweave.functions import numbers as n
from glossweave.functions import replies as r
from glossweave.functions import text as t
from glossweave.functions.dialect import Dialect, Oracle, Spark
from glossweave.plans import steps
from glossweave.sources import samples

Columns = Callable[[Dialect], dict[str, str]]


def _texts(d: Dialect) -> str:
    return f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM ({samples.values(samples.TEXTS, d)}) AS s(id, text)"


def _lines(d: Dialect) -> str:
    if d.name == "spark":
        return f"SELECT id, CAST(i AS BIGINT) AS i, line FROM ({_texts(d)}) LATERAL VIEW posexplode({d.lines('text')}) AS i, line"
    return f"SELECT id, unnest(range(len({d.lines('text')}))) AS i, unnest({d.lines('text')}) AS line FROM ({_texts(d)})"


def _pairs(d: Dialect) -> str:
    return f"SELECT doc_id AS id, text AS source, text AS out FROM documents UNION ALL SELECT * FROM ({samples.values(samples.PAIRS, d)}) AS s(id, source, out)"


def _replies(d: Dialect) -> str:
    return f"SELECT event_id AS id, props AS text FROM events UNION ALL SELECT * FROM ({samples.values(samples.REPLIES, d)}) AS s(id, text)"


def _spans(d: Dialect) -> str:
    """A box for each order line, by arithmetic on its numbers."""
    f = "CAST({} AS DOUBLE)".format
    return (
        f"SELECT l_orderkey AS id, l_linenumber AS i, {f('l_quantity')} AS q, {f('l_partkey % 500')} AS x0, {f('l_partkey % 500 + l_suppkey % 90')} AS x1, "
        f"{f('l_suppkey % 700')} AS y0, {f('l_suppkey % 700 + l_partkey % 60')} AS y1, CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'footer' ELSE 'abstract' END AS label FROM lineitem"
    )


SOURCES = {"spans": (_spans, ["lineitem"]), "texts": (_texts, ["documents"]), "lines": (_lines, ["documents"]), "pairs": (_pairs, ["documents"]), "replies": (_replies, ["events"])}


def _text_predicates(d: Dialect) -> dict[str, str]:
    x = "text"
    return {
        "generic": t.should_translate_generic(d, x), "date_like": t.is_date_like(d, x), "numeric": t.is_numeric(d, x), "email": t.is_email(d, x), "url": t.is_url(d, x),
        "code": t.is_code(d, x), "percent": t.is_percent(d, x), "currency": t.is_currency(d, x), "japanese": t.contains_japanese(d, x), "japanese_only": t.is_japanese_only(d, x),
    }


def _should_translate(d: Dialect) -> dict[str, str]:
    x = "line"
    return {
        "i": "i", "cell_en": t.should_translate_cell(d, x), "cell_jp": t.should_translate_cell(d, x, "jp"), "paragraph_en": t.should_translate_paragraph(d, x),
        "paragraph_jp": t.should_translate_paragraph(d, x, "jp"), "pdf": t.should_translate_pdf(d, x),
    }


def _line_rules(d: Dialect) -> dict[str, str]:
    x = "line"
    return {
        "i": "i", "toc": t.is_toc_line(d, x), "title": t.toc_title(d, x), "page": t.toc_page(d, x), "hyphenated": t.is_hyphenated(d, x), "keeps_break": t.keeps_line_break(d, x),
        "continues": t.is_continuation(d, x),
    }


def _characters(d: Dialect) -> dict[str, str]:
    x = "text"
    kinds = {"hiragana": t.HIRAGANA, "katakana": t.KATAKANA, "ideographs": t.IDEOGRAPH, "hangul": t.HANGUL, "latin": t.LATIN, "punctuation": r"\p{P}"}
    return {k: t.count_of(d, x, v) for k, v in kinds.items()} | {"rare_ideographs": t.rare_ideographs(d, x), "separator": t.separator_for(d, x), "meaningful": f"length({t.meaningful(d, x)})"}


def _characters_in_steps(d: Dialect) -> steps.Plan:
    """The same as ``_characters``: ASCII letters, most of a text, are counted by one pass that takes them out, so the wide classes meet only the rest."""
    todo = [("others", d.sub(t.filled(d, "text"), "[A-Za-z]+")), ("beyond", d.sub("others", r"[\x{00}-\x{7F}]+")), ("letters", f"length({t.filled(d, 'text')}) - length(others)")]
    kinds = {"hiragana": t.HIRAGANA, "katakana": t.KATAKANA, "ideographs": t.IDEOGRAPH, "hangul": t.HANGUL}
    columns = {k: t.count_of(d, "beyond", v) for k, v in kinds.items()} | {
        "latin": f"letters + {t.count_of(d, 'beyond', t.LATIN)}", "punctuation": t.count_of(d, "others", r"\p{P}"), "rare_ideographs": t.rare_ideographs(d, "beyond"),
        "separator": f"CASE WHEN {t.count_of(d, 'beyond', t.KANA + t.IDEOGRAPH)} > letters THEN '' ELSE ' ' END", "meaningful": f"letters + length({t.meaningful(d, 'others')})",
    }
    return _texts(d), todo, ["id", *[f"{v} AS {k}" for k, v in columns.items()]]


def _detection(d: Dialect) -> steps.Plan:
    """The first 500 characters are cleaned once, and every other column follows from that."""
    x = t.filled(d, "text")
    todo = [("prefix", t.meaningful_prefix(d, "text")), ("reason", t.reason_of(d, "prefix")), ("lang", t.language_of_reason("reason"))]
    columns = {
        "japanese": t.is_japanese_of(d, x, "prefix"), "ratio": f"round({t.ratio_of(d, 'prefix')}, 9)", "direction": t.direction(d, "text"), "chinese": t.looks_chinese(d, "text"),
        "expected_en": t.is_expected_english(d, "text"), "expected_jp": f"({t.is_blank(d, 'text')} OR lang = '日本語')",
    }
    return _texts(d), todo, ["id", "lang", "reason", *[f"{v} AS {k}" for k, v in columns.items()]]


def _cleanup(d: Dialect) -> steps.Plan:
    x = "text"
    todo = [("fences", t.without_fences(d, x)), ("markers", t.without_markers(d, x)), ("attachments", t.without_attachments(d, x))]
    columns = {"item": t.item_of(d, "markers"), "plain": f"CASE WHEN fences = {t.filled(d, x)} THEN markers ELSE {d.strip(t.without_markers(d, 'fences'))} END", "negatives": t.negative_markers(d, x), "html": t.marked_up(d, x)}
    return _texts(d), todo, ["id", "fences", "markers", "attachments", *[f"{v} AS {k}" for k, v in columns.items()]]


def _names(d: Dialect) -> dict[str, str]:
    x = "text"
    return {
        "slug": t.slug(d, x), "file": t.safe_name(d, x), "sheet": t.sheet_name(d, x), "style": t.style_name(d, x), "key_en": t.cache_key(d, x, "en", "minimal"),
        "key_jp": t.cache_key(d, x, "jp", "minimal"), "code": t.folded_code(d, x), "preview": t.preview(d, x),
    }


def _measures(d: Dialect) -> dict[str, str]:
    x = "text"
    return {
        "tokens": t.estimated_tokens(d, x), "n": f"length({t.filled(d, x)})", "bytes": d.bytes(t.filled(d, x)), "head": t.fingerprint_head(d, x), "tail": t.fingerprint_tail(d, x),
        "sample": t.sampled(d, x), "limit_standard": n.length_limit(d, x, "standard"), "limit_concise": n.length_limit(d, x, "concise"), "limit_minimal": n.length_limit(d, x, "minimal"),
    }


def _amounts(d: Dialect) -> dict[str, str]:
    x = "text"
    total = d.fold(n.oku_amounts(d, x), "CAST(0 AS BIGINT)", "acc", "v", "acc + v")
    cast = {"spark": "STRING", "oracle": "VARCHAR"}[d.name]
    return {
        "oku": d.join(d.map(n.oku_amounts(d, x), "v", f"CAST(v AS {cast})"), ","), "thousands": d.join(d.map(n.k_amounts(d, x), "v", f"CAST(v AS {cast})"), ","),
        "months": d.join(d.map(n.months_of(d, x), "v", f"CAST(v AS {cast})"), ","), "total": n.oku_words(d, total).replace("STRING", cast),
        "yen": n.yen_words(d, f"({total} * 100000000 + length({t.filled(d, x)}))").replace("STRING", cast), "decimal": f"CAST({n.parsed_decimal(d, x)} AS DOUBLE)",
    }


def _guards(d: Dialect) -> dict[str, str]:
    s, o = "source", "out"
    return {
        "k": n.needs_k(d, s, o), "negative": n.needs_negative(d, s, o), "month": n.needs_month(d, s, o), "oku": n.needs_oku(d, s, o), "reasons": n.retry_reasons(d, s, o),
        "incomplete": n.is_incomplete(d, s, o), "ellipsis": n.is_ellipsis(d, s, o), "placeholder": n.is_placeholder(d, o), "retry": n.should_retry(d, s, o),
        "fixed": n.fixed_negatives(d, s, o), "unit_term": n.is_unit_term(d, s, o),
    }


def _reply_columns(d: Dialect) -> dict[str, str]:
    x = "text"
    return {
        "json": r.json_part(d, x), "target": r.target(d, x), "thought": r.without_thoughts(d, x), "content": r.chat_content(d, x), "failure": r.failure(d, x), "empty": r.is_empty_object(d, x),
        "blocks": r.numbered_blocks(d, x),
    }


def _forms(d: Dialect) -> dict[str, str]:
    x = "text"
    return {
        "jp_mismatch": t.is_japanese_mismatch(d, x), "en_mismatch": t.is_mismatch(d, x, "en"), "output": t.clean_output(d, x), "snippet": f"substr({t.filled(d, x)}, 1, 200)",
        "segments": d.size(t.segments(d, x)), "rejoined": f"({d.join(t.segments(d, x), '')} = {t.filled(d, x)})", "table_rows": t.table_rows(d, x), "table_columns": t.table_columns(d, x),
        "structure": t.structure(d, x), "raw": t.is_raw_prompt(d, x), "twice": f"length({t.repeated_prompt(d, x)})", "aligned": r.aligned(d, x, 3),
    }


def _prefixes(d: Dialect) -> dict[str, str]:
    return {"prefix": t.is_line_prefix(d, "source", "out"), "separator": t.join_separator(d, "source", "out"), "mismatch": t.is_mismatch(d, "out", "jp")}


def _geometry(d: Dialect) -> dict[str, str]:
    align = g.vertical_alignment("y0 + q % 13", "y1 - q % 7", "y0", "y1")
    lo, hi = g.expanded("y0", "y1", "q", "(q * 2)", f"({align})")
    shown = {
        "low": lo, "high": hi, "size": g.font_size("(x1 - x0)", "(y1 - y0)", "q"), "flipped": g.flipped("y0", "842.0"), "memory": g.memory_mb("q", "(150.0 + x0)"),
        **g.thresholds("x1", "q"),
    }
    return {
        "i": "i", "alignment": align, "role": g.role(d, "CASE WHEN q > 40 THEN 'paragraph_title' WHEN q > 30 THEN 'table' ELSE label END"), "style": g.script_style("(q / 5)", "10.0", "(x0 - 250)", "(y1 - y0)"),
        "eta": g.eta(d, "(q * x0)"), "progress": g.scaled_progress("q", "50", 40, 90), **{k: f"round({v}, 6)" for k, v in shown.items()},
    }


def _geometry_in_steps(d: Dialect) -> steps.Plan:
    """The same as ``_geometry``. In one generated stage its columns make a method too long for the JVM to optimise; a value computed once by ``let`` keeps them out of it."""
    columns = _geometry(d)
    lo, hi = g.expanded("y0", "y1", "q", "(q * 2)", "alignment")
    columns |= {"alignment": "alignment", "low": f"round({lo}, 6)", "high": f"round({hi}, 6)", "eta": d.let("(q * x0)", "seconds", g.eta(d, "seconds"))}
    return _spans(d), [("alignment", _geometry(d)["alignment"])], ["id", *[f"{v} AS {k}" for k, v in columns.items()]]


QUERIES: dict[str, tuple[str, Columns]] = {
    "geometry_rules": ("spans", _geometry),
    "text_forms": ("texts", _forms),
    "pair_rules": ("pairs", _prefixes),
    "text_predicates": ("texts", _text_predicates),
    "should_translate": ("lines", _should_translate),
    "line_rules": ("lines", _line_rules),
    "character_profile": ("texts", _characters),
    "text_names": ("texts", _names),
    "text_measures": ("texts", _measures),
    "amounts_and_dates": ("texts", _amounts),
    "translation_guards": ("pairs", _guards),
    "reply_parsing": ("replies", _reply_columns),
}


#: Queries whose columns share work: the shared part is a column of an inner query.
STEPPED: dict[str, steps.Build] = {"language_detection": _detection, "text_cleanup": _cleanup}
#: Queries of ``QUERIES`` that Spark takes in steps; their SQL is the plain statement.
IN_STEPS: dict[str, steps.Build] = {"character_profile": _characters_in_steps, "geometry_rules": _geometry_in_steps}


def select(d: Dialect, name: str) -> str:
    source, columns = QUERIES[name]
    return f"SELECT id, {', '.join(f'{v} AS {k}' for k, v in columns(d).items())} FROM ({SOURCES[source][0](d)}) AS src"


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = SOURCES[QUERIES[name][0]][1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
        return spark.sql(_bound(select(Spark(), name), tables[0]), **{tables[0]: rows})

    return run


def _bound(sql: str, table: str) -> str:
    """The statement with the table as a parameter, other braces kept."""
    return sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", f"FROM {{{table}}}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_query(name) for name in QUERIES} | {name: steps.query(f, SOURCES[QUERIES[name][0]][1] if name in QUERIES else ["documents"]) for name, f in (STEPPED | IN_STEPS).items()}


def oracle_sql() -> dict[str, str]:
    return {name: select(Oracle(), name) for name in QUERIES} | {name: steps.oracle(f) for name, f in STEPPED.items()}
