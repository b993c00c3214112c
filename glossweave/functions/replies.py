"""Reading semi-structured model replies, as portable expressions."""

from __future__ import annotations

from glossweave.functions.dialect import Dialect
from glossweave.functions.text import filled, stripped, without_fences


def json_part(d: Dialect, x: str) -> str:
    """From the first opening bracket to the last closer of its kind; empty without one."""
    first = d.get(filled(d, x), r"[\[{]")
    return f"CASE {first} WHEN '{{' THEN {d.get(filled(d, x), r'(?s)\{.*\}')} WHEN '[' THEN {d.get(filled(d, x), r'(?s)\[.*\]')} ELSE '' END"


def target(d: Dialect, x: str) -> str:
    """What the target tag holds; an open tag holds the rest."""
    t = filled(d, x)
    closed = d.get(t, r"(?is)<target>(.*?)</target>", 1)
    return d.strip(f"CASE WHEN {d.like(t, r'(?is)<target>.*?</target>')} THEN {closed} ELSE {d.get(t, r'(?is)<target>(.*)$', 1)} END")


def without_thoughts(d: Dialect, x: str) -> str:
    """Without leading thinking blocks and a stray closing tag."""
    t = d.sub(filled(d, x), r"(?is)^\s*(?:<think>.*?</think>\s*)+")
    return d.strip(d.sub(t, r"(?i)^\s*</think>\s*"))


def chat_content(d: Dialect, x: str) -> str:
    doc = f"CASE WHEN {d.like(json_part(d, x), r'\"choices\"')} THEN {json_part(d, x)} ELSE '{{}}' END"
    return f"coalesce({d.json(doc, 'choices[0].message.content')}, {d.json(doc, 'choices[0].text')}, '')"


def is_empty_object(d: Dialect, x: str) -> str:
    """A blank reply, an empty object, or one whose translation is blank or no string."""
    o = json_part(d, x)
    blank = f"{d.json_kind(o, '$.translation')} <> 'string' OR {d.strip(f'coalesce({d.json(o, "translation")}, {d.text("x")})')} = ''"
    return f"({stripped(d, x)} = '' OR ({d.like(o, r'^[{]')} AND coalesce({d.like(o, r'^[{]\s*[}]$')} OR {blank}, false)))"


def failure(d: Dialect, x: str) -> str:
    """Why a reply holds no translations: by what is left open, by whether anything can be read, and by what that is."""
    cleaned = d.strip(without_fences(d, x))
    kinds = f"CASE WHEN j = '' THEN CASE WHEN {json_part(d, 's')} = '' THEN 'no_json' ELSE 'invalid_json' END WHEN {d.like('j', r'^\[')} THEN 'json_type_list' WHEN {d.like('j', r'^[{]\s*[}]$')} THEN 'empty_json_object' ELSE 'json_schema_mismatch' END"
    read = d.let(loose_json(d, "s"), "j", kinds)
    return d.let(cleaned, "s", f"CASE WHEN s = '' THEN 'empty' WHEN {is_truncated(d, 's')} THEN 'truncated_json' ELSE {read} END")


def loose_json(d: Dialect, x: str) -> str:
    """The JSON part of a text without fences, trailing commas gone where it needs that; empty if it can't be read."""
    part = json_part(d, x)
    mended = d.sub("j", r",(\s*[}\]])", r"\1")
    return d.let(part, "j", f"CASE WHEN {d.valid_json('j')} THEN j WHEN {d.valid_json(mended)} THEN {mended} ELSE '' END")


def is_truncated(d: Dialect, x: str) -> str:
    """Whether a bracket or a string that opens is left open, with no closer out of turn.

    Strings go first; then a stack of open brackets, to any depth, runs along what is left.
    """
    s = d.sub(d.get(x, r"(?s)[\[{].*$"), r'(?s)"[^"\\]*(?:\\.[^"\\]*)*"', "")
    s = d.sub(s, r'(?s)".*$', "<")
    opener = f"CASE v WHEN ']' THEN '[' ELSE {d.text('{')} END"
    push = f"CASE WHEN open = '!' THEN open WHEN {d.any_of('v', ['[', '{', '<'])} THEN concat(open, v) WHEN {d.last('open')} = {opener} THEN substr(open, 1, length(open) - 1) ELSE '!' END"
    left = d.fold(d.all(s, r"[\[\]{}<]"), "''", "open", "v", push)
    return f"coalesce({left} NOT IN ('', '!'), false)"


def items_by_id(d: Dialect, json: str, n: int) -> str:
    """Translations of an items object aligned to ids 1 to ``n``; the last of an id wins, and what is no string counts as empty.  Null without any id."""
    listed = d.json_list(json, "$.items")
    kind = d.json_kind("it", "$.id")
    digits = d.get(d.strip("coalesce(" + d.json("it", "id") + ", '')"), "^[0-9]+$")
    key = f"CASE WHEN {kind} IN ('int', 'string') THEN CAST(coalesce({d.number(digits, 'BIGINT')}, 0) AS BIGINT) ELSE 0 END"
    ids = d.map(listed, "it", key)
    said = d.map(listed, "it", f"CASE WHEN {d.json_kind('it', '$.translation')} = 'string' THEN {d.json('it', 'translation')} ELSE '' END")
    hits = d.where(d.numbered("said", "y", "i", f"CASE WHEN {d.at('ids', '<i>')} = k THEN concat('=', y) ELSE '' END"), "y", "y <> ''")
    one = d.let(hits, "h", f"CASE WHEN {d.size('h')} > 0 THEN {d.substr(d.at('h', d.size('h')), '2')} ELSE '' END")
    whole = d.let(said, "said", d.map(d.steps(str(n)), "k", one))
    return d.let(ids, "ids", f"CASE WHEN {d.size(d.where('ids', 'k', 'k > 0'))} = 0 THEN NULL ELSE {whole} END")


def blocks(d: Dialect, x: str) -> str:
    """Texts that start with an id mark, from one mark to the next."""
    marked = d.rewrite(x, r"\[\[ID:[0-9]+\]\]", "mark", "concat(chr(1), mark)")
    return d.where(d.all(marked, r"(?s)\x01(\[\[ID:[0-9]+\]\][^\x01]*)", 1), "y", d.like("y", r"(?s)\]\]\s*[^\s]"))


def items_by_mark(d: Dialect, x: str, n: int) -> str:
    """Texts after ``[[ID:n]]`` marks aligned to 1 to ``n``, else numbered lines in order; null without either."""
    hit = d.where("found", "y", f"{d.integer(d.get('y', '^.{5}([0-9]{1,9})', 1))} = k")
    body = d.strip(d.get(d.at("h", d.size("h")), r"(?s)^\[\[ID:[0-9]+\]\](.*)$", 1))
    one = d.let(hit, "h", f"CASE WHEN {d.size('h')} > 0 THEN {body} ELSE '' END")
    marked = d.map(d.steps(str(n)), "k", one)
    numbered = d.where(d.map(d.lines(x), "y", d.strip(d.get("y", r"^\s*[0-9]+\s*[.):]\s*(.+)$", 1))), "y", "y <> ''")
    plain = d.let(numbered, "p", f"CASE WHEN {d.size('p')} > 0 THEN {d.padded('p', n)} END")
    return d.let(blocks(d, x), "found", f"CASE WHEN {d.size('found')} > 0 THEN {marked} ELSE {plain} END")


def batch(d: Dialect, cleaned: str, json: str, n: int) -> str:
    """The aligned translations joined by a bar, or why there are none."""
    got = f"coalesce({items_by_id(d, json, n)}, {items_by_mark(d, cleaned, n)})"
    return d.let(got, "g", f"CASE WHEN g IS NOT NULL THEN {d.join('g', '|')} WHEN {is_truncated(d, cleaned)} THEN '!truncated' ELSE '!unreadable' END")


def single(d: Dialect, cleaned: str, json: str) -> str:
    """translation and explanation joined by a line feed: from JSON, else a target tag, else labelled sections; null without any."""
    is_string = f"{d.json_kind(json, '$.translation')} = 'string'"
    explained = f"CASE WHEN {d.json_kind(json, '$.explanation')} = 'string' THEN {d.json(json, 'explanation')} ELSE '' END"
    label = d.get("y", r"(?i)^\s*(?:#+\s*)?(訳文|解説|説明|translation|explanation)\s*(?:[:：].*)?$", 1)
    kind = d.let(label, "l", "CASE WHEN lower(l) IN ('訳文', 'translation') THEN 't' WHEN l <> '' THEN 'e' ELSE '' END")
    rest = d.strip(d.get("y", r"^[^:：]*[:：](.*)$", 1))
    before = d.where(d.part("kinds", "1", "<i>"), "l", "l <> ''")
    section = d.let(before, "b", f"coalesce({d.at('b', d.size('b'))}, '')")

    def told(which: str) -> str:
        here = f"CASE WHEN {section} <> '{which}' THEN chr(1) WHEN {d.at('kinds', '<i>')} = '' THEN y WHEN {rest} = '' THEN chr(1) ELSE {rest} END"
        return d.strip(d.join(d.where(d.numbered("rows", "y", "i", here), "y", "y <> chr(1)"), "\n"))

    labelled = d.let(told("t"), "a", f"CASE WHEN a = '' THEN NULL ELSE concat(a, chr(10), {told('e')}) END")
    sections = d.let(d.lines(cleaned), "rows", d.let(d.map("rows", "y", kind), "kinds", labelled))
    tagged = d.let(target(d, cleaned), "t", "CASE WHEN t <> '' THEN concat(t, chr(10)) END")
    return f"CASE WHEN {is_string} THEN concat({d.json(json, 'translation')}, chr(10), {explained}) ELSE coalesce({tagged}, {sections}) END"


def root_key(d: Dialect, prompt: str) -> str:
    """The JSON key that a prompt asks for; empty if it asks for none."""
    p = f"lower({prompt})"
    has = lambda s: f"{d.position(p, d.text(s))} > 0"
    return f"""CASE WHEN {has('{"items"')} OR {has('items_json')} THEN 'items' WHEN {has('{"options"')} THEN 'options' WHEN {has('{"translation"')} OR {has('return json only')} THEN 'translation' ELSE '' END"""


def schema_name(d: Dialect, prompt: str) -> str:
    p = f"lower({prompt})"
    return f"CASE WHEN {d.position(p, d.text('items_json'))} > 0 THEN 'items' WHEN {d.position(p, d.text('options'))} > 0 THEN 'options' ELSE 'single' END"


def needs_repeat(d: Dialect, key: str, cleaned: str, json: str, one: str) -> str:
    """Whether a reply lacks what its prompt asks for under ``key``."""
    holds = f"CASE {key} WHEN 'translation' THEN {d.json_kind(json, '$.translation')} = 'string' AND {d.strip(f'coalesce({d.json(json, "translation")}, {d.text("")})')} <> '' ELSE {d.size(d.json_list(json, '$.items'))} > 0 AND {key} = 'items' OR {d.size(d.json_list(json, '$.options'))} > 0 AND {key} = 'options' END"
    is_object = d.like(json, r"^\s*[{]")
    return f"({key} <> '' AND ({cleaned} = '' OR {is_truncated(d, cleaned)} OR CASE WHEN {is_object} THEN NOT coalesce({holds}, false) WHEN {key} = 'translation' AND {one} IS NOT NULL THEN false ELSE {json_part(d, cleaned)} <> '' END))"


def without_echo(d: Dialect, x: str, prompt: str) -> str:
    """Without the prompt, wherever it stands, or a common beginning of at least 120 characters."""
    at = d.position(x, "prompt")
    cut = f"{d.strip(f'concat(substring({x}, 1, CAST({at} - 1 AS INT)), {d.substr(x, f"{at} + length(prompt)")})')}"
    differs = d.where(d.steps(f"least(length({x}), length(prompt), 4000)"), "k", f"substring({x}, CAST(k AS INT), 1) <> substring(prompt, CAST(k AS INT), 1)")
    shared = d.let(differs, "f", f"CASE WHEN {d.size('f')} > 0 THEN {d.at('f', '1')} - 1 ELSE least(length({x}), length(prompt), 4000) END")
    begins = f"length({x}) >= 120 AND substring({x}, 1, 120) = substring(prompt, 1, 120)"
    return d.let(prompt, "prompt", f"CASE WHEN {x} = '' OR prompt = '' THEN {x} WHEN {at} > 0 THEN {cut} WHEN {begins} THEN {d.strip(d.substr(x, f'{shared} + 1'))} ELSE {x} END")


def without_thinking(d: Dialect, x: str) -> str:
    """Without leading thinking; of an open block what follows its first blank line stays."""
    closed = d.sub(d.sub(x, r"(?is)^\s*(?:<think>.*?</think>\s*)+"), r"(?i)^\s*</think>\s*")
    after = d.strip(d.get("y", r"(?s)^.*?\n\n(.*)$", 1))
    return d.let(d.strip(closed), "y", f"CASE WHEN {d.like('y', '(?i)^<think>')} THEN {after} ELSE y END")


def without_instruction(d: Dialect, x: str) -> str:
    """Without one leading block of retry instructions or one leading translate line."""
    block = d.get("y", r"(?i)^\s*critical:[ \t]*(?:\n[ \t]*-[^\n]*)*")
    line = d.get("y", r"(?i)^\s*translate [^\n]*")
    both = lambda v: f"{d.position(f'lower({v})', d.text('do not echo input'))} > 0 AND {d.position(f'lower({v})', d.text('translation only'))} > 0"
    return d.let(x, "y", f"CASE WHEN {both(block)} THEN {d.strip(d.substr('y', f'length({block}) + 1'))} WHEN {both(line)} THEN {d.strip(d.substr('y', f'length({line}) + 1'))} ELSE y END")


def partial_value(d: Dialect, x: str, key: str) -> str:
    """The string under a key in an unfinished buffer, escapes kept; null if empty."""
    found = d.get(x, rf'(?s)"{key}"[^:]*:[^"]*"((?:[^"\\]|\\.)*\\?)', 1)
    return f"nullif({found}, '')"


def options_preview(d: Dialect, x: str) -> str:
    """A line for each style of an unfinished options buffer, in order of place."""
    marked = d.rewrite(x, r'"style":"(?:standard|concise|minimal)"', "mark", "concat(chr(1), mark)")
    parts = d.all(marked, r"(?s)\x01([^\x01]*)", 1)
    style = d.get("y", r'^"style":"([a-z]+)"', 1)
    told, why = partial_value(d, "y", "translation"), partial_value(d, "y", "explanation")
    line = f"CASE WHEN {told} IS NULL AND {why} IS NULL THEN '' ELSE concat('[', {style}, ']', coalesce(' ' || {told}, ''), coalesce(chr(10) || '- ' || {why}, '')) END"
    first = d.where(d.numbered("parts", "y", "i", f"CASE WHEN {d.where_position(d.map('parts', 'z', d.get('z', '^.{9}([a-z]+)', 1)), style)} = <i> THEN y ELSE '' END"), "y", "y <> ''")
    shown = d.strip(d.join(d.where(d.map(first, "y", line), "y", "y <> ''"), "\n"))
    return f"CASE WHEN {d.position(x, d.text('"options"'))} > 0 THEN nullif({d.let(parts, 'parts', shown)}, '') END"


def style_sections(d: Dialect, x: str) -> str:
    """style=text of ``[style]`` sections that hold text, the first of each, in fixed order."""
    head = r"(?im)^\s*(?:>\s*)?(?:#{1,6}\s*)?[\[［]\s*(?:standard|concise|minimal)\s*[\]］]"
    marked = d.rewrite(x, head, "mark", f"concat(chr(1), lower({d.get('mark', '(?i)standard|concise|minimal')}), chr(2))")
    parts = d.all(marked, r"(?s)\x01([^\x01]*)", 1)
    text = section_text(d, d.get("y", r"(?s)\x02(.*)$", 1))
    pairs = d.where(d.map(parts, "y", f"concat({d.get('y', '^[a-z]+')}, '=', {text})"), "y", "y NOT LIKE '%='")
    ordered = [d.let(d.where("pairs", "y", d.starts("y", d.text(s + "="))), "h", f"coalesce({d.at('h', '1')}, '')") for s in ("standard", "concise", "minimal")]
    return d.let(pairs, "pairs", d.join(d.where(d.array(*ordered), "y", "y <> ''"), "|"))


def section_text(d: Dialect, x: str) -> str:
    """What follows a translation label, else what precedes an explanation, else all, without rules and language labels."""
    label = r"(?is)[#>*\s-]*[\[(]?\**(?:訳文[:：]?|翻訳[:：]|(?:Translation|Translated)[:：])\**[\])]?\s*(.*)$"
    note = r"(?is)(?:^|\n)[#>*\s-]*[\[(]?\**(?:解説|説明|Explanation|Notes?|Commentary)\**[\])]?[:：]?.*$"
    body = d.let(d.strip(x), "s", f"CASE WHEN {d.like('s', label)} THEN {d.get('s', label, 1)} ELSE s END")
    cut = d.let(d.strip(body), "s", d.let(d.strip(d.sub("s", note)), "c", "CASE WHEN c = '' THEN s ELSE c END"))
    return d.strip(d.sub(d.strip(d.sub(cut, r"\n?\s*[*-]{3,}\s*$")), r"(?i)^(?:英語翻訳|日本語翻訳|English\s*Translation|Japanese\s*Translation)\s*"))


def delta(d: Dialect, x: str, *paths: str) -> str:
    """The first of some places of a stream payload that holds text: a string, or a list of texts and text parts."""
    found = []
    for p in paths:
        piece = f"CASE WHEN {d.json_kind('it', '$')} = 'object' THEN CASE WHEN {d.json_kind('it', '$.text')} = 'string' THEN {d.json('it', 'text')} ELSE '' END WHEN {d.json_kind('it', '$')} IN ('array', 'int', 'number', 'bool', 'null') THEN '' ELSE it END"
        joined = f"nullif({d.join(d.map(d.json_list(x, '$.' + p), 'it', piece), '')}, '')"
        found.append(f"CASE {d.json_kind(x, '$.' + p)} WHEN 'string' THEN {d.json(x, p)} WHEN 'array' THEN {joined} END")
    return f"coalesce({', '.join(found)})"


def numbered_blocks(d: Dialect, x: str) -> str:
    """Texts that follow ``[[ID:n]]`` marks, up to the next mark, joined by a bar."""
    return d.join(d.map(blocks(d, filled(d, x)), "v", d.strip(d.get("v", r"(?s)^\[\[ID:[0-9]+\]\](.*)$", 1))), "|")


def aligned(d: Dialect, x: str, n: int) -> str:
    """The numbered texts cut or padded with empty ones to ``n``, joined by a bar."""
    found = d.map(d.all(filled(d, x), r"(?s)\[\[ID:[0-9]+\]\]([^\[]*)", 1), "v", d.strip("v"))
    return d.join(d.padded(found, n), "|")
