"""Queries that read replies: cleaning, batches, single texts, streams and previews."""

from __future__ import annotations

from glossweave.functions import replies as r
from glossweave.functions import text as t
from glossweave.functions.dialect import Dialect
from glossweave.functions.text import filled
from glossweave.plans import steps
from glossweave.sources import samples

EXPECTED = 3


def _rows(d: Dialect) -> str:
    return f"SELECT event_id AS id, props AS text FROM events UNION ALL SELECT * FROM ({samples.values(samples.REPLIES + samples.MORE_REPLIES, d)}) AS a(id, text)"


def _cleaned(d: Dialect) -> steps.Steps:
    plain = d.strip(d.sub(t.without_fences(d, "text"), r"\r\n?", "\n"))
    todo = [("plain", plain), ("unechoed", r.without_echo(d, "plain", d.text(samples.ECHO))), ("thought", r.without_thinking(d, "unechoed"))]
    before = "thought"
    for i in range(3):
        todo.append((f"told{i}", r.without_instruction(d, before)))
        before = f"told{i}"
    return [*todo, ("cleaned", before), ("json", r.loose_json(d, "cleaned"))]


def reply_batches(d: Dialect) -> steps.Plan:
    todo = [
        *_cleaned(d), ("by_id", d.join(f"coalesce({r.items_by_id(d, 'json', EXPECTED)}, {d.empty_list()})", "|")), ("by_mark", d.join(f"coalesce({r.items_by_mark(d, 'cleaned', EXPECTED)}, {d.empty_list()})", "|")),
        ("batch", r.batch(d, "cleaned", "json", EXPECTED)),
    ]
    return _rows(d), todo, ["id", "cleaned", "by_id", "by_mark", "batch", f"{r.is_truncated(d, 'plain')} AS truncated"]


def reply_singles(d: Dialect) -> steps.Plan:
    todo = [*_cleaned(d), ("single", r.single(d, "cleaned", "json")), ("repeat", r.needs_repeat(d, "'translation'", "plain", "json", "single"))]
    return _rows(d), todo, ["id", "single", "repeat", f"{r.root_key(d, filled(d, 'text'))} AS root_key", f"{r.schema_name(d, filled(d, 'text'))} AS schema_name", f"{filled(d, 'text')} AS shown"]


def reply_sections(d: Dialect) -> steps.Plan:
    x = filled(d, "text")
    todo = [("partial", r.partial_value(d, x, "translation")), ("preview", r.options_preview(d, x)), ("styles", r.style_sections(d, x)), ("section", r.section_text(d, x))]
    return _rows(d), todo, ["id", "partial", "preview", "styles", "section"]


def stream_deltas(d: Dialect) -> steps.Plan:
    at = "choices[0]."
    content = r.delta(d, "doc", at + "delta.content", at + "text", at + "message.content")
    thought = r.delta(d, "doc", *[at + p for p in ("delta.reasoning_content", "delta.reasoning", "message.reasoning_content", "message.reasoning", "reasoning_content", "reasoning")])
    return _rows(d), [("doc", r.loose_json(d, filled(d, "text"))), ("content", content), ("reasoning", thought)], ["id", "content", "reasoning"]


BUILDERS: dict[str, steps.Build] = {f.__name__: f for f in (reply_batches, reply_singles, reply_sections, stream_deltas)}
QUERIES = {name: steps.query(f, ["events"]) for name, f in BUILDERS.items()}
SQL = {name: steps.oracle(f) for name, f in BUILDERS.items()}
