"""Queries that rewrite, hint at and repair amounts."""

from __future__ import annotations


from glossweave.functions import units as u
from glossweave.functions.dialect import Dialect
from glossweave.functions.numbers import months_missing
from glossweave.functions.text import filled
from glossweave.plans import steps
from glossweave.sources import samples


def _texts(d: Dialect) -> str:
    return f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM ({samples.values(samples.AMOUNTS, d)}) AS a(id, text)"


def _pairs(d: Dialect) -> str:
    return f"SELECT doc_id AS id, text AS source, text AS out FROM documents UNION ALL SELECT * FROM ({samples.values(samples.REPAIRS, d)}) AS a(id, source, out)"


def amount_rewrites(d: Dialect) -> steps.Plan:
    t = filled(d, "text")
    todo = [
        ("small", u.english_small(d, t)), ("large", u.english_large(d, "small")), ("to_japanese", u.english_oku(d, "large")), ("yen_billions", u.yen_billions(d, t)), ("to_english", u.japanese_large(d, t)),
        ("thousands", u.japanese_man_sen(d, t)), ("to_k", u.japanese_sen(d, "thousands")), ("expected", u.expected_units(d, "text")), ("hints", u.numeric_hints_en(d, "text")),
        ("k_amount", u.k_amount(d, f"(length({t}) * -37.125)")),
    ]
    return _texts(d), todo, ["id", "to_japanese", "yen_billions", "to_english", "to_k", "expected", "hints", "k_amount", f"{t} AS unchanged"]


def amount_hints(d: Dialect) -> steps.Plan:
    todo = [("numeric", u.numeric_lines(d, "text")), ("rules", u.rule_lines(d, "text"))]
    return _texts(d), todo, ["id", f"{u.titled(d, 'numeric', u.NUMERIC_TITLE)} AS numeric_hints", f"{u.titled(d, 'rules', u.RULE_TITLE)} AS rule_hints", f"{u.dynamic_pairs(d, 'numeric', 'rules')} AS pairs"]


def amount_repairs(d: Dialect) -> steps.Plan:
    o = filled(d, "out")
    # Without a large amount in the source there is nothing to repair, so each step asks for one first.
    large = lambda e, other="NULL": f"CASE WHEN {d.size('expected')} > 0 THEN {e} ELSE {other} END"
    todo = [
        ("expected", u.oku_expected(d, "source")), ("with_yen", large(u.large_values(d, "source", "円$"))), ("in_trillions", large(d.distinct(u.large_values(d, "source", "兆")))), ("thousands", u.expected_thousands(d, "source")),
        ("step1", large(u.repaired_oku(d, o), o)), ("step2", large(u.repaired_units(d, "step1", False), o)), ("english", large(u.repaired_units(d, "step2", True), o)),
        ("jp1", u.repaired_japanese(d, o)), ("japanese", u.repaired_japanese_oku(d, "jp1")), ("k1", u.repaired_man_sen(d, o)), ("k2", u.repaired_integers(d, "k1")),
        ("open_months", months_missing(d, "source", "out")), ("months", u.repaired_months(d, o)), ("retry", u.needs_units(d, "source", "out")), ("retry_after", f"CASE WHEN english = {o} THEN retry ELSE retry AND {u.needs_units(d, 'source', 'english')} END"),
    ]
    return _pairs(d), todo, ["id", "english", "japanese", "k2 AS in_k", "months", "retry", "retry_after"]


BUILDERS: dict[str, steps.Build] = {f.__name__: f for f in (amount_rewrites, amount_hints, amount_repairs)}
QUERIES = {name: steps.query(f, ["documents"]) for name, f in BUILDERS.items()}
SQL = {name: steps.oracle(f) for name, f in BUILDERS.items()}
