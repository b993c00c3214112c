"""Amounts, months and the guards on translated texts, as portable expressions."""

from __future__ import annotations

from glossweave.functions.dialect import Dialect
from glossweave.functions.text import HANGUL, IDEOGRAPH, KANA, filled, japanese_ratio, stripped

INTEGER = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+"
NUMBER = rf"(?:{INTEGER})(?:\.[0-9]+)?"
# English month names.
MONTHS = ["Jan.", "Feb.", "Mar.", "Apr.", "May", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec."]
LENGTH_RATIO = {"standard": 3.0, "concise": 2.5, "minimal": 2.0}


def parsed_decimal(d: Dialect, x: str) -> str:
    return d.number(d.translate(d.put(filled(d, x), ",", ""), "０１２３４５６７８９", "0123456789"), "DECIMAL(38, 4)")


def _whole(d: Dialect, x: str) -> str:
    return f"coalesce({d.number(d.put(x, ',', ''), 'BIGINT')}, 0)"


def oku_amounts(d: Dialect, x: str) -> str:
    """Distinct values in units of 10^8 of amounts in 10^12 and 10^8, in ascending order."""
    found = d.all(filled(d, x), rf"(?:{INTEGER})兆(?:(?:{INTEGER})億)?|(?:{INTEGER})億")
    cho = _whole(d, d.get("v", rf"({INTEGER})兆", 1))
    oku = _whole(d, d.get("v", rf"({INTEGER})億", 1))
    return d.sorted_set(d.map(found, "v", f"{cho} * 10000 + {oku}"))


def k_amounts(d: Dialect, x: str) -> str:
    """Distinct values in thousands of amounts in 10^4 and 10^3 with whole numbers, ascending."""
    found = d.all(filled(d, x), rf"(?:{INTEGER})万(?:(?:{INTEGER})千)?|(?:{INTEGER})千")
    man = _whole(d, d.get("v", rf"({INTEGER})万", 1))
    sen = _whole(d, d.get("v", rf"({INTEGER})千", 1))
    return d.sorted_set(d.map(found, "v", f"{man} * 10 + {sen}"))


def yen_words(d: Dialect, amount: str) -> str:
    """A whole amount of yen in 10^12, 10^8, 10^4 and single units."""
    a = f"abs({amount})"
    parts = [(d.div(a, "1000000000000"), "兆"), (d.div(f"({a} % 1000000000000)", "100000000"), "億"), (d.div(f"({a} % 100000000)", "10000"), "万"), (f"({a} % 10000)", "")]
    shown = ", ".join(f"CASE WHEN {v} > 0 THEN concat({d.grouped(v) if u != '兆' else f'CAST({v} AS STRING)'}, '{u}') ELSE '' END" for v, u in parts)
    return f"CASE WHEN {amount} = 0 THEN '0円' ELSE concat(CASE WHEN {amount} < 0 THEN '-' ELSE '' END, {shown}, '円') END"


def oku_words(d: Dialect, oku: str) -> str:
    """A whole number of 10^8 yen in 10^12 and 10^8."""
    a = f"abs({oku})"
    cho, rest = d.div(a, "10000"), f"({a} % 10000)"
    return (
        f"CASE WHEN {oku} = 0 THEN '0円' ELSE concat(CASE WHEN {oku} < 0 THEN '-' ELSE '' END, "
        f"CASE WHEN {cho} > 0 THEN concat(CAST({cho} AS STRING), '兆') ELSE '' END, CASE WHEN {rest} > 0 THEN concat({d.grouped(rest)}, '億') ELSE '' END, '円') END"
    )


def months_of(d: Dialect, x: str) -> str:
    """Months named by number before 月, 1 to 12, distinct and ascending."""
    found = d.map(d.all(filled(d, x), "([0-9]{1,2})月", 1), "v", "CAST(v AS BIGINT)")
    return d.sorted_set(d.where(found, "m", "m BETWEEN 1 AND 12"))


def _month_pattern(n: int) -> str:
    name = MONTHS[n - 1]
    return rf"(?:^|[^A-Za-z]){name}(?:$|[^A-Za-z])" if n == 5 else rf"(?i)(?:^|[^a-z]){name[:3]}\.(?:$|[^a-z])"


def months_missing(d: Dialect, source: str, out: str) -> str:
    """Months of the source whose English abbreviation the output lacks."""
    missing = " OR ".join(f"(m = {n} AND NOT {d.like(filled(d, out), _month_pattern(n))})" for n in range(1, 13))
    return d.where(months_of(d, source), "m", missing)


def needs_month(d: Dialect, source: str, out: str) -> str:
    return f"({d.size(months_missing(d, source, out))} > 0)"


def needs_k(d: Dialect, source: str, out: str) -> str:
    has = d.like(filled(d, source), rf"{NUMBER}\s*[万千]")
    return f"({has} AND NOT {d.like(filled(d, out), r'(?i)(?:^|[^A-Za-z0-9_])[0-9][0-9,]*(?:\.[0-9]+)?\s*k(?:$|[^A-Za-z0-9_])')})"


def needs_negative(d: Dialect, source: str, out: str) -> str:
    o = filled(d, out)
    bad = f"{d.like(o, '[▲△]')} OR {d.like(o, r'(?:^|[^A-Za-z0-9_])[-−]\s*[0-9]')} OR NOT {d.like(o, r'\(\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*\)')}"
    return f"({d.like(filled(d, source), r'[▲△]\s*[0-9]')} AND ({bad}))"


def retry_reasons(d: Dialect, source: str, out: str) -> str:
    """Names of the rules that ask for another try, joined by commas in fixed order."""
    return (
        f"concat(CASE WHEN {needs_k(d, source, out)} THEN 'k,' ELSE '' END, CASE WHEN {needs_negative(d, source, out)} THEN 'negative,' ELSE '' END, "
        f"CASE WHEN {needs_month(d, source, out)} THEN 'month,' ELSE '' END)"
    )


def needs_oku(d: Dialect, source: str, out: str) -> str:
    """Large units are left over, or an expected value is missing from the output."""
    o = filled(d, out)
    given = d.map(d.all(o, rf"(?i)({INTEGER})\s*oku", 1), "v", _whole(d, "v"))
    expected = oku_amounts(d, source)
    left = d.like(o, r"(?i)(?:^|[^A-Za-z])(?:billion|trillion|bn)(?:$|[^A-Za-z])|[兆億]")
    return f"({d.size(expected)} > 0 AND ({left} OR {d.size(d.minus(expected, given))} > 0))"


def length_limit(d: Dialect, x: str, style: str) -> str:
    return f"greatest(1, CAST(floor(length({stripped(d, x)}) * {LENGTH_RATIO[style]}) AS BIGINT))"


def is_incomplete(d: Dialect, source: str, out: str) -> str:
    o = stripped(d, out)
    return f"(length({stripped(d, source)}) >= 40 AND ({o} = '' OR (length({o}) <= 20 AND {d.size(d.words(o))} <= 2)))"


def is_ellipsis(d: Dialect, source: str, out: str) -> str:
    only = r"^[.\x{2026}\x{22EF}]+$"
    return f"({d.like(stripped(d, out), only)} AND NOT {d.like(stripped(d, source), only)})"


def is_placeholder(d: Dialect, x: str) -> str:
    return d.like(stripped(d, x), r"(?i)^<\s*(?:translation|style|\.{3}|…)\s*>(?:\s+<\s*(?:translation|style|\.{3}|…)\s*>)*$")


def should_retry(d: Dialect, source: str, out: str) -> str:
    """Hangul, an unchanged text, or mostly Japanese where the source is."""
    s, o = stripped(d, source), stripped(d, out)
    return (
        f"CASE WHEN {o} = '' THEN false WHEN {d.like(o, f'[{HANGUL}]')} THEN true WHEN NOT {d.like(s, f'[{KANA}{IDEOGRAPH}]')} THEN false "
        f"WHEN {s} = {o} THEN true ELSE {japanese_ratio(d, o)} >= 0.6 END"
    )


def fixed_negatives(d: Dialect, source: str, out: str) -> str:
    """Signed numbers of the output in parentheses where the source marks negatives by a triangle."""
    o = filled(d, out)
    t = d.sub(o, rf"[-−]\s*\(\s*({NUMBER})\s*\)", r"(\1)")
    t = d.sub(t, rf"\(\s*[-−]\s*({NUMBER})\s*\)", r"(\1)")
    t = d.sub(t, rf"[▲△]\s*({NUMBER})", r"(\1)")
    t = d.sub(t, rf"(^|[^A-Za-z0-9_(])[-−]\s*({NUMBER})", r"\1(\2)")
    return f"CASE WHEN {d.like(filled(d, source), r'[▲△]\s*[0-9]')} THEN {t} ELSE {o} END"


def is_unit_term(d: Dialect, source: str, target: str) -> str:
    return f"({d.like(filled(d, source), '億|兆|[千万億兆]円|円[千万億兆]')} OR {d.like(filled(d, target), r'(?i)(?:^|[^a-z])oku(?:$|[^a-z])|(?:^|[^a-z])k yen')})"
