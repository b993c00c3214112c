"""Smaller text rules: escapes, citations, placeholders, widths, formula characters, devices; as portable expressions."""

from __future__ import annotations

from glossweave.functions.dialect import Dialect
from glossweave.functions.text import filled

# Fonts and character classes of formulas, full-width characters, punctuation after a citation, names of choices.
FORMULA_FONTS = r"^(?:CM[^R]|MS[AB]M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Ital|.*Sym|.*Math)"
FORMULA_CLASSES = r"^[\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\x{370}-\x{3FF}]"
NO_FORMULA = r"^[ \x{3005}\x{309D}\x{309E}\x{30FC}-\x{30FE}+*/<=>\x{FF0B}\x{FF0D}\x{FF0A}\x{FF0F}\x{FF1C}\x{FF1D}\x{FF1E}\x{FF5E}-]"
FULL_WIDTH = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]"
LAYOUT_CJK = r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}\x{FF65}-\x{FF9F}]"
LAYOUT_LATIN = r"[A-Za-z0-9\x{C0}-\x{24F}]"
AFTER_CITATION = r"""[.,;:!?。！？、)\]}）】』」"'”’]"""
DETECT, AUTO = "言語を検出する", "自動"


def unescaped(d: Dialect, x: str) -> str:
    """Written-out line feeds and tabs as such, but for those in Windows paths."""
    return d.where_found(x, r"\\", d.rewrite(x, r"(?i)(?:^|\s)(?:[a-z]:\\|\\\\)\S+|\\r\\n|\\n|\\t", "m", f"CASE m WHEN {d.text(chr(92) + 'r' + chr(92) + 'n')} THEN chr(10) WHEN {d.text(chr(92) + 'n')} THEN chr(10) WHEN {d.text(chr(92) + 't')} THEN chr(9) ELSE m END"), x)


def without_citations(d: Dialect, x: str, labels: list[str]) -> str:
    """Lines without trailing labels; lines of nothing else go, and so do blank ones at the ends, unless all would."""
    names = "|".join(n.replace(".", r"\.") for n in sorted(labels, key=len, reverse=True))
    end = d.sub("y", r"\s+$")
    cited = d.sub(end, rf"(?i)^(.*?)(?:(?:{names})\s*)+({AFTER_CITATION}*)$", r"\1\2")
    cut = d.sub(d.where_found("y", f"(?i){names}", cited, end), r"\s+$")
    kept = d.where(d.map(d.lines(x), "y", f"CASE WHEN {d.strip('y')} <> '' AND {cut} = '' THEN chr(1) ELSE {cut} END"), "y", "y <> chr(1)")
    whole = d.sub(d.join(kept, "\n"), r"^\s*\n|(?:\n\s*)+$")
    return d.let(whole, "w", f"CASE WHEN {d.strip('w')} = '' THEN {x} ELSE w END")


def restored(d: Dialect, x: str, formulas: str) -> str:
    """Placeholders with the formulas they number, from 0; several numbers in a row; unknown ones stay."""
    numbers = d.all(d.get("m", r"v([0-9\s]+)", 1), "[0-9]+")
    one = d.let(d.at(formulas, f"{d.integer('k')} + 1"), "f", "CASE WHEN f IS NULL THEN concat('{v', k, '}') ELSE f END")
    return d.rewrite(x, r"(?i)[{(\[]\s*v[0-9\s]+[})\]]", "m", d.join(d.map(numbers, "k", one), ""))


def numbered_formulas(d: Dialect, x: str, formulas: str) -> str:
    """The formulas that a text's placeholders number, joined by a bar."""
    found = d.map(d.all(x, r"(?i)[{(\[]\s*v([0-9]+)\s*[})\]]", 1), "k", f"coalesce({d.at(formulas, f'{d.integer("k")} + 1')}, '')")
    return d.join(d.where(found, "f", "f <> ''"), "|")


def text_width(d: Dialect, x: str, size: str) -> str:
    return f"({size} * ({d.count(x, FULL_WIDTH)} + 0.5 * (length({x}) - {d.count(x, FULL_WIDTH)})))"


def is_formula_char(d: Dialect, font: str, char: str) -> str:
    name = d.sub(font, r"^.*\+")
    by_font = f"({name} <> '' AND {d.like(name, FORMULA_FONTS)})"
    return f"CASE WHEN {char} LIKE '(cid:%' OR {by_font} THEN {by_font} ELSE {char} <> '' AND NOT {d.like(char, NO_FORMULA)} AND {d.like(char, FORMULA_CLASSES)} END"


def devices(d: Dialect, x: str) -> str:
    """Names of devices after the header line, or on all lines without one; the first of each, case aside."""
    headed = r"(?is)^(?:.*?\n)?[ \t]*available devices:[ \t]*(?:\n|$)"
    body = f"CASE WHEN {d.like(x, headed)} THEN {d.sub(x, headed)} ELSE {x} END"
    found = d.all(body, r"(?im)^[ \t]*(vulkan[0-9]+)[ \t]*:", 1)
    first = d.where(d.numbered("f", "y", "i", f"CASE WHEN {d.where_position(d.map('f', 'z', 'lower(z)'), 'lower(y)')} = <i> THEN y ELSE '' END"), "y", "y <> ''")
    return d.let(found, "f", d.join(first, ","))


def swapped(d: Dialect, source: str, target: str) -> str:
    fixed = f"{source} = '{DETECT}' OR {target} = '{AUTO}'"
    return f"CASE WHEN {fixed} THEN concat({source}, '>', {target}) ELSE concat({target}, '>', {source}) END"


def size_words(d: Dialect, n: str, gigabytes: bool) -> str:
    """Bytes in the unit that fits, with one place, halves to even."""
    one = {"spark": "format_string('%.1f', bround({}, 1))", "oracle": "printf('%.1f', {})"}[d.name]
    top = f"WHEN {n} < 1073741824 THEN concat({one.format(f'{n} / 1048576.0D' if d.name == 'spark' else f'{n} / 1048576.0')}, ' MB') ELSE concat({one.format(f'{n} / 1073741824.0D' if d.name == 'spark' else f'{n} / 1073741824.0')}, ' GB') END"
    mb = f"ELSE concat({one.format(f'{n} / 1048576.0D' if d.name == 'spark' else f'{n} / 1048576.0')}, ' MB') END"
    return f"CASE WHEN {n} < 1024 THEN concat(CAST({n} AS STRING), ' B') WHEN {n} < 1048576 THEN concat({one.format(f'{n} / 1024.0D' if d.name == 'spark' else f'{n} / 1024.0')}, ' KB') {top if gigabytes else mb}"


def is_translation_model(d: Dialect, x: str) -> str:
    return d.like(filled(d, x), "(?i)(?:^|/|-)translategemma(?:-|$)")


def with_script(d: Dialect, x: str) -> str:
    """Which script most characters have in the page-layout sense."""
    cjk, latin = d.count(x, LAYOUT_CJK), d.count(x, LAYOUT_LATIN)
    return f"CASE WHEN {cjk} = 0 AND {latin} = 0 THEN 'none' WHEN {cjk} >= {latin} THEN 'cjk' ELSE 'latin' END"
