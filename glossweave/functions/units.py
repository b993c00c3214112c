"""Rewriting and repair of amounts, months and signs, as portable expressions.

A rewrite cuts a text at the matches of a pattern and puts each match's replacement back between the
pieces, so no row leaves the JVM.  Amounts are decimals with six places.
"""

from __future__ import annotations

from glossweave.functions.dialect import Dialect
from glossweave.functions.numbers import INTEGER, MONTHS, NUMBER, months_of, oku_amounts
from glossweave.functions.text import filled, stripped

NEGATIVE = "[▲△−-]"
SIGN = "[▲△+−-]"
SIGNED = r"^[▲+−-]?\(?[▲+−-]?[¥￥]?"
PREFIX = r"\(?[▲+−-]?[¥￥]?"
LOOSE = r"[0-9][0-9,]*(?:\.[0-9]+)?"
JP_LARGE = rf"{SIGN}?\s*(?:(?:{INTEGER})兆(?:(?:{INTEGER})億)?|(?:{INTEGER})億)円?"
JP_LARGE_LOOSE = rf"{SIGN}?\s*(?:{LOOSE}兆(?:{LOOSE}億)?|{LOOSE}億)円?"
MAN_SEN = rf"{SIGN}?\s*{LOOSE}万(?:{LOOSE}千)?[円台]?"
SEN = rf"{SIGN}?\s*{LOOSE}千[円台]?"
# What every match of these holds.
LARGE_UNIT, MAN_UNIT, SEN_UNIT = "[兆億]", "万", "千"
# Headings, comparators and symbols of the hints.
NUMERIC_TITLE_EN = "### Numeric conversion hints (use verbatim)"
NUMERIC_TITLE = "### 数値変換ヒント（必ず使用）"
RULE_TITLE = "### ルール適用ヒント（必ず使用）"
COMPARATORS = {">": "more than", "<": "less than", ">=": "at least", "≤": "at most", "<=": "at most", "≥": "at least", "≧": "at least", "≦": "at most"}
SYMBOLS = {"~": "about", "→": "leads to", "↑": "up", "↓": "down"}
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MAX_HINTS, MAX_PAIRS = 12, 20


def _rewritten(d: Dialect, x: str, needed: str, pattern: str, by: str) -> str:
    """A rewrite of the matches ``m``, each of which holds the pattern ``needed``."""
    return d.where_found(x, needed, d.rewrite(x, pattern, "m", by), x)


def decimal(d: Dialect, x: str) -> str:
    return d.number(d.put(x, ",", ""), "DECIMAL(18, 6)")


def amount(d: Dialect, v: str) -> str:
    """A decimal with thousands commas and without trailing zeros."""
    fraction = d.get("CAST(abs(q) AS STRING)", r"\.([0-9]*[1-9])0*$", 1)
    tail = d.let(fraction, "r", "CASE WHEN r = '' THEN '' ELSE concat('.', r) END")
    return d.let(v, "q", f"CASE WHEN q IS NOT NULL THEN concat(CASE WHEN q < 0 THEN '-' ELSE '' END, {d.grouped('floor(abs(q))')}, {tail}) END")


def yen(d: Dialect, v: str) -> str:
    """Yen, rounded half up, in 10^12, 10^8, 10^4 and single units."""
    parts = [(d.div("n", "1000000000000"), "兆", False), (d.div("(n % 1000000000000)", "100000000"), "億", True), (d.div("(n % 100000000)", "10000"), "万", True), ("(n % 10000)", "", True)]
    shown = ", ".join(f"CASE WHEN {p} > 0 THEN concat({d.grouped(p) if commas else f'CAST({p} AS STRING)'}, '{u}') ELSE '' END" for p, u, commas in parts)
    whole = d.let("CAST(round(abs(w), 0) AS BIGINT)", "n", f"CASE WHEN n = 0 THEN '0' ELSE concat({shown}) END")
    return d.let(v, "w", f"CASE WHEN w IS NOT NULL THEN concat(CASE WHEN w < 0 THEN '-' ELSE '' END, {whole}, '円') END")


def oku(d: Dialect, v: str, with_yen: str = "false") -> str:
    """An amount in 10^8 yen, in 10^12 and 10^8 where it is whole."""
    cho, rest = d.div("n", "10000"), "(n % 10000)"
    whole = f"CASE WHEN {cho} > 0 AND {rest} > 0 THEN concat(CAST({cho} AS STRING), '兆', {d.grouped(rest)}, '億') WHEN {cho} > 0 THEN concat(CAST({cho} AS STRING), '兆') ELSE concat({d.grouped('n')}, '億') END"
    whole = d.let("CAST(floor(abs(t)) AS BIGINT)", "n", whole)
    plain = f"CASE WHEN t = floor(t) THEN concat(CASE WHEN t < 0 THEN '-' ELSE '' END, {whole}) ELSE concat({amount(d, 't')}, '億') END"
    return d.let(v, "t", f"CASE WHEN t IS NULL THEN NULL WHEN {with_yen} THEN {yen(d, scaled('t', 100000000))} ELSE {plain} END")


def scaled(v: str, by: int) -> str:
    return f"(CAST({v} AS DECIMAL(27, 6)) * CAST({by} AS DECIMAL(10, 0)))"


def yen_billions(d: Dialect, x: str) -> str:
    """¥ amounts in billions in Japanese units."""
    number = decimal(d, d.get("m", NUMBER))
    sign = f"CASE WHEN {d.get('m', '[+-]')} = '-' THEN -1 ELSE 1 END"
    return _rewritten(d, x, "[¥￥]", rf"(?i)[+-]?\s*[¥￥]\s*[+-]?\s*{NUMBER}\s*(?:billion|bn)\b(?:\s*yen\b)?", f"coalesce({yen(d, f'({scaled(number, 1000000000)} * {sign})')}, m)")


def _english(unit: str) -> str:
    return rf"(?i){PREFIX}{NUMBER}\)?\s*(?:{unit})\b(?:\s*yen\b)?"


def _english_unit(unit: str) -> str:
    """What every match of ``_english`` holds."""
    return rf"(?i)[0-9]\)?\s*(?:{unit})\b"


def _parts(d: Dialect) -> tuple[str, str, str, str]:
    """Of a match ``m``: its prefix, its number as text, its closing bracket, whether it names yen."""
    return d.get("m", f"^{PREFIX}"), d.get("m", NUMBER), f"CASE WHEN {d.like('m', r'[0-9]\)')} THEN ')' ELSE '' END", d.like("m", r"(?i)[¥￥]|yen$")


def _bare(d: Dialect, prefix: str) -> str:
    return d.translate(prefix, "¥￥", "")


def english_small(d: Dialect, x: str) -> str:
    """Thousands and millions written out; with yen, in Japanese units."""
    prefix, number, suffix, has_yen = _parts(d)
    v = f"CASE WHEN {d.like('m', '(?i)thousand')} THEN {scaled(decimal(d, number), 1000)} ELSE {scaled(decimal(d, number), 1000000)} END"
    return _rewritten(d, x, _english_unit("thousand|million"), _english("thousand|million"), f"coalesce({_bare(d, prefix)} || CASE WHEN {has_yen} THEN {yen(d, v)} ELSE {amount(d, v)} END || {suffix}, m)")


def english_large(d: Dialect, x: str) -> str:
    """Billions and trillions in Japanese units."""
    prefix, number, suffix, has_yen = _parts(d)
    v = f"CASE WHEN {d.like('m', '(?i)tri?llion')} THEN {scaled(decimal(d, number), 10000)} ELSE {scaled(decimal(d, number), 10)} END"
    return _rewritten(d, x, _english_unit("billion|trillion|trllion|bn"), _english("billion|trillion|trllion|bn"), f"coalesce({_bare(d, prefix)} || {oku(d, v, has_yen)} || {suffix}, m)")


def english_oku(d: Dialect, x: str) -> str:
    prefix, number, suffix, has_yen = _parts(d)
    return _rewritten(d, x, _english_unit("oku"), _english("oku"), f"coalesce({_bare(d, prefix)} || {oku(d, decimal(d, number), has_yen)} || {suffix}, m)")


def _whole(d: Dialect, x: str) -> str:
    return f"coalesce({d.number(d.put(x, ',', ''), 'BIGINT')}, 0)"


def _total(d: Dialect, m: str) -> str:
    """A match of JP_LARGE in units of 10^8."""
    return f"({_whole(d, d.get(m, f'({INTEGER})兆', 1))} * 10000 + {_whole(d, d.get(m, f'({INTEGER})億', 1))})"


def tenths(d: Dialect, n: str) -> str:
    """A tenth of a whole number, with one place."""
    return f"concat({d.grouped(d.div(n, '10'))}, '.', CAST({n} % 10 AS STRING))"


def japanese_large(d: Dialect, x: str) -> str:
    """Amounts in 10^12 and 10^8 in billions."""
    sign = f"CASE WHEN {d.like('m', f'^{NEGATIVE}')} THEN '-' ELSE '' END"
    return _rewritten(d, x, LARGE_UNIT, JP_LARGE, f"concat({sign}, CASE WHEN {d.like('m', '円$')} THEN '¥' ELSE '' END, {tenths(d, _total(d, 'm'))}, ' billion')")


def _unit(d: Dialect) -> str:
    return f"CASE WHEN {d.like('m', '円$')} THEN ' yen' WHEN {d.like('m', '台$')} THEN ' units' ELSE '' END"


def _k(d: Dialect) -> str:
    """A match of MAN_SEN or SEN in thousands."""
    return f"(coalesce({decimal(d, d.get('m', f'({LOOSE})万', 1))}, 0) * 10 + coalesce({decimal(d, d.get('m', f'({LOOSE})千', 1))}, 0))"


def _k_words(d: Dialect) -> str:
    words = f"concat({amount(d, _k(d))}, 'k', {_unit(d)})"
    return f"CASE WHEN {d.like('m', f'^{NEGATIVE}')} THEN concat('(', {words}, ')') ELSE {words} END"


def japanese_man_sen(d: Dialect, x: str) -> str:
    """Amounts in 10^4 in thousands, unless a larger unit stands before them."""
    return _rewritten(d, x, MAN_UNIT, f"[兆億]?{MAN_SEN}", f"CASE WHEN {d.like('m', '^[兆億]')} THEN m ELSE {_k_words(d)} END")


def japanese_sen(d: Dialect, x: str) -> str:
    return _rewritten(d, x, SEN_UNIT, f"[兆億万]?{SEN}", f"CASE WHEN {d.like('m', '^[兆億万]')} THEN m ELSE {_k_words(d)} END")


def expected_units(d: Dialect, x: str) -> str:
    """value:unit:yen of each distinct amount in 10^8, in order; trillion wins, yen is or-ed."""
    found = _large(d, x)
    values = d.distinct(d.map(found, "m", _total(d, "m")))
    unit = f"CASE WHEN {d.has(large_values(d, x, '兆'), 'o')} THEN 'trillion' ELSE 'billion' END"
    return d.join(d.map(values, "o", f"concat(CAST(o AS STRING), ':', {unit}, ':', CASE WHEN {d.has(large_values(d, x, '円$'), 'o')} THEN 'yen' ELSE '' END)"), "|")


def large_values(d: Dialect, x: str, mark: str) -> str:
    """Values in 10^8 of the amounts that hold a mark."""
    return d.map(d.where(_large(d, x), "m", d.like("m", mark)), "m", _total(d, "m"))


def _large(d: Dialect, x: str) -> str:
    return d.where_found(filled(d, x), LARGE_UNIT, d.all(filled(d, x), JP_LARGE), d.empty_list())


def _raws(d: Dialect, x: str, pattern: str) -> str:
    return d.distinct(d.map(d.all(x, pattern), "m", d.strip("m")))


def _hints(d: Dialect, x: str, needed: str, lines: str) -> str:
    """A list of lines, empty where ``x`` lacks a pattern."""
    return d.where_found(x, needed, lines, d.empty_list())


def _bracketed(d: Dialect, words: str) -> str:
    return f"CASE WHEN {d.like('m', f'^{NEGATIVE}')} THEN concat('(', {words}, ')') ELSE {words} END"


def numeric_hints_en(d: Dialect, x: str) -> str:
    """Amounts in 10^12 as trillions and in 10^8 as billions, the first twelve."""
    tens = f"CAST({_total(d, 'm')} AS DECIMAL(18, 6)) / CASE WHEN {d.like('m', '兆')} THEN 10000 ELSE 10 END"
    words = _bracketed(d, amount(d, f"CAST({tens} AS DECIMAL(18, 6))"))
    unit = f"CASE WHEN {d.like('m', '兆')} THEN ' trillion' ELSE ' billion' END, CASE WHEN {d.like('m', '円$')} THEN ' yen' ELSE '' END"
    lines = _hints(d, filled(d, x), LARGE_UNIT, d.map(d.head(_raws(d, filled(d, x), JP_LARGE), MAX_HINTS), "m", f"concat('- ', m, ' -> ', {words}, {unit})"))
    return f"CASE WHEN {d.size(lines)} = 0 THEN '' ELSE concat({d.text(NUMERIC_TITLE_EN + chr(10))}, {d.join(lines, chr(10))}, {d.text(chr(10))}) END"


def numeric_lines(d: Dialect, x: str) -> str:
    """Hint lines for large amounts, then those in 10^4, then those in 10^3 outside these; decimals count, the first twelve."""
    t = filled(d, x)
    cho, rest = decimal(d, d.get("m", f"({LOOSE})兆", 1)), decimal(d, d.get("m", f"({LOOSE})億", 1))
    large = f"CAST(CASE WHEN {d.like('m', '兆')} THEN coalesce({cho}, 0) + coalesce({rest}, 0) / 10000 ELSE coalesce({rest}, 0) / 10 END AS DECIMAL(18, 6))"
    unit = f"CASE WHEN {d.like('m', '兆')} THEN ' trillion' ELSE ' billion' END, CASE WHEN {d.like('m', '円$')} THEN ' yen' ELSE '' END"
    first = d.map(_raws(d, t, JP_LARGE_LOOSE), "m", f"concat('- ', m, ' -> ', {_bracketed(d, amount(d, large))}, {unit})")
    words = f"concat({_bracketed(d, amount(d, _k(d)))}, 'k', {_unit(d)})"
    second = d.map(_raws(d, t, MAN_SEN), "m", f"concat('- ', m, ' -> ', {words})")
    third = d.map(_raws(d, d.sub(t, MAN_SEN, "|"), SEN), "m", f"concat('- ', m, ' -> ', {words})")
    return d.head(d.concat_lists(_hints(d, t, LARGE_UNIT, first), _hints(d, t, MAN_UNIT, second), _hints(d, t, SEN_UNIT, third)), MAX_HINTS)


def rule_lines(d: Dialect, x: str) -> str:
    """Hint lines for marked negatives, months, comparisons and symbols."""
    t = stripped(d, x)
    plain = d.where(_raws(d, t, rf"▲\s*{LOOSE}\s*[兆億万千]?"), "m", f"NOT {d.like('m', '[兆億万千]$')}")
    number = d.get("m", LOOSE)
    negatives = d.map(d.distinct(plain), "m", f"concat('- ▲', {number}, ' -> (', {number}, ')')")
    name = f"CASE v {' '.join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(MONTHS))} END"
    months = d.map(months_of(d, x), "v", f"concat('- ', CAST(v AS STRING), '月 -> ', {name})")
    side = "[A-Za-z0-9_.%]+"
    op = d.get("m", "[<>≥≧≤≦]=?")
    phrase = f"CASE {op} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COMPARATORS.items())} END"
    compared = d.map(_raws(d, t, rf"{side}\s*(?:>=|<=|≥|≧|≤|≦|>|<)\s*{side}"), "m", f"concat('- ', m, ' -> ', {d.get('m', f'^{side}')}, ' ', {phrase}, ' ', {d.get('m', f'{side}$')})")
    symbols = d.where(d.array(*[f"CASE WHEN {d.position(t, d.text(k))} > 0 THEN '- {k} -> {v}' ELSE '' END" for k, v in SYMBOLS.items()]), "v", "v <> ''")
    return d.concat_lists(_hints(d, t, "▲", negatives), _hints(d, t, "月", months), _hints(d, t, "[<>≥≧≤≦]", compared), symbols)


def titled(d: Dialect, lines: str, title: str) -> str:
    return f"CASE WHEN {d.size(lines)} = 0 THEN '' ELSE concat({d.text(title + chr(10))}, {d.join(lines, chr(10))}, {d.text(chr(10))}) END"


def dynamic_pairs(d: Dialect, numeric: str, rules: str) -> str:
    """source=target of both kinds of hint lines, the first of each source (case aside), at most twenty."""
    lines = d.concat_lists(numeric, rules)
    left = d.map(lines, "v", f"lower({d.strip(d.get('v', '(?s)^- (.*?)->', 1))})")
    first = d.where(d.numbered(lines, "v", "i", f"CASE WHEN {d.where_position(left, d.at(left, '<i>'))} = <i> THEN v ELSE '' END"), "v", "v <> ''")
    return d.join(d.map(d.head(first, MAX_PAIRS), "v", f"concat({d.strip(d.get('v', '(?s)^- (.*?)->', 1))}, '=', {d.strip(d.get('v', '(?s)->(.*)$', 1))})"), "|")


def _repaired(d: Dialect, oku_value: str, sep: str) -> str:
    currency = f"CASE WHEN {d.has('with_yen', oku_value)} AND NOT {d.like('p', '[¥￥]')} THEN '¥' ELSE '' END"
    return d.let(d.get("m", SIGNED), "p", f"concat(p, {currency}, {tenths(d, oku_value)}, {_parts(d)[2]}, {sep}, 'billion')")


def repaired_oku(d: Dialect, x: str) -> str:
    """Expected amounts in oku as billions; ``expected`` and ``with_yen`` are arrays beside ``x``."""
    whole = d.let("CAST(floor(v) AS BIGINT)", "n", f"CASE WHEN v = n AND {d.has('expected', 'n')} THEN {_repaired(d, 'n', d.text(' '))} ELSE m END")
    return d.rewrite(x, _english("oku"), "m", f"coalesce({d.let(decimal(d, d.get('m', NUMBER)), 'v', whole)}, m)")


def _candidate(d: Dialect) -> str:
    """The expected value that a number ``v`` with its unit stands for: as it is, scaled, or misread by a factor of ten in 10^12."""
    tri = d.like("m", "(?i)trillion")

    def hit(e: str) -> str:
        return d.let(e, "e", f"CASE WHEN e = floor(e) AND {d.has('expected', 'CAST(floor(e) AS BIGINT)')} THEN CAST(floor(e) AS BIGINT) END")

    ten, myriad = hit(scaled("v", 10)), hit(scaled("v", 10000))
    misread = f"CASE WHEN NOT {tri} AND v = floor(v) THEN CAST(v AS DECIMAL(38, 6)) ELSE CAST({scaled('v', 1000)} AS DECIMAL(38, 6)) END"
    fits = d.let(misread, "x", d.where("in_trillions", "o", f"{d.div('o', '10000')} * 1000 + o % 10000 = x"))
    only = d.let(fits, "f", f"CASE WHEN {d.size('f')} = 1 THEN {d.at('f', '1')} END")
    return f"coalesce({hit('v')}, CASE WHEN {tri} THEN {myriad} END, {ten}, {myriad}, {only})"


def repaired_units(d: Dialect, x: str, keep_blank: bool) -> str:
    """Numbers in billions and trillions that stand for an expected amount, put right; others only lose the short unit."""
    pattern = rf"(?i){SIGNED[1:]}{NUMBER}\)?\s*(?:billion|trillion|bn)\b" + ("" if keep_blank else r"(?:\s*yen\b)?")
    sep = d.let(d.get("m", r"(?i)[0-9)](\s*)(?:billion|trillion|bn)", 1) if keep_blank else "''", "b", "CASE WHEN b = '' THEN ' ' ELSE b END")
    short = f"concat({d.get('m', SIGNED)}, {d.get('m', NUMBER)}, {_parts(d)[2]}, {sep}, 'billion')"
    done = d.let(_candidate(d), "c", f"CASE WHEN c IS NOT NULL THEN {_repaired(d, 'c', sep)} WHEN {d.like('m', r'(?i)[0-9)]\s*bn')} THEN {short} ELSE m END")
    return d.rewrite(x, pattern, "m", f"coalesce({d.let(decimal(d, d.get('m', NUMBER)), 'v', done)}, m)")


def repaired_japanese(d: Dialect, x: str) -> str:
    """Billions and trillions in Japanese units, the number inside its brackets."""
    prefix, number, suffix, _ = _parts(d)
    v = f"CASE WHEN {d.like('m', '(?i)trillion')} THEN {scaled(decimal(d, number), 10000)} ELSE {scaled(decimal(d, number), 10)} END"
    has_yen = f"CASE WHEN {d.like('m', '(?i)yen$')} THEN '円' ELSE '' END"
    shown = f"CASE WHEN v = floor(v) AND v >= 10000 THEN concat({prefix}, {oku(d, 'v')}, {suffix}, {has_yen}) ELSE concat({prefix}, {amount(d, 'v')}, {suffix}, '億', {has_yen}) END"
    found = d.rewrite(x, _english("billion|trillion|bn"), "m", f"coalesce({d.let(v, 'v', shown)}, m)")
    return f"CASE WHEN {d.like(x, '(?i)billion|trillion|bn')} THEN {found} ELSE {x} END"


def repaired_japanese_oku(d: Dialect, x: str) -> str:
    prefix, number, suffix, _ = _parts(d)
    found = d.rewrite(x, _english("oku"), "m", f"concat({prefix}, {number}, {suffix}, '億', CASE WHEN {d.like('m', '(?i)yen$')} THEN '円' ELSE '' END)")
    return f"CASE WHEN {d.like(x, '(?i)oku')} THEN {found} ELSE {x} END"


def expected_thousands(d: Dialect, x: str) -> str:
    """Values in single units of the amounts in 10^4 and 10^3 that are whole."""
    man = d.map(d.all(filled(d, x), rf"({NUMBER})\s*万", 1), "m", scaled(decimal(d, 'm'), 10000))
    sen = d.map(d.all(filled(d, x), rf"({NUMBER})\s*千", 1), "m", scaled(decimal(d, 'm'), 1000))
    return d.map(d.where(d.concat_lists(man, sen), "y", "y = floor(y)"), "y", "CAST(floor(y) AS BIGINT)")


def repaired_man_sen(d: Dialect, x: str) -> str:
    """Numbers in man and sen that are expected (array ``thousands``) in k notation."""
    number = decimal(d, d.get("m", NUMBER))
    v = f"CASE WHEN {d.like('m', '(?i)man-?$')} THEN {scaled(number, 10000)} ELSE {scaled(number, 1000)} END"
    ok = f"NOT {d.like('m', r'^[\p{L}_.]|-$')} AND v = n AND {d.has('thousands', 'n')}"
    done = d.let(v, "v", d.let("CAST(floor(v) AS BIGINT)", "n", f"CASE WHEN {ok} THEN {_as_k(d, 'n')} ELSE m END"))
    found = d.rewrite(x, rf"(?i)[\p{{L}}_.]*{NUMBER}\s*(?:man|sen)\b-?", "m", f"coalesce({done}, m)")
    return f"CASE WHEN {d.size('thousands')} = 0 THEN {x} ELSE {found} END"


def _as_k(d: Dialect, n: str) -> str:
    return f"concat({amount(d, f'CAST(CAST({n} AS DECIMAL(18, 6)) / 1000 AS DECIMAL(18, 6))')}, 'k')"


def repaired_integers(d: Dialect, x: str) -> str:
    """Whole numbers that are expected (array ``thousands``) in k notation."""
    n = _whole(d, d.get("m", rf"^({INTEGER}),*$", 1))
    done = d.let(n, "n", f"CASE WHEN n > 0 AND {d.has('thousands', 'n')} THEN concat({_as_k(d, 'n')}, {d.get('m', ',*$')}) ELSE m END")
    found = d.rewrite(x, r"[\p{L}\p{N}_.,]+", "m", f"CASE WHEN {d.like('m', '^[0-9]')} THEN {done} ELSE m END")
    return f"CASE WHEN {d.size('thousands')} = 0 THEN {x} ELSE {found} END"


def repaired_months(d: Dialect, x: str) -> str:
    """Names of the months in the array ``open_months`` (of the source, short form not there yet) in their short form."""
    cases = []
    for i, (name, short) in enumerate(zip(MONTH_NAMES, MONTHS, strict=True)):
        long_form = "|".join(dict.fromkeys([name, name[:3], *(["sept"] if name == "september" else [])]))
        forms = {"march": "March|MARCH|Mar|MAR", "may": "May|MAY"}.get(name)
        cases.append(f"WHEN {d.like('w', f'^(?:{forms})$' if forms else f'(?i)^(?:{long_form})$')} AND {d.has('open_months', str(i + 1))} THEN '{short}'")
    word = d.let(d.sub("m", r"\.$"), "w", f"CASE {' '.join(cases)} ELSE m END")
    return f"CASE WHEN {d.size('open_months')} = 0 THEN {x} ELSE {d.rewrite(x, r'[A-Za-z]+\.?', 'm', word)} END"


def needs_units(d: Dialect, source: str, out: str) -> str:
    """Oku or bn is left, or the source has large units and the output has none of its own or keeps theirs."""
    o = filled(d, out)
    left = d.like(o, r"(?i)\boku\b|(?:^|[^A-Za-z_])bn\b")
    has = d.like(o, rf"(?i){NUMBER}\)?\s*(?:billion|trillion|bn)\b")
    return f"({o} <> '' AND ({left} OR ({d.like(filled(d, source), '[兆億]')} AND (NOT {has} OR {d.like(o, '[兆億]')}))))"


def k_amount(d: Dialect, v: str) -> str:
    return amount(d, f"CAST({v} AS DECIMAL(18, 6))")


def oku_expected(d: Dialect, x: str) -> str:
    return oku_amounts(d, x)
