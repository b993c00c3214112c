"""Predicates, character functions, language detection and clean-up of texts, as portable expressions.

Every function takes a dialect and SQL for its argument, and returns SQL.  Null counts as the empty text.
"""

from __future__ import annotations

from glossweave.functions.dialect import BLANKS, WS, Dialect

# Code-point ranges and character sets that results depend on.
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}"
IDEOGRAPH = r"\x{4E00}-\x{9FFF}"
IDEOGRAPH_EXT = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
LATIN = r"A-Za-z\x{C0}-\x{24F}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF65}-\x{FF9F}"
JAPANESE_MARKS = r"\x{25B2}\x{25B3}\x{3007}\x{203B}"
NUMERIC_MARKS = "▲△▼▽●○■□〇※"
CURRENCY = r"\x{A5}\x{FFE5}\x{24}\x{FF04}\x{20AC}\x{A3}\x{FFE1}"
SENTENCE_END_JA = "。！？…‥）」』】｝〕〉》）＞]＞"
SENTENCE_END_EN = ".!?;:"
CLOSING = ")）]］"
UNITS_JA = "円万億千台個件名社年月日回本枚％%"
CONTINUES = "がをにでとへのはもてば、,"
# Endings after which a line goes on.
CONTINUES_SUFFIX = (
    "から", "まで", "より", "ので", "けど", "けれど", "けれども", "ながら", "たら", "なら", "のに", "ても", "でも", "だけ", "ほど", "くらい", "ばかり", "など", "なんか", "なんて", "こと", "もの",
    "ところ", "ため", "とき", "場合", "際", "して", "され", "であ", "であり", "でき", "おり", "あり", "です", "ます", "である", "となり", "とし", "につ", "にお",
)
HYPHENS = "-‐‑‒–—−"
LEADERS = "…‥・．.·"
CHINESE_HINTS = "，；："

DATE_SEPARATOR = r"[-/.\x{FF0D}\x{FF0F}\x{FF0E}]"
DIGIT = r"\p{Nd}"


def one_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"


def filled(d: Dialect, x: str) -> str:
    return f"coalesce({x}, '')"


def stripped(d: Dialect, x: str) -> str:
    return d.strip(filled(d, x))


def is_blank(d: Dialect, x: str) -> str:
    return f"({stripped(d, x)} = '')"


def is_date_like(d: Dialect, x: str) -> str:
    """Year, month, day or day, month, year in digits; a trailing line feed is tolerated."""
    two, four, sep = rf"{DIGIT}{{1,2}}", rf"{DIGIT}{{4}}", DATE_SEPARATOR
    return d.like(filled(d, x), rf"^(?:{four}{sep}{two}{sep}{two}|{two}{sep}{two}{sep}{four})\n?$")


def contains_japanese(d: Dialect, x: str) -> str:
    return d.like(filled(d, x), rf"[{KANA}{IDEOGRAPH}{JAPANESE_MARKS}]|\(cid:{DIGIT}+\)")


def has_kana(d: Dialect, x: str) -> str:
    return d.like(filled(d, x), f"[{KANA}]")


def is_japanese_only(d: Dialect, x: str) -> str:
    return f"({has_kana(d, x)} AND NOT {d.like(filled(d, x), '[A-Za-z]')})"


def is_numeric(d: Dialect, x: str) -> str:
    s = stripped(d, x)
    return f"({d.like(s, rf'^(?:[.,+()/%{NUMERIC_MARKS}-]|{DIGIT}|{WS})+$')} AND {d.like(s, DIGIT)})"


def is_email(d: Dialect, x: str) -> str:
    w = r"[\p{L}\p{N}_.-]"
    return d.like(stripped(d, x), rf"^{w}+@{w}+\.[\p{{L}}\p{{N}}_]+$")


def is_url(d: Dialect, x: str) -> str:
    return d.like(stripped(d, x), r"^https?://[^\s\x{3000}]+$")


def is_code(d: Dialect, x: str) -> str:
    return d.like(stripped(d, x), rf"^[A-Z]{{2,5}}[-_]?{DIGIT}+$")


def is_percent(d: Dialect, x: str) -> str:
    return d.like(stripped(d, x), rf"^(?:{DIGIT}|{WS}|%)+$")


def is_currency(d: Dialect, x: str) -> str:
    return d.like(stripped(d, x), rf"^[{CURRENCY}]{WS}*(?:{DIGIT}|[,.])+$")


def should_translate_generic(d: Dialect, x: str) -> str:
    s = stripped(d, x)
    bare = d.sub(s, r"[., -]")
    return f"(NOT {is_blank(d, x)} AND NOT {d.like(bare, rf'^{DIGIT}+$')})"


def _should(d: Dialect, x: str, skips: list[str], to: str) -> str:
    s = stripped(d, x)
    last = contains_japanese(d, s) if to == "en" else f"NOT {is_japanese_only(d, s)}"
    cases = "".join(f" WHEN {skip} THEN false" for skip in skips)
    return f"CASE WHEN {s} = '' THEN false WHEN {is_date_like(d, s)} THEN true{cases} ELSE {last} END"


def should_translate_cell(d: Dialect, x: str, to: str = "en") -> str:
    return _should(d, x, [is_numeric(d, x), is_email(d, x), is_url(d, x), is_code(d, x), is_percent(d, x), is_currency(d, x)], to)


def should_translate_paragraph(d: Dialect, x: str, to: str = "en") -> str:
    return _should(d, x, [is_numeric(d, x), is_url(d, x), is_email(d, x)], to)


def should_translate_pdf(d: Dialect, x: str) -> str:
    s = stripped(d, x)
    return f"CASE WHEN {d.like(s, rf'^{DIGIT}+[年月日時分秒]$')} THEN true ELSE {should_translate_cell(d, x)} END"


def right_stripped(d: Dialect, x: str) -> str:
    return d.sub(filled(d, x), rf"{WS}+$")


def is_toc_line(d: Dialect, x: str) -> str:
    return d.like(right_stripped(d, x), rf"{one_of(LEADERS)}[ \x{{3000}}]*{DIGIT}(?:{DIGIT}|[ \x{{3000}}])*$")


def toc_title(d: Dialect, x: str) -> str:
    return f"CASE WHEN {is_toc_line(d, x)} THEN {d.sub(d.get(right_stripped(d, x), rf'^(.*?){one_of(LEADERS)}+[ \x{{3000}}]*{DIGIT}(?:{DIGIT}|[ \x{{3000}}])*$', 1), rf'{WS}+$')} END"


def toc_page(d: Dialect, x: str) -> str:
    return f"CASE WHEN {is_toc_line(d, x)} THEN {d.sub(d.get(right_stripped(d, x), rf'{DIGIT}(?:{DIGIT}|[ \x{{3000}}])*$'), r'[ \x{3000}]')} END"


def is_hyphenated(d: Dialect, x: str) -> str:
    return d.like(right_stripped(d, x), f"{one_of(HYPHENS)}$")


def keeps_line_break(d: Dialect, x: str) -> str:
    return d.like(right_stripped(d, x), f"{one_of(SENTENCE_END_JA + SENTENCE_END_EN)}$")


def is_continuation(d: Dialect, x: str) -> str:
    """Seven ordered rules on the end of a line."""
    s = right_stripped(d, x)
    cjk = rf"[{KANA}{IDEOGRAPH_EXT}]"
    return (
        f"CASE WHEN {s} = '' THEN false WHEN {d.like(s, one_of(SENTENCE_END_JA + SENTENCE_END_EN) + '$')} THEN false "
        f"WHEN {d.like(s, one_of(CLOSING) + '$')} THEN false WHEN {d.like(s, one_of(UNITS_JA) + '$')} THEN false "
        f"WHEN {d.like(s, one_of(CONTINUES) + '$')} THEN true WHEN {d.like(s, '(?:' + '|'.join(CONTINUES_SUFFIX) + ')$')} THEN true "
        f"WHEN {d.like(s, '[ねよか]$')} THEN false ELSE {d.like(s, cjk)} AND {d.like(s, f'[{HIRAGANA}]$')} END"
    )


def count_of(d: Dialect, x: str, ranges: str) -> str:
    return d.count(filled(d, x), f"[{ranges}]")


def meaningful(d: Dialect, x: str) -> str:
    """Without white space and punctuation."""
    return d.without(filled(d, x), rf"{WS}|\p{{P}}", rf"{WS}\p{{P}}")


def japanese_ratio(d: Dialect, x: str) -> str:
    """Share of Japanese characters among the meaningful ones of the first 500; 0 without any."""
    return d.let(meaningful_prefix(d, x), "mf", ratio_of(d, "mf"))


def meaningful_prefix(d: Dialect, x: str) -> str:
    """The meaningful ones of the first 500 characters, which is what detection looks at."""
    return meaningful(d, f"substr({filled(d, x)}, 1, 500)")


def ratio_of(d: Dialect, m: str) -> str:
    return f"CASE WHEN {m} = '' THEN 0.0 ELSE CAST({d.count(m, f'[{HIRAGANA}{KATAKANA}{IDEOGRAPH}]')} AS DOUBLE) / length({m}) END"


# Stages of the early exit (meaningful characters, ratio at or above, ratio below).
STAGES = ((20, 0.85, 0.05), (35, 0.70, 0.08), (50, 0.60, 0.10))
SHORT_TEXT = 20


def is_japanese(d: Dialect, x: str, threshold: float = 0.3) -> str:
    """Primarily Japanese; decided at the 20th, 35th or 50th meaningful character where that is clear."""
    return d.let(meaningful_prefix(d, x), "mf", is_japanese_of(d, filled(d, x), "mf", threshold))


def is_japanese_of(d: Dialect, t: str, m: str, threshold: float = 0.3) -> str:
    """The same of a text and its meaningful prefix."""

    def ratio(s: str) -> str:
        return f"(CAST({d.count(s, f'[{HIRAGANA}{KATAKANA}{IDEOGRAPH}]')} AS DOUBLE) / length({s}))"

    stages = ""
    for n, high, low in STAGES:
        clear = d.let(ratio(f"substr({m}, 1, {n})"), "r", f"CASE WHEN r >= {high} OR r < {low} THEN r >= {threshold} END")
        stages += f" WHEN length({t}) >= {SHORT_TEXT} AND length({m}) >= {n} AND {clear} IS NOT NULL THEN {clear}"
    return f"CASE WHEN {m} = '' THEN false{stages} ELSE {ratio(m)} >= {threshold} END"


def unencodable_ideographs() -> str:
    """Ranges of the ideographs that Shift JIS X 0213 lacks, computed from the codec itself."""
    ranges, start = [], None
    for c in range(0x4E00, 0xA001):
        try:
            chr(c).encode("shift_jisx0213")
            missing = False
        except UnicodeEncodeError:
            missing = c <= 0x9FFF
        if missing and start is None:
            start = c
        elif not missing and start is not None:
            ranges.append(rf"\x{{{start:X}}}-\x{{{c - 1:X}}}" if c - 1 > start else rf"\x{{{start:X}}}")
            start = None
    return "".join(ranges)


UNENCODABLE = unencodable_ideographs()


def rare_ideographs(d: Dialect, x: str) -> str:
    """Number of ideographs outside Shift JIS X 0213; the long class meets ideographs only."""
    return d.count(d.without(filled(d, x), f"[^{IDEOGRAPH}]", f"^{IDEOGRAPH}"), f"[{UNENCODABLE}]")


def detect_reason(d: Dialect, x: str) -> str:
    """Why a language is detected: the first kana or hangul decides, then rare ideographs, then the share of Latin."""
    return d.let(meaningful_prefix(d, x), "mf", reason_of(d, "mf"))


def reason_of(d: Dialect, m: str) -> str:
    """The same of a meaningful prefix."""
    first = d.get(m, f"[{HIRAGANA}{KATAKANA}{HANGUL}]")
    return (
        f"CASE WHEN {m} = '' THEN 'empty' WHEN {d.like(first, f'[{HIRAGANA}{KATAKANA}]')} THEN 'kana' WHEN {first} <> '' THEN 'hangul' "
        f"WHEN {rare_ideographs(d, m)} >= 2 THEN 'cjk_unencodable' "
        f"WHEN {d.count(m, f'[{LATIN}]')} * 2 > length({m}) THEN 'latin' WHEN {d.like(m, f'[{IDEOGRAPH}]')} THEN 'cjk_fallback' ELSE 'default' END"
    )


def language_of_reason(reason: str) -> str:
    return f"CASE {reason} WHEN 'hangul' THEN '韓国語' WHEN 'cjk_unencodable' THEN '中国語' WHEN 'latin' THEN '英語' ELSE '日本語' END"


def detect(d: Dialect, x: str) -> str:
    return language_of_reason(detect_reason(d, x))


def direction(d: Dialect, x: str) -> str:
    t = filled(d, x)
    return (
        f"CASE WHEN {d.like(t, f'[{KANA}]')} THEN 'en' WHEN {d.like(t, f'[{HANGUL}]')} THEN 'en' WHEN {d.like(t, '[A-Za-z]')} THEN 'ja' ELSE 'en' END"
    )


def looks_chinese(d: Dialect, x: str) -> str:
    t = filled(d, x)
    n = d.count(t, f"[{IDEOGRAPH_EXT}]")
    return (
        f"CASE WHEN {has_kana(d, x)} OR {n} = 0 THEN false WHEN {d.like(t, one_of(CHINESE_HINTS))} THEN true "
        f"WHEN {d.like(t, '[、「」『』]')} THEN false WHEN {d.like(t, '。$')} AND {n} >= 8 THEN true ELSE {n} >= 25 END"
    )


def is_expected_english(d: Dialect, x: str) -> str:
    return f"({is_blank(d, x)} OR NOT {d.like(filled(d, x), rf'[{KANA}{IDEOGRAPH_EXT}{HANGUL}・、。「」『』]')})"


def is_expected_japanese(d: Dialect, x: str) -> str:
    return f"({is_blank(d, x)} OR {detect(d, x)} = '日本語')"


def estimated_tokens(d: Dialect, x: str) -> str:
    s = stripped(d, x)
    plain = d.count(s, r"[\x{00}-\x{7F}]")
    return f"(length({s}) - {plain} + {d.div(f'({plain} + 2)', '3')})"


def folded_code(d: Dialect, x: str) -> str:
    """For compact term matching: no white space, underscore, slash, backslash or hyphen."""
    return d.without_chars(f"lower({filled(d, x)})", rf"(?:{WS}|[_/\\-])+", BLANKS + "_/\\-")


def slug(d: Dialect, x: str, default: str = "run") -> str:
    return d.unless_empty(d.runs(d.strip(filled(d, x)), "A-Za-z0-9", "-"), default)


def preview(d: Dialect, x: str, n: int = 50) -> str:
    t = filled(d, x)
    return f"CASE WHEN length({t}) > {n} THEN concat(substr({t}, 1, {n}), '...') ELSE {t} END"


def fingerprint_head(d: Dialect, x: str) -> str:
    return f"CASE WHEN length({filled(d, x)}) <= 128 THEN {filled(d, x)} ELSE substr({filled(d, x)}, 1, 64) END"


def fingerprint_tail(d: Dialect, x: str) -> str:
    return f"CASE WHEN length({filled(d, x)}) <= 128 THEN {filled(d, x)} ELSE right({filled(d, x)}, 64) END"


def sampled(d: Dialect, x: str, n: int = 1200) -> str:
    """Four evenly spaced windows joined by a bar; short texts whole."""
    t, part = filled(d, x), n // 4
    windows = [f"substr({t}, 1 + {d.div(f'(length({t}) - {part}) * {k}', '3')}, {part})" for k in range(4)]
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE concat({', '.join(', '.join((w, d.text(' | '))) if i < 3 else w for i, w in enumerate(windows))}) END"


def without_fences(d: Dialect, x: str) -> str:
    kept = d.where(d.lines(filled(d, x)), "v", f"NOT {d.like('v', r'^[ \t\r]*```[A-Za-z0-9_]*[ \t\r]*$')}")
    return d.strip(d.join(kept, "\n"))


def without_markers(d: Dialect, x: str) -> str:
    marker = r"(?i)^\s*(?:###\s*INPUT\b.*|<<<INPUT_TEXT>>>|<<<END_INPUT_TEXT>>>|===INPUT_TEXT===|===END_INPUT_TEXT===|<I>|</I>(?:<end_of_turn>)?|<T>)\s*$"
    return d.strip(d.join(d.where(d.lines(filled(d, x)), "v", f"NOT {d.like('v', marker)}"), "\n"))


def without_attachments(d: Dialect, x: str) -> str:
    kind = r"(?:excel|word|powerpoint|pdf|csv|text|txt|file)"
    links = d.sub(filled(d, x), rf"(?i)(?:\s*\[[^\]]+?\|\s*{kind}\s*\]\([^)]+\)\s*)+$")
    return d.sub(links, rf"(?i)\s*\[[^\]]+?\|\s*{kind}\s*\]\s*$")


def clean_item(d: Dialect, x: str) -> str:
    return item_of(d, without_markers(d, x))


def item_of(d: Dialect, unmarked: str) -> str:
    """A text without markers also without attachment links, its id mark and a glossary label."""
    t = d.sub(without_attachments(d, unmarked), r"^\s*\[\[ID:\d+\]\]\s*")
    return d.strip(d.sub(t, r"(?i)[\s。．.、,]*(?:glossary(?:_old)?|abbreviations|用語集|略語集)(?:\.[a-z]{2,4})?\s*$"))


def plain_output(d: Dialect, x: str) -> str:
    return d.strip(without_markers(d, without_fences(d, x)))


def negative_markers(d: Dialect, x: str) -> str:
    """▲n and △n become (n), a lone marker a minus, and dashes before digits plain."""
    t = d.sub(filled(d, x), rf"[▲△]\s*({DIGIT}(?:{DIGIT}|[,.])*)", r"(\1)")
    return d.translate(d.sub(t, "[▲△]", "-"), "−－", "--")


def marked_up(d: Dialect, x: str) -> str:
    t = d.put(d.put(d.put(filled(d, x), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return d.sub(d.put(t, '"', "&quot;"), r"\*\*([^*\n]+)\*\*", r"<strong>\1</strong>")


def safe_name(d: Dialect, x: str, default: str = "translated_file") -> str:
    s = d.strip(d.sub(filled(d, x), r'[\\/:*?"<>|\x{00}-\x{1F}]', "_"))
    return d.unless_empty(s, default)


def sheet_name(d: Dialect, x: str, n: int = 31) -> str:
    s = d.sub(filled(d, x), r"[\\/?*\[\]:]", "_")
    return f"CASE WHEN length({s}) > {n} THEN concat(substr({s}, 1, {n - 3}), '...') ELSE {s} END"


def style_name(d: Dialect, x: str) -> str:
    s = f"lower({stripped(d, x)})"
    return f"CASE WHEN {d.any_of(s, ['standard', 'concise', 'minimal'])} THEN {s} ELSE 'minimal' END"


def cache_key(d: Dialect, text: str, to: str, style: str) -> str:
    return f"concat({d.text(to)}, '|', {d.text(style if to == 'en' else '')}, '|', {stripped(d, text)})"


def separator_for(d: Dialect, x: str) -> str:
    t = filled(d, x)
    return f"CASE WHEN {d.count(t, f'[{KANA}{IDEOGRAPH}]')} > {d.count(t, '[A-Za-z]')} THEN '' ELSE ' ' END"


def join_separator(d: Dialect, prev: str, following: str) -> str:
    """What stands between two lines, by the last character of one and the first of the next."""
    cjk = rf"[{KANA}{IDEOGRAPH_EXT}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}]"
    a, b = d.last(filled(d, prev)), f"substr({filled(d, following)}, 1, 1)"
    ac, bc, al, bl = d.like(a, cjk), d.like(b, cjk), d.like(a, f"[{LATIN}]"), d.like(b, f"[{LATIN}]")
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN '' WHEN {d.like(a, one_of(HYPHENS))} AND {d.like(b, '[a-z]')} THEN '' "
        f"WHEN {d.like(a, one_of(SENTENCE_END_JA + SENTENCE_END_EN))} THEN CASE WHEN {ac} OR {bc} THEN '' ELSE ' ' END "
        f"WHEN {ac} AND ({bc} OR {bl}) THEN '' WHEN {al} AND {bc} THEN '' WHEN {al} AND {bl} THEN ' ' "
        f"WHEN {d.like(a, r'[ \t\n]')} THEN '' ELSE ' ' END"
    )


def is_japanese_mismatch(d: Dialect, x: str) -> str:
    """A reply that should be Japanese and is Chinese, Korean, longer English, or ideographs that look Chinese."""
    t, reason = filled(d, x), detect_reason(d, x)
    return (
        f"CASE WHEN {is_blank(d, x)} THEN false WHEN {reason} IN ('hangul', 'cjk_unencodable') THEN true "
        f"WHEN {reason} = 'latin' THEN {d.like(t, r'[ \t\n]')} OR length({t}) >= 12 WHEN {reason} = 'cjk_fallback' THEN {looks_chinese(d, x)} ELSE false END"
    )


def is_mismatch(d: Dialect, x: str, to: str) -> str:
    return f"(NOT {is_expected_english(d, x)})" if to == "en" else is_japanese_mismatch(d, x)


def clean_output(d: Dialect, x: str) -> str:
    """Without turn tags, fences and a leading label."""
    t = without_fences(d, d.sub(filled(d, x), r"</?(?:start_of_turn|end_of_turn|bos|eos)>"))
    return d.strip(d.sub(t, r"(?i)^(?:英語翻訳|日本語翻訳|English\s*Translation|Japanese\s*Translation)\s*[:：]?\s*"))


def segments(d: Dialect, x: str) -> str:
    """The text cut into line breaks and what stands between them; joined again it is the text."""
    return d.all(filled(d, x), r"\r\n|\r|\n|[^\r\n]+")


def table_rows(d: Dialect, x: str) -> str:
    return f"CASE WHEN {d.like(filled(d, x), chr(9))} THEN {d.size(d.lines(filled(d, x)))} ELSE 0 END"


def table_columns(d: Dialect, x: str) -> str:
    """The largest number of cells in a line; 0 without tabs."""
    widths = d.map(d.lines(filled(d, x)), "v", f"length(v) - length({d.put('v', chr(9), '')}) + 1")
    return f"CASE WHEN {d.like(filled(d, x), chr(9))} THEN {d.largest(widths)} ELSE 0 END"


def structure(d: Dialect, x: str) -> str:
    """Flags of a text's form: line feeds, numbered lines, bullets."""
    t = filled(d, x)
    return (
        f"concat(CASE WHEN {d.like(t, chr(10))} THEN 'lines ' ELSE '' END, CASE WHEN {d.like(t, r'(?m)^\s*[0-9]+[.)]')} THEN 'numbered ' ELSE '' END, "
        f"CASE WHEN {d.like(t, r'(?m)^\s*[-•・*]')} THEN 'bullets ' ELSE '' END)"
    )


def is_line_prefix(d: Dialect, shorter: str, longer: str) -> str:
    """The longer text starts with the shorter one and goes on, if at all, with a line feed."""
    a, b = filled(d, shorter), filled(d, longer)
    return f"({d.starts(b, a)} AND (length({a}) = length({b}) OR substr({b}, length({a}) + 1, 1) = {d.text(chr(10))}))"


def is_raw_prompt(d: Dialect, x: str) -> str:
    return d.starts(filled(d, x), d.text("<bos><start_of_turn>"))


def repeated_prompt(d: Dialect, x: str) -> str:
    return f"concat({filled(d, x)}, {d.text(chr(10) * 2)}, {filled(d, x)})"
