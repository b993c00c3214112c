"""Scalar rules on boxes, sizes and times, as portable expressions over numeric SQL."""

from __future__ import annotations

from glossweave.functions.dialect import Dialect

# Sizes in points, ratios and tolerances that results depend on.
TOLERANCE = 5.0
DEFAULT_SIZE, LEAST_SIZE, MOST_SIZE = 10.0, 5.0, 72.0
HEIGHT_RATIO, LINE_ESTIMATE, WIDTH_FACTOR = 0.8, 14.0, 1.8
SMALL_SCRIPT = 0.79
PAGE_MB = 26.0
ROLES = {
    "text": "paragraph", "paragraph_title": "title", "document_title": "title", "abstract": "abstract", "content": "paragraph", "reference": "reference", "footnote": "footnote",
    "algorithm": "code", "aside": "aside", "table": "table_cell", "table_caption": "caption", "section_header": "section_header", "page_header": "header", "page_footer": "footer",
    "header": "header", "footer": "footer", "page_number": "page_number",
}


def role(d: Dialect, label: str) -> str:
    return f"CASE {label} {' '.join(f'WHEN {d.text(k)} THEN {d.text(v)}' for k, v in ROLES.items())} ELSE 'paragraph' END"


def vertical_alignment(text0: str, text1: str, box0: str, box1: str) -> str:
    """Of a text in its box, with y growing upwards."""
    top, bottom, t = f"({box1} - {text1})", f"({text0} - {box0})", TOLERANCE
    return (
        f"CASE WHEN {box1} - {box0} <= 0 THEN 'top' WHEN abs({top} - {bottom}) < {2 * t} AND {top} > {t} AND {bottom} > {t} THEN 'center' "
        f"WHEN {top} > {bottom} + {t} THEN 'bottom' ELSE 'top' END"
    )


def expanded(low: str, high: str, before: str, after: str, alignment: str, ratio: float = 2.0) -> tuple[str, str]:
    """New ends of a span that may grow by ``before`` and ``after``, up to a ratio of its length, away from its anchor."""
    most = f"(({high} - {low}) * {ratio - 1.0})"
    half = f"least({before}, {after}, {most} / 2)"
    lo = f"CASE WHEN {high} <= {low} OR {alignment} = 'bottom' THEN {low} WHEN {alignment} = 'center' THEN {low} - {half} ELSE {low} - least({before}, {most}) END"
    hi = f"CASE WHEN {high} <= {low} OR {alignment} = 'top' THEN {high} WHEN {alignment} = 'center' THEN {high} + {half} ELSE {high} + least({after}, {most}) END"
    return lo, hi


def font_size(width: str, height: str, chars: str) -> str:
    most = f"({height} * {HEIGHT_RATIO})"
    line = f"greatest(1.0, {chars} / greatest(1.0, {height} / {LINE_ESTIMATE}))"
    return (
        f"CASE WHEN {width} <= 0 OR {height} <= 0 THEN {DEFAULT_SIZE} WHEN {chars} = 0 THEN least({most}, {MOST_SIZE}) "
        f"ELSE greatest(least({most}, {width} / {line} * {WIDTH_FACTOR}, {MOST_SIZE}), {LEAST_SIZE}) END"
    )


def script_style(size: str, base: str, offset: str, line: str) -> str:
    return (
        f"CASE WHEN {base} <= 0 OR {size} > {base} * {SMALL_SCRIPT} THEN 'normal' WHEN {line} > 0 AND {offset} > {line} * 0.3 THEN 'superscript' "
        f"WHEN {line} > 0 AND {offset} < -({line} * 0.3) THEN 'subscript' ELSE 'superscript' END"
    )


def flipped(y: str, page_height: str) -> str:
    """Between coordinates that grow upwards and downwards."""
    return f"({page_height} - {y})"


def thresholds(width: str, size: str) -> dict[str, str]:
    """Distances that part lines, paragraphs and columns."""
    return {"y_line": f"greatest({size} * 0.3, 3.0)", "y_para": f"greatest({size} * 1.8, 20.0)", "x_column": f"greatest(50.0, {width} * 0.2)"}


def memory_mb(pages: str, dpi: str) -> str:
    return f"({pages} * {PAGE_MB} * ({dpi} / 300.0) * ({dpi} / 300.0))"


def eta(d: Dialect, seconds: str) -> str:
    """Seconds in words: seconds, minutes, or hours and minutes."""
    kind = {"spark": "STRING", "oracle": "VARCHAR"}[d.name]
    s = f"greatest(0, CAST(floor({seconds}) AS BIGINT))"
    minutes = d.div(s, "60")

    def text(x: str) -> str:
        return f"CAST({x} AS {kind})"

    return (
        f"CASE WHEN {seconds} IS NULL THEN '--' WHEN {s} < 60 THEN concat({text(s)}, '秒') WHEN {s} < 3600 THEN concat({text(minutes)}, '分') "
        f"ELSE concat({text(d.div(s, '3600'))}, '時間', {text(f'({minutes} % 60)')}, '分') END"
    )


def scaled_progress(current: str, total: str, start: int, end: int) -> str:
    done = f"least(greatest({current}, 0), {total})"
    return f"({start} + CAST(floor(CAST({done} AS DOUBLE) / {total} * {end - start}) AS BIGINT))"
