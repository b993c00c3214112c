"""Text functions that built-in expressions cannot express, as Arrow-batched pandas UDFs.

Each plain function takes Python values and is what the tests pin; ``udf`` wraps it.  Null counts as empty.
"""

from __future__ import annotations

import ast
import difflib
import json
import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

# Units in yen, where long texts may be cut, and how formulas and amounts look.
TEN_K, HUNDRED_M, TRILLION = 10**4, 10**8, 10**12
SENTENCE, CLAUSE, EDGE = "。！？.!?", "、，,;；:：", " \t"
_AMOUNT = re.compile(r"([▲△+\-−]?)\s*(?:([\d,]+)兆)?(?:([\d,]+)億)?(?:([\d,]+)万)?(円)?")
_FORMULA = (re.compile(r"\$\$.+?\$\$", re.S), re.compile(r"\$[^$\n]+\$"), re.compile(r"\\[A-Za-z]+\{[^{}]*\}"))


def folded(text: str | None) -> str:
    """Compatibility form without case; ideographic blanks count as blanks."""
    return unicodedata.normalize("NFKC", text or "").replace("\u3000", " ").casefold()


def bare(text: str | None) -> str:
    """``folded`` without any white space."""
    return "".join(folded(text).split())


def looks_untranslated(source: str | None, out: str | None) -> bool:
    return bool(bare(source)) and bare(source) == bare(out)


def similarity(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def loose_json(text: str | None) -> str | None:
    """JSON text of what a reply holds: as it stands, without trailing commas, or as a Python literal."""
    body = re.sub(r"^\s*```(?:json)?\s*$", "", text or "", flags=re.M | re.I).strip()
    found = re.search(r"[\[{]", body)
    if not found:
        return None
    end = body.rfind("}" if body[found.start()] == "{" else "]")
    body = body[found.start() : end + 1]
    for read in (json.loads, lambda s: json.loads(re.sub(r",\s*([\]}])", r"\1", s)), ast.literal_eval):
        try:
            value = read(body)
        except (ValueError, SyntaxError):
            continue
        if isinstance(value, dict | list):
            try:
                return json.dumps(value, ensure_ascii=False)
            except TypeError:
                return None
    return None


def is_truncated(text: str | None) -> bool:
    """Whether brackets or a string stay open; a closer that fits nothing means broken, not truncated."""
    found = re.search(r"[\[{]", text or "")
    if not found:
        return False
    closers, pending = {"{": "}", "[": "]"}, []
    outside = re.sub(r'"(?:[^"\\]|\\.)*"', "", (text or "")[found.start() :], flags=re.S)
    outside, quote, _ = outside.partition('"')
    for ch in outside:
        if ch in closers:
            pending.append(closers[ch])
        elif ch in "]}" and (not pending or pending.pop() != ch):
            return False
    return bool(quote or pending)


def _version(value: str) -> tuple | None:
    v = value.lstrip("v").strip()
    if re.fullmatch(r"\d{8}", v):
        return ("date", int(v))
    main, _, pre = v.split("+", 1)[0].partition("-")
    rank = lambda p: (0, int(p), "") if p.isdigit() else (1, 0, p)
    parts = [rank(p) for p in main.split(".") if p]
    return ("parts", parts, [rank(p) for p in pre.split(".") if p] if pre else None) if parts else None


def is_newer(latest: str | None, current: str | None) -> bool:
    """Dates by value, dotted versions by part with releases above pre-releases, anything else as text."""
    a, b = _version(latest or ""), _version(current or "")
    if not a or not b or a[0] != b[0]:
        return (latest or "") > (current or "")
    if a[0] == "date":
        return a[1] > b[1]
    pad = lambda x, n: x + [(0, 0, "")] * (n - len(x))
    n = max(len(a[1]), len(b[1]))
    if pad(a[1], n) != pad(b[1], n):
        return pad(a[1], n) > pad(b[1], n)
    if a[2] is None or b[2] is None:
        return a[2] is None and b[2] is not None
    n = max(len(a[2]), len(b[2]))
    return pad(a[2], n) > pad(b[2], n)


def long_pieces(text: str | None, limit: int) -> list[str]:
    """Pieces of at most ``limit``: cut after the last sentence end in the window's far half, else clause end, else blank."""
    rest, out = text or "", []
    soft = max(64, limit // 2)
    while len(rest) > limit:
        far = rest[soft:limit]
        at = 0
        for marks in (SENTENCE, CLAUSE):
            at = max((far.rfind(c) + 1 for c in marks), default=0)
            if at:
                at += soft
                break
        if not at:
            at = max(rest[1:limit].rfind(c) for c in EDGE) + 2
        at = at if at > 1 else limit
        out.append(rest[:at])
        rest = rest[at:]
    return [*out, rest] if rest else out


def yen_in_english(text: str | None) -> str:
    """Amounts in 10^12, 10^8 and 10^4 as billions with one decimal, or thousands; a sign before the currency."""

    def say(m: re.Match[str]) -> str:
        sign, cho, oku, man, yen = m.groups()
        if not (cho or oku or man):
            return m[0]
        value = sum(int(x.replace(",", "") or 0) * u for x, u in ((cho or "0", TRILLION), (oku or "0", HUNDRED_M), (man or "0", TEN_K)))
        minus = "-" if sign in ("▲", "△", "-", "−") else ""
        amount = f"{value / 1e9:,.1f} billion" if cho or oku else f"{value // 1000:,}k"
        return f"{minus}{'¥' if yen else ''}{amount}"

    return _AMOUNT.sub(say, text or "")


def protect_formulas(text: str | None) -> tuple[str, list[str]]:
    """The text with each formula replaced by ``{v0}``, ``{v1}``, ..., and the formulas."""
    held: list[str] = []
    out = text or ""
    for pattern in _FORMULA:

        def keep(m: re.Match[str]) -> str:
            held.append(m[0])
            return f"{{v{len(held) - 1}}}"

        out = pattern.sub(keep, out)
    return out, held


def restore_formulas(text: str | None, held: list[str]) -> str:
    """The inverse; numbers out of range stay.  Brackets of any kind are accepted.

    A formula can hold marks of those found before it and of no others, so each mark is put back once.
    """

    def put(m: re.Match[str]) -> str:
        i = int(m[1])
        return restore_formulas(held[i], held[:i]) if i < len(held) else m[0]

    return re.sub(r"[{(\[]\s*v\s*(\d+)\s*[})\]]", put, text or "")


def wrapped(text: str | None, width: float, size: float) -> list[str]:
    """Greedy lines of at most ``width``: wide characters take ``size``, others half; only blanks may part words."""
    lines: list[str] = []
    for part in (text or "").split("\n"):
        line, used = "", 0.0
        for token in re.findall(r"[\u3000-\u9fff\uf900-\uffef]|[^\s\u3000-\u9fff\uf900-\uffef]+\s*|\s+", part):
            need = sum(size if unicodedata.east_asian_width(c) in "WF" else size / 2 for c in token.rstrip())
            if line and used + need > width:
                lines.append(line.rstrip())
                line, used = "", 0.0
            line += token
            used += sum(size if unicodedata.east_asian_width(c) in "WF" else size / 2 for c in token)
        lines.append(line.rstrip())
    return lines


def marked_changes(base: str | None, target: str | None) -> str:
    """The target as HTML, with what is new against the base in marks; blanks and words are the units."""
    a, b = (re.findall(r"\s+|\S+", t or "") for t in (base, target))
    out = []
    for kind, _, _, lo, hi in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if part := html.escape("".join(b[lo:hi])):
            out.append(part if kind == "equal" else f'<span class="diff-added">{part}</span>')
    return "".join(out).replace("\n", "<br>")


_ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _recipient(name: str, address: str) -> str:
    name = name.strip().strip('"')
    if "@" in name or name.lower() == address.lower():
        name = ""
    if re.search(r'[",;<>]', name):
        name = f'"{name}"'
    return f"{name} <{address}>" if name else address


def _recipients_in(token: str) -> list[str]:
    if found := re.findall(rf"([^<]*)<({_ADDRESS})>", token):
        return [_recipient(n.strip().strip('"').strip(" ,;"), a) for n, a in found]
    if m := re.fullmatch(rf"({_ADDRESS})\s*\(([^)]*)\)", token):
        return [_recipient(m[2], m[1])]
    addresses = re.findall(_ADDRESS, token)
    if len(addresses) > 1:
        return [r for part in token.split(",") if part.strip() for r in _recipients_in(part.strip())]
    if addresses:
        name = token.replace(addresses[0], "").replace("<", "").replace(">", "").strip().strip('"').strip(" ,;()")
        return [_recipient(name, addresses[0])]
    return [token]


def recipients(raw: str | None) -> str:
    """Distinct recipients in order, names that need it in quotes, names that repeat an address left out."""
    text = (raw or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    tokens = [t.strip() for t in re.split(r"[;\n]+", text)]
    return "; ".join(dict.fromkeys(r for t in tokens if t for r in _recipients_in(t)))


def pasted(text: str | None) -> str:
    """Rows of tab-parted cells as a spreadsheet takes them: CRLF between rows, cells with quotes quoted."""
    rows = [line.split("\t") for line in (text or "").replace("\r\n", "\n").split("\n")]
    return "\r\n".join("\t".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if '"' in c else c for c in row) for row in rows)


def udf(function: Callable, kind: str, *fixed: object) -> Callable:
    """A pandas UDF of one of the functions above, over as many columns as it is given."""

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([function(x, *fixed) for x in a])

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y, *fixed) for x, y in zip(a, b, strict=True)])

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)
