"""How the lines of a paragraph join: small helpers on the text so far and the next character."""

from __future__ import annotations

import re

from glossweave.functions.pagetext import OPENING_END
from glossweave.functions.text import CLOSING, CONTINUES, CONTINUES_SUFFIX, HYPHENS, LEADERS, SENTENCE_END_EN, SENTENCE_END_JA, UNITS_JA

# Fixed ranges, as in ``forms``.
_CJK = re.compile("[　-ヿ㐀-䶿一-鿿！-｠･-ﾟ]")
_LATIN = re.compile("[A-Za-z0-9À-ɏ]")
_CONTENTS = re.compile(f"[{re.escape(LEADERS)}][\\d 　]*\\d\\Z")
_ENDS = frozenset(SENTENCE_END_JA + SENTENCE_END_EN)
_NEVER = _ENDS | frozenset(CLOSING + UNITS_JA)


def is_cjk(char: str) -> bool:
    return bool(_CJK.match(char))


def is_contents_line(text: str) -> bool:
    """A leader, then a page number."""
    return bool(_CONTENTS.search(text.rstrip()))


def continues(text: str) -> bool:
    """Whether Japanese text goes on in the next line."""
    text = text.rstrip()
    if not text or text[-1] in _NEVER:
        return False
    if text[-1] in CONTINUES or text.endswith(CONTINUES_SUFFIX):
        return True
    return text[-1] not in "ねよか" and "぀" <= text[-1] <= "ゟ"


def wraps(text: str, char: str) -> bool:
    """Whether a weak boundary between ``text`` and ``char`` is only the end of a line."""
    text = text.rstrip()
    if not text:
        return False
    if continues(text):
        return True
    ended = text[-1] in _ENDS or text[-1] in UNITS_JA or is_contents_line(text)
    return bool(re.search("[A-Za-z]", text)) and not _CJK.search(text) and not ended and not is_cjk(char)


def ends_open(text: str) -> bool:
    return text.rstrip()[-1:] in [*OPENING_END]


def is_short_cjk(text: str) -> bool:
    text = text.rstrip()
    return 0 < len(text) <= 2 and all(map(is_cjk, text))


def joined_lines(text: str, char: str) -> str:
    """``text`` with what stands between it and a next line that starts with ``char``."""
    if not text:
        return text
    last = text[-1]
    if last in HYPHENS and char.islower():
        return text[:-1]
    if last in _ENDS:
        return text if is_cjk(last) or is_cjk(char) else text + " "
    cjk, latin = is_cjk(last), bool(_LATIN.match(last))
    if cjk and (is_cjk(char) or _LATIN.match(char)) or latin and is_cjk(char) or last in " \t\n":
        return text
    return text + " "


def spaced(text: str, char: str) -> str:
    """``text`` with a blank where a gap before ``char`` parts words."""
    return text if is_cjk(text[-1:]) or is_cjk(char) or text.endswith(" ") else text + " "
