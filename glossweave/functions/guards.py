"""Is a reply in the language that was asked for?  Compatibility forms and Japanese amounts of an English reply count as English."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.functions.dialect import Dialect
from glossweave.functions.text import HANGUL, IDEOGRAPH_EXT, KANA, is_blank, is_japanese_mismatch

# Punctuation that an English reply may hold, the form of numbers, words for units.
PUNCTUATION = {"、": ",", "・": "·", "「": '"', "」": '"', "『": '"', "』": '"'}
INTEGER = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
SIGN = r"([▲△+\-−])?\s*"
LARGE = re.compile(rf"{SIGN}(?:({INTEGER})兆(?:({INTEGER})億)?|({INTEGER})億)(円)?")
TEN_THOUSANDS = re.compile(rf"{SIGN}({INTEGER})万円")
PLAIN = re.compile(rf"{SIGN}({INTEGER})円")
NOT_ENGLISH = rf"[{KANA}{IDEOGRAPH_EXT}{HANGUL}・、。「」『』]"
ASCII_BLANKS = r"\x09-\x0D\x1C-\x20"
_TABLE = str.maketrans(PUNCTUATION)
_NOT_ENGLISH = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), NOT_ENGLISH))


def _number(text: str | None) -> int:
    return int((text or "0").replace(",", ""))


def _signed(sign: str | None, n: int) -> str:
    return f"{'-' if sign == '▲' else sign or ''}{n:,}"


def english_form(text: str | None) -> str:
    """The reply as it is judged: compatibility characters, punctuation and Japanese amounts in English terms."""
    if (text or "").isascii():  # nothing below matches
        return (text or "").strip()
    text = unicodedata.normalize("NFKC", text).strip().translate(_TABLE)
    text = LARGE.sub(lambda m: f"{_signed(m[1], _number(m[2]) * 10_000 + _number(m[3]) if m[2] else _number(m[4]))} oku{' yen' if m[5] else ''}", text)
    text = TEN_THOUSANDS.sub(lambda m: f"{_signed(m[1], 10 * _number(m[2]))}k yen", text)
    return PLAIN.sub(lambda m: f"{_signed(m[1], _number(m[2]))} yen", text)


def is_not_english(text: str | None) -> bool:
    if (text or "").isascii():
        return False
    form = english_form(text.strip())
    return bool(form) and bool(_NOT_ENGLISH.search(form))


def english_forms(text: Column) -> Column:
    @F.pandas_udf("string")
    def forms(texts: pd.Series) -> pd.Series:
        return texts.map(english_form)

    # Texts of ASCII alone only lose their blanks, so they need not go to Python.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.regexp_replace(text, rf"^[{ASCII_BLANKS}]+|[{ASCII_BLANKS}]+$", "")).otherwise(forms(F.when(~F.coalesce(plain, F.lit(False)), text)))


def mismatch(d: Dialect, x: str, form: str, to: str) -> str:
    """Whether ``x`` is not in the language ``to`` (en, jp, else nothing is asked); ``form`` is its English form."""
    english = d.like(form, NOT_ENGLISH)
    return f"CASE WHEN {is_blank(d, x)} THEN false WHEN lower({to}) = 'en' THEN {english} WHEN lower({to}) = 'jp' THEN {is_japanese_mismatch(d, d.strip(x))} ELSE false END"
