"""Arrow functions for what has no built-in: sequence similarity, entities, character sets, byte streams."""

from __future__ import annotations

import difflib
import hashlib
import html
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character pairs that appear where UTF-8 Cyrillic was read as code page 1251.
MOJIBAKE = ("Рџ", "РЎ", "Рё", "Рµ", "Р°", "РЅ", "С‚", "СЂ", "СЏ", "СЊ")
ENCODINGS = ("utf-8", "cp866", "cp1251")


@lru_cache(maxsize=1 << 14)
def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two texts, in this order."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else html.unescape(v))


def markers(text: str) -> int:
    return sum(text.count(m) for m in MOJIBAKE)


def repaired(text: str | None) -> str | None:
    """Text whose UTF-8 was read as code page 1251, put right if the signs are strong and most of them go."""
    if text is None or markers(text) < 3:
        return text
    try:
        other = text.encode("cp1251").decode("utf-8")
    except UnicodeError:
        return text
    return other if markers(other) * 3 < markers(text) else text


@F.pandas_udf(T.StringType())
def repair_mojibake(x: pd.Series) -> pd.Series:
    return x.map(repaired)


def looks_utf16(data: bytes) -> bool:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return True
    head = data[:200]
    return len(data) >= 4 and max(map(high_bytes, (head[0::2], head[1::2]))) >= max(2, len(head) // 5)


def high_bytes(part: bytes) -> int:
    """Bytes that are the upper half of Latin or Cyrillic characters in UTF-16, and stand in no other text."""
    return part.count(0) + part.count(4)


_RUSSIAN = re.compile("[а-яё]", re.IGNORECASE)
# Characters and pairs that mark text decoded with the wrong character set.
WRONG = "\ufffdÐÑЋЎЄҐ¤©«»╨╤╬├┬"
WORST = "╨╤"
WRONG_PAIRS = (
    "Р° Р± РІ Рі Рґ Рµ Рё Р№ Рє Р» Рј РЅ Рѕ Рї СЂ СЃ С‚ Сѓ С„ С… С† С‡ С€ С‰ С‹ СЊ СЌ СЋ СЏ С‘ Р” Рџ РЎ Рњ Рќ Рћ Р\u00ad â€¦ â€ â„ â€“ â€” "
    "тА тВ тГ тД тЕ тЖ тЗ тИ тК тЛ тМ тН тО тП тР тС тТ тУ тФ тХ тЦ тЧ тШ тЩ тЪ тЫ тЬ тЭ тЮ тЯ"
).split(" ")


def _worth(c: str) -> int:
    """What one character says for a decoding: Russian and printable ASCII letters, and the drawing characters of terminals."""
    code = ord(c)
    plain = c in "\r\n\t"
    if _RUSSIAN.match(c):
        value = 8
    elif c.isascii() and (plain or c.isprintable()):
        value = 2
    elif 0x2500 <= code <= 0x259F or 0x2800 <= code <= 0x28FF:
        value = 0 if c in WRONG else 30
    else:
        value = int(c.isprintable())
    if c in WRONG:
        value -= 60 if c in WORST else 20
    return value - 30 * (code < 32 and not plain)


def plausibility(text: str, encoding: str) -> int:
    """How well decoded bytes read, from each character's worth and the pairs that wrong decodings leave."""
    own = sum(_worth(c) * n for c, n in Counter(text).items())
    return own + 20 * (encoding == "utf-8") - 40 * text.count("\0") - 80 * text.count("\ufffd" * 4) - 120 * sum(text.count(x) for x in WRONG_PAIRS)


def decoded(data: bytes) -> str:
    """Bytes of an unknown encoding as text: the encoding that reads best, the first of equals."""
    if not data:
        return ""
    choices = ENCODINGS[:1] + (("utf-16", "utf-16-le", "utf-16-be") if looks_utf16(data) else ()) + ENCODINGS[1:]
    best = None
    for encoding in choices:
        try:
            text = data.decode(encoding)
        except UnicodeError:
            continue
        rated = plausibility(text, encoding)
        if best is None or rated > best[0]:
            best = rated, text
    return (best[1] if best else data.decode("utf-8", "replace")).lstrip("﻿")


@F.pandas_udf(T.StringType())
def decode_bytes(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else decoded(bytes(v)))


@F.pandas_udf(T.StringType())
def read_text(x: pd.Series) -> pd.Series:
    """Text files: UTF-8 with or without a mark, else code page 1251, else Latin-1."""

    def one(data):
        if data is None:
            return None
        for encoding in ("utf-8-sig", "cp1251", "latin-1"):
            try:
                return bytes(data).decode(encoding)
            except UnicodeError:
                continue
        return None

    return x.map(one)


#: Escape sequences of terminals: CSI, OSC, and other two-byte ones.
ANSI = r"\x1B\[[0-?]*[ -/]*[@-~]|\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)?|\x1B[@-Z\\-_]"


def strip_ansi(column):
    """Log lines without escape sequences and control characters (tabs and line ends stay)."""
    return F.regexp_replace(F.regexp_replace(column, ANSI, ""), r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")


@F.pandas_udf(T.StringType())
def blake2b_key(x: pd.Series) -> pd.Series:
    """A key of 16 bytes in hexadecimal, for names of cached files."""
    return x.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=16).hexdigest())
