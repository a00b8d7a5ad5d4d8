"""Tables of characters that look alike, built from the Unicode database by rule plus one short fixed list."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts that have the shape of a Latin letter.
HOMOGLYPHS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
}


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], dict[str, str], str]:
    """(one-to-one, one-to-many, signs without width), by rule:

    wide and narrow forms and no-break variants become their compatibility mapping, joined letters (ligatures and
    digraphs) become separate ones, every blank of category Zs becomes a space, format signs, variation selectors and
    other default-ignorable signs go, and accented letters over a look-alike base follow their base.
    """
    single, multi, gone = dict(HOMOGLYPHS), {}, []
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            gone.append(ch)
        elif kind == "Zs":
            single[ch] = " "
        elif (d := unicodedata.decomposition(ch)).startswith(("<wide>", "<narrow>", "<noBreak>")):
            to = unicodedata.normalize("NFKC", ch)
            (single if len(to) == 1 else multi)[ch] = HOMOGLYPHS.get(to, to)
        elif d.startswith("<compat>") and kind[0] == "L" and len(to := unicodedata.normalize("NFKC", ch)) > 1 and all(x.isalpha() for x in to):
            multi[ch] = to
        elif d and d[0] != "<" and (full := unicodedata.normalize("NFD", ch))[0] in HOMOGLYPHS:
            to = unicodedata.normalize("NFC", HOMOGLYPHS[full[0]] + full[1:])
            (single if len(to) == 1 else multi)[ch] = to
    return single, multi, "".join(gone)


@lru_cache(maxsize=1)
def python_table() -> dict[int, str]:
    """The same map for str.translate."""
    single, multi, gone = tables()
    return {ord(k): v for k, v in (single | multi).items()} | dict.fromkeys(map(ord, gone), "")


@lru_cache(maxsize=1)
def python_table_keeping_scripts() -> dict[int, str]:
    """The map without the letters of other scripts."""
    return {k: v for k, v in python_table().items() if unicodedata.normalize("NFD", chr(k))[0] not in HOMOGLYPHS}


def has_native_letters(text: str) -> bool:
    """Whether the text holds a Cyrillic or Greek letter that no Latin letter resembles: a name in its own script."""
    return any(ch.isalpha() and 0x370 <= ord(ch) < 0x530 and unicodedata.normalize("NFD", ch)[0] not in HOMOGLYPHS for ch in text)


@lru_cache(maxsize=1)
def back_to_cyrillic() -> dict[int, str]:
    """Latin letters typed inside a Cyrillic name, back to the letter they stand for."""
    return {ord(v): k for k, v in HOMOGLYPHS.items() if "Ѐ" <= k <= "ӿ" and k not in "ҮүӀѵ"}
