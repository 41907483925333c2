"""Characters behind glyph names, CIDs of Korean fonts and glyph numbers of TrueType fonts.

Names and CIDs follow rules (Unicode's own names and decompositions, the order of KS X 1001), so no table of them is kept."""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import cache

# Glyph names that no rule gives.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&",
    "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
    "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?",
    "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢",
    "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©",
    "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°",
    "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "AE": "Æ", "ae": "æ",
    "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "germandbls": "ß", "Eth": "Ð", "eth": "ð",
    "Thorn": "Þ", "thorn": "þ", "Dcroat": "Đ", "dcroat": "đ", "Hbar": "Ħ", "hbar": "ħ", "dotlessi": "ı", "multiply": "×",
    "divide": "÷", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛",
    "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•",
    "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€",
    "trademark": "™", "minus": "−", "infinity": "∞", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√",
    "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "lozenge": "◊", "arrowleft": "←",
    "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "ff": "ff", "fi": "fi", "fl": "fl", "ffi": "ffi", "ffl": "ffl",
    "nbspace": " ", "nonbreakingspace": " ", "sfthyphen": "­", "softhyphen": "­", "Delta": "∆", "Omega": "Ω",
}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ACCENTS = {
    "acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊",
    "cedilla": "̧", "caron": "̌", "breve": "̆", "ogonek": "̨", "macron": "̄", "dotaccent": "̇",
    "hungarumlaut": "̋", "commaaccent": "̧", "dotbelow": "̣", "hook": "̉", "hookabove": "̉",
    "horn": "̛",
}


@cache
def glyph_char(name: str) -> str | None:
    """The character of a glyph name; a suffix after a dot doesn't count. None if no rule knows it."""
    name = name.partition(".")[0] or name
    if name in NAMED:
        return NAMED[name]
    if len(name) == 1:
        return name
    if name in DIGITS:
        return str(DIGITS.index(name))
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})[0-9A-Fa-f]*", name):
        code = int(m[1], 16)
        return chr(code - 0xF000 if 0xF000 <= code <= 0xF0FF else code)
    if (m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if m := re.fullmatch(r"afii(100[0-9]{2})", name):
        return _cyrillic(int(m[1]))
    if "_" in name:
        parts = [glyph_char(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    for accent, mark in sorted(ACCENTS.items(), key=lambda x: -len(x[0])):
        if name.endswith(accent) and (base := glyph_char(name.removesuffix(accent))) and len(base) == 1:
            made = unicodedata.normalize("NFC", base + mark)
            return made if len(made) == 1 else None
    return _greek(name)


def _cyrillic(n: int) -> str | None:
    """afii10017 to 10049 are the capitals, with Ё after Е, afii10065 to 10097 the small letters."""
    for first, base in ((10017, 0x410), (10065, 0x430)):
        k = n - first
        if 0 <= k <= 32:
            return ("Ё" if base == 0x410 else "ё") if k == 6 else chr(base + k - (k > 6))
    return None


def _greek(name: str) -> str | None:
    m = re.fullmatch(r"([A-Za-z]+?)(dieresistonos|tonos|dieresis|1)?", name)
    if not m:
        return None
    for word in (m[1].lower(), m[1].lower().replace("lambda", "lamda"), m[1].lower() + "a"):
        try:
            kind = "FINAL SIGMA" if m[2] == "1" and word == "sigma" else word.upper()
            c = unicodedata.lookup(f"GREEK {'CAPITAL' if m[1][0].isupper() else 'SMALL'} LETTER {kind}")
        except KeyError:
            continue
        marks = {"tonos": "́", "dieresis": "̈", "dieresistonos": "̈́"}.get(m[2] or "", "")
        return unicodedata.normalize("NFC", c + marks)
    return None


def korean_char(cid: int) -> str | None:
    """The character of a CID of the Korean collection: 1 to 94 proportional Latin, 1086 to 3435 the syllables and 3436 to 8323
    the ideographs of KS X 1001 in its order. None for the others."""
    if 1 <= cid <= 94:
        return "₩" if cid == 61 else chr(31 + cid)
    for first, last, row in ((1086, 3435, 0xB0), (3436, 8323, 0xCA)):
        if first <= cid <= last:
            k = cid - first
            return bytes([row + k // 94, 0xA1 + k % 94]).decode("euc_kr", "ignore") or None
    return None


def is_garbage(text: str) -> bool:
    """Whether what a map gives for a code says nothing: a replacement character or a null."""
    return "�" in text or "\x00" in text


def truetype_chars(font: bytes) -> dict[int, str]:
    """Characters by glyph number, from the cmap table of a TrueType font (formats 4 and 12); the least character of a glyph."""
    try:
        tables = struct.unpack(">H", font[4:6])[0]
        at = next((struct.unpack(">L", font[20 + 16 * k : 24 + 16 * k])[0] for k in range(tables) if font[12 + 16 * k : 16 + 16 * k] == b"cmap"), None)
        if at is None:
            return {}
        subtables = [struct.unpack(">HHL", font[at + 4 + 8 * k : at + 12 + 8 * k]) for k in range(struct.unpack(">H", font[at + 2 : at + 4])[0])]
        found: dict[int, int] = {}
        for platform, encoding, offset in subtables:
            if platform == 0 or platform == 3 and encoding in (1, 10):
                for char, glyph in _cmap(font, at + offset):
                    if glyph and (glyph not in found or char < found[glyph]):
                        found[glyph] = char
        return {g: chr(c) for g, c in found.items() if c < 0x110000}
    except struct.error:
        return {}


def _cmap(font: bytes, at: int):
    kind = struct.unpack(">H", font[at : at + 2])[0]
    if kind == 12:
        for k in range(struct.unpack(">L", font[at + 12 : at + 16])[0]):
            first, last, glyph = struct.unpack(">LLL", font[at + 16 + 12 * k : at + 28 + 12 * k])
            yield from ((c, glyph + c - first) for c in range(first, min(last, first + 0xFFFF) + 1))
    if kind == 4:
        n = struct.unpack(">H", font[at + 6 : at + 8])[0] // 2
        part = lambda k: struct.unpack(f">{n}H", font[at + 14 + 2 * n * k + 2 * (k > 0) : at + 14 + 2 * n * (k + 1) + 2 * (k > 0)])
        ends, starts, deltas, ranges = (part(k) for k in range(4))
        for k in range(n):
            for c in range(starts[k], ends[k] + 1 if ends[k] < 0xFFFF else 0xFFFF):
                if ranges[k]:
                    where = at + 16 + 6 * n + 2 * k + ranges[k] + 2 * (c - starts[k])
                    glyph = struct.unpack(">H", font[where : where + 2])[0]
                    yield c, (glyph + deltas[k]) & 0xFFFF if glyph else 0
                else:
                    yield c, (c + deltas[k]) & 0xFFFF
