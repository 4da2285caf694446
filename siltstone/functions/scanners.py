"""Scanners over characters where a pattern cannot say the context: references of markup, invisible characters.

Strict references are decoded by built-in functions; the others run over Arrow batches, and only on texts in which a built-in function has seen what they look for.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of Western Europe: the named characters of U+00C0 to U+00FF but for two Icelandic letters and the signs among them.
_LETTERS = {
    name[:-1]: char
    for name, char in html.entities.html5.items()
    if name.endswith(";") and "À" <= char <= "ÿ" and char.isalpha() and char not in "ÐðÞþ" and html.entities.codepoint2name.get(ord(char)) == name[:-1]
}
#: Other names that a strict reader knows (fixed values).
_SIGNS = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "deg": "°", "hellip": "…", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—",
    "colon": ":", "sol": "/", "Tab": "\t", "NewLine": "\n", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·", "euro": "€",
}
STRICT_NAMES = _LETTERS | _SIGNS
#: Names that count in any case (fixed values).
ANY_CASE = ("amp", "lt", "gt", "quot", "apos", "nbsp")
_STRICT = regex.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);")
#: For Java: the same, and a text's references and what is between them, in order and without gaps.
_REFERENCE = "&(?:#[xX][0-9a-fA-F]++|#[0-9]++|[a-zA-Z]++);"
_TOKENS = f"{_REFERENCE}|&?+[^&]++|&+(?=&)|&"
_LOOSE = regex.compile(r"&(?:(#[xX][0-9a-fA-F]+|#[0-9]+);?|([a-zA-Z][a-zA-Z0-9]*)(;?))")
_FULL = {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")}
_LEGACY = {name: char for name, char in html.entities.html5.items() if not name.endswith(";")}
_LONGEST = max(map(len, _LEGACY))
#: Beyond the last code point.
_BEYOND = 0x110000


def _number(reference: str) -> int:
    digits, base = (reference[2:], 16) if reference[1] in "xX" else (reference[1:], 10)
    digits = digits.lstrip("0") or "0"
    return int(digits, base) if len(digits) <= 8 else _BEYOND


def _strict(m: regex.Match) -> str:
    reference = m[1]
    if reference[0] == "#":
        code = _number(reference)
        fine = code in (0x9, 0xA, 0xD) or 0x20 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code < _BEYOND
        return chr(code) if fine else m[0]
    if reference in STRICT_NAMES:
        return STRICT_NAMES[reference]
    return STRICT_NAMES[reference.lower()] if reference.lower() in ANY_CASE else m[0]


def _loose(in_text: bool) -> Callable[[regex.Match], str]:
    def decode(m: regex.Match) -> str:
        number, name, end = m[1], m[2], m[3]
        if number is not None:
            code = _number(number)
            if 0x80 <= code <= 0x9F:  # as Windows-1252 has them; five places are empty there and stay controls
                return bytes([code]).decode("cp1252", "ignore") or chr(code)
            return "�" if code == 0 or code >= _BEYOND or 0xD800 <= code <= 0xDFFF else chr(code)
        if end and name in _FULL:
            return _FULL[name]
        for n in range(min(len(name), _LONGEST), 1, -1):
            if name[:n] in _LEGACY:
                if in_text:
                    return _LEGACY[name[:n]] + name[n:] + end
                follows = name[n] if n < len(name) else end or m.string[m.end() : m.end() + 1]
                return m[0] if follows and (follows.isascii() and follows.isalnum() or follows == "=") else _LEGACY[name[:n]] + end
        return m[0]

    return decode


def decode_text(text: str, mode: str = "strict") -> str:
    """One text's references: see `entities_decoded`."""
    if mode == "strict":
        return _STRICT.sub(_strict, text)
    return _LOOSE.sub(_loose(mode == "text"), text)


def _strict_number(token: Column) -> Column:
    """The character of a numeric reference; null where XML does not allow it."""
    hexadecimal = F.lower(F.substring(token, 3, 1)) == "x"
    digits = F.ltrim(F.regexp_replace(token, "^&#[xX]?|;$", ""), F.lit("0"))
    # Eight hex digits sort as their numbers do.
    code = F.when(F.length(digits) <= 8, F.lpad(F.when(hexadecimal, F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16)), 8, "0"))

    def char(code: Column) -> Column:
        fine = code.isin("00000009", "0000000A", "0000000D") | code.between("00000020", "0000D7FF") | code.between("0000E000", "0000FFFD") | code.between("00010000", "0010FFFF")
        # The blank keeps U+FEFF from being read as a mark of byte order.
        return F.when(fine, F.substring(F.decode(F.unhex(F.concat(F.lit("00000020"), code)), "UTF-32"), 2, 1))

    return F.transform(F.array(code), char)[0]


def _strict_decoded(text: Column) -> Column:
    """`decode_text` in strict mode by built-in functions."""
    known = F.create_map(*[F.lit(x) for pair in (_SIGNS | _LETTERS).items() for x in pair])
    any_case = F.create_map(*[F.lit(x) for name in ANY_CASE for x in (name, STRICT_NAMES[name])])

    def decoded(token: Column) -> Column:
        name = F.rtrim(F.ltrim(token, F.lit("&")), F.lit(";"))
        named = F.coalesce(F.try_element_at(known, name), F.try_element_at(any_case, F.lower(name)))
        reference = F.coalesce(F.when(token.startswith("&#"), _strict_number(token)).otherwise(named), token)
        return F.when(token.rlike(rf"\A{_REFERENCE}\z"), reference).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), decoded), "")


def _mapped(function: Callable[[str], str]) -> Callable[[Column], Column]:
    return F.pandas_udf(lambda s: s.map(function, na_action="ignore"), T.StringType())


def entities_decoded(text: Column, mode: str = "strict") -> Column:
    """A text without markup's references.

    ``strict``: numbers and known names that end in a semicolon; what XML does not allow, and
    unknown names, stay as written.  ``attribute``: as a browser reads an attribute, all
    names of the standard, old names without a semicolon unless a letter, digit or
    equals sign follows, numbers without one, 0x80 to 0x9F as Windows-1252, and U+FFFD
    for what no character is.  ``text``: the same, and old names count whatever follows.
    """
    if mode not in ("strict", "attribute", "text"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "strict":
        return _strict_decoded(text)
    return F.when(text.contains("&"), _mapped(lambda s: decode_text(s, mode))(text)).otherwise(text)


#: Invisible characters by name (fixed values).
INVISIBLE = {
    0x200B: "ZERO-WIDTH SPACE", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x2060: "WORD JOINER", 0xFEFF: "BOM/ZWNBSP", 0x00AD: "SOFT HYPHEN", 0x180E: "MONGOLIAN VOWEL SEP", 0x200E: "LRM", 0x200F: "RLM",
    0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF(bidi)", 0x202D: "LRO", 0x202E: "RLO", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI",
}
_CLASS = "\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060\u2066-\u2069\ufe00-\ufe0f\ufeff\U000e0000-\U000e007f\U000e0100-\U000e01ef"
_ANY = regex.compile(f"[{_CLASS}]")
#: The same for Java.
_JAVA = "[\\x{AD}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{2066}-\\x{2069}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{E0000}-\\x{E007F}\\x{E0100}-\\x{E01EF}]"
_PICTURE, _TONE, _ARABIC = (regex.compile(p) for p in (r"\p{Extended_Pictographic}", r"\p{Emoji_Modifier}", r"(?=\p{L})\p{Script=Arabic}"))
#: Scripts whose spelling needs joiners between letters or marks (fixed values).
_BRAHMIC = [
    regex.compile(rf"(?=[\p{{L}}\p{{M}}])\p{{Script={s}}}")
    for s in ("Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala")
]
_PLAIN = str.maketrans({**dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("–—―", "-"), "…": "..."})
_CODE = regex.compile(r"(?i)<(style|script)\b[^>]*>[\s\S]*?</\1>")


def marker_label(char: str) -> str:
    code = ord(char)
    return INVISIBLE.get(code) or f"{'TAG' if 0xE0000 <= code <= 0xE007F else 'VARIATION-SEL'} U+{code:X}"


def spells(text: str, at: int) -> bool:
    """Whether a single joiner or picture selector belongs to the spelling around it."""
    char, before, after = text[at], text[at - 1 : at], text[at + 1 : at + 2]
    if char == "\ufe0f":
        return bool(_PICTURE.match(before))
    if char not in "\u200c\u200d":
        return False
    if char == "\u200d" and _PICTURE.match(after):
        last = at - 1
        if last >= 0 and (_TONE.match(text[last]) or text[last] == "\ufe0f"):
            last -= 1
        if last >= 0 and _PICTURE.match(text[last]):
            return True
    if char == "\u200c" and _ARABIC.match(before) and _ARABIC.match(after):
        return True
    return any(s.match(before) and s.match(after) for s in _BRAHMIC)


def clean_text(text: str, plain: bool = False, keep_joiners: bool = False, skip_code: bool = False) -> str:
    """One text without invisible characters: see `markers_removed`."""

    def cleaned(part: str) -> str:
        part = _ANY.sub(lambda m: m[0] if keep_joiners and m[0] != "\u00ad" and spells(part, m.start()) else "", part)
        return part.translate(_PLAIN) if plain else part

    if not skip_code:
        return cleaned(text)
    out, at = [], 0
    for m in _CODE.finditer(text):
        out += [cleaned(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, cleaned(text[at:])])


def markers_removed(text: Column, plain: bool = False, keep_joiners: bool = False, skip_code: bool = False) -> Column:
    """A text without zero-width, direction, tag and variation characters.

    ``keep_joiners`` leaves a joiner between characters whose spelling needs it (pictures,
    Arabic, scripts of India), alone and not beside others; ``plain`` makes quotes, dashes and dots ASCII;
    ``skip_code`` leaves style and script blocks as they are.
    """
    seen = text.rlike(_JAVA)
    if plain:
        seen = seen | text.rlike("[‘’‚‛“”„‟–—―…]")
    return F.when(seen, _mapped(lambda s: clean_text(s, plain, keep_joiners, skip_code))(text)).otherwise(text)


def scan_text(text: str, keep_joiners: bool = False, skip_code: bool = False) -> tuple[dict[str, int], int]:
    found: dict[str, int] = {}
    kept = 0
    for part in _CODE.sub("\x00", text).split("\x00") if skip_code else [text]:
        for m in _ANY.finditer(part):
            if keep_joiners and spells(part, m.start()):
                kept += 1
            else:
                found[marker_label(m[0])] = found.get(marker_label(m[0]), 0) + 1
    return found, kept


def markers_found(text: Column, keep_joiners: bool = False, skip_code: bool = False) -> Column:
    """(found, kept): how often each invisible character is there, by name, and how many joiners were kept; null where there are none at all."""

    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [({}, 0) if t is None else scan_text(t, keep_joiners, skip_code) for t in texts]
        return pd.DataFrame({"found": [f for f, _ in rows], "kept": [k for _, k in rows]})

    return F.when(text.rlike(_JAVA), F.pandas_udf(scan, "found map<string,long>, kept long")(text))
