"""References and invisible characters against definitions written out, over all code points where that is possible."""

import html
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import markup, scanners

STRICT = {
    "D&eacute;veloppeur &amp; Fran&ccedil;ais": "Développeur & Français", "&Eacute;&eacute;": "Éé", "&AMP;&Lt;": "&<", "&copy; &eth; &thorn;": "&copy; &eth; &thorn;", "&#65;&#x42;&#X43;": "ABC",
    "&#1a2;": "&#1a2;", "&#0;&#xD800;&#xFFFE;&#x110000;&#8;": "&#0;&#xD800;&#xFFFE;&#x110000;&#8;", "&#9;|&#10;|&#13;": "\t|\n|\r", "&#146;": "\x92", "&amp;lt;": "&lt;", "&ampx;": "&ampx;",
    "&amp": "&amp", "&#65": "&#65", "&szlig;&yuml;&nbsp;.": "ßÿ .", "&#" + "9" * 5000 + ";": "&#" + "9" * 5000 + ";", "&#x1F600;": "😀", "": "", "&": "&", "&;": "&;",
}
ATTRIBUTE = {
    "a?b=1&amp=2": "a?b=1&amp=2", "&ampx": "&ampx", "&amp ": "& ", "&notit;": "&notit;", "&not;": "¬", "&copy": "©", "&#58//x": "://x", "&#146;": "’", "&#x81;": "\x81", "&#0;": "�",
    "&#xD800;": "�", "&#x110000;": "�", "&#8;": "\x08", "&colon;": ":", "&unknown;": "&unknown;", "&quothttps": "&quothttps", "&lt;b": "<b", "&amp&lt;": "&<",
}


def test_references(spark):
    for mode, cases in (("strict", STRICT), ("attribute", ATTRIBUTE)):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate([*cases, None])], "k long, v string")
        got = {r.k: r.d for r in rows.select("k", scanners.entities_decoded(F.col("v"), mode).alias("d")).collect()}
        assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[len(cases)] is None
    assert scanners.decode_text("&quothttps &notit; &amp=", "text") == '"https ¬it; &='
    with pytest.raises(ValueError, match="unknown mode"):
        scanners.entities_decoded(F.col("v"), "other")


def test_text_mode_is_the_standard():
    """As the standard library reads text, but for what a control or surrogate becomes."""
    rng = random.Random(49)
    parts = ["&", "amp", "not", "it", ";", "#", "x41", "65", "copy", "=", "ü", " ", "lt", "GT", "frac12", "&notin;", "&ThickSpace;", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=8))
        assert scanners.decode_text(text, "text") == html.unescape(text), text


def test_numbers_over_all_code_points():
    for code in [*range(0x300), *range(0xD7F0, 0xE010), *range(0xFFF0, 0x10010), 0x10FFFF, 0x110000]:
        xml = code in (9, 10, 13) or 32 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF
        assert scanners.decode_text(f"&#{code};") == scanners.decode_text(f"&#x{code:X};") == (chr(code) if xml else f"&#{code};") or not xml


def test_strict_references_need_no_python(spark, capsys):
    """Built-in functions give what the plain version gives, for each name and number and for texts of many references."""
    rng = random.Random(12)
    parts = ["&", "amp", "AMP", "Lt", "&lt;", "&gT;", "&nbsp;", "copy", "eacute", ";", "#", "#x", "X1F600", "41", "0000000000065", "xfeff", "\ufeff", "\n", "\r", "\u2028", "ü", "😀", " ", "b;&", "&#xFEFF;", "&#38;", "9" * 30]
    codes = [*range(0x300), *range(0xD7F0, 0xE010), 0xFEFF, *range(0xFFF0, 0x10010), 0x10FFFF, 0x110000, 10**7, 10**8 - 1, 10**8, 0xFFFFFFFF]
    texts = [f"{form.format(c)}" for c in codes for form in ("&#{};", "&#x{:x};", "a&#X{:08X};b")]
    texts += [f"&{case};" for name in {*scanners.STRICT_NAMES, "copy", "thorn"} for case in (name, name.lower(), name.upper(), name.title())]
    texts += ["".join(rng.choices(parts, k=12)) for _ in range(3000)] + ["x&amp;" * 20000, "&" * 50000, "&" + "a" * 50000, "no reference " * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, v string").select("k", scanners.entities_decoded(F.col("v")).alias("d"))
    got = {r.k: r.d for r in rows.collect()}
    assert [texts[k] for k in range(len(texts)) if got[k] != scanners.decode_text(texts[k])] == []
    pages = spark.createDataFrame([("<p>&lt;</p>",)], "v string")
    pages.select(markup.html_to_text(F.col("v")), markup.block_text(F.col("v"))).explain()
    assert "EvalPython" not in capsys.readouterr().out


ZWSP, ZWNJ, ZWJ, VS16, SHY = "\u200b", "\u200c", "\u200d", "\ufe0f", "\u00ad"
MAN, LAPTOP, TONE, HEART = "\U0001f468", "\U0001f4bb", "\U0001f3fd", "❤"
#: A text, what stays of it, and what stays with the joiners that spelling needs.
JOINED = [
    (f"a{ZWSP}b{SHY}c\ufeff", "abc", "abc"),
    (f"{MAN}{ZWJ}{LAPTOP}", MAN + LAPTOP, f"{MAN}{ZWJ}{LAPTOP}"),
    (f"{MAN}{TONE}{ZWJ}{LAPTOP}", MAN + TONE + LAPTOP, f"{MAN}{TONE}{ZWJ}{LAPTOP}"),
    (f"{HEART}{VS16}{ZWJ}{MAN}", HEART + MAN, f"{HEART}{VS16}{ZWJ}{MAN}"),
    (f"a{ZWJ}{MAN}", f"a{MAN}", f"a{MAN}"),
    (f"{VS16}x{VS16}", "x", "x"),
    ("می\u200cخواهم", "میخواهم", "می\u200cخواهم"),
    ("می\u200c\u200cخواهم", "میخواهم", "میخواهم"),
    ("می\u200c ", "می ", "می "),
    ("١\u200c٢", "١٢", "١٢"),
    ("क्\u200dष", "क्ष", "क्\u200dष"),
    ("क्\u200dক", "क्ক", "क्ক"),
    ("\u200dक", "क", "क"),
    ("\U000e0041tag\U000e0101\u202eabc\u2066", "tagabc", "tagabc"),
    ("plain — “text”…", "plain — “text”…", "plain — “text”…"),
]


def test_markers(spark):
    rows = spark.createDataFrame([(k, x[0]) for k, x in enumerate([*JOINED, (None,)])], "k long, v string")
    both = rows.select("k", scanners.markers_removed(F.col("v")).alias("bare"), scanners.markers_removed(F.col("v"), keep_joiners=True).alias("kept"), scanners.markers_found(F.col("v"), True).alias("f"))
    got = {r.k: r for r in both.collect()}
    for k, (text, bare, kept) in enumerate(JOINED):
        assert (got[k].bare, got[k].kept) == (bare, kept), ascii(text)
        gone = len(text) - len(kept)
        assert (sum(got[k].f.found.values()) if got[k].f else 0) == gone and (got[k].f.kept if got[k].f else 0) == len(kept) - len(bare)
    assert got[len(JOINED)].bare is None and got[len(JOINED)].f is None


def test_every_code_point_is_judged_by_its_class():
    named = set(scanners.INVISIBLE)
    for code in [*range(0x20, 0x3000), *range(0xFD00, 0x10000), *range(0xE0000, 0xE0200)]:
        hidden = code in named or 0xE0000 <= code <= 0xE007F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF
        assert (scanners.clean_text(f"a{chr(code)}b") == "ab") == hidden, hex(code)
        if hidden:
            assert scanners.scan_text(chr(code)) == ({scanners.marker_label(chr(code)): 1}, 0)


def test_plain_signs_and_code(spark):
    page = f"<style>a{ZWSP}—</style>“x”{ZWSP} – ‘y’…<SCRIPT>z{ZWSP}</SCRIPT>"
    row = spark.createDataFrame([(page,)], "v string").select(scanners.markers_removed(F.col("v"), plain=True, skip_code=True), scanners.markers_removed(F.col("v")), scanners.markers_found(F.col("v"), skip_code=True)).first()
    assert row[0] == f"<style>a{ZWSP}—</style>\"x\" - 'y'...<SCRIPT>z{ZWSP}</SCRIPT>"
    assert row[1] == page.replace(ZWSP, "") and row[2].found == {"ZERO-WIDTH SPACE": 1}
