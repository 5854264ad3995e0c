"""Column functions over text: lines, words, whitespace, entities, scripts, markers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One whitespace class for Spark, Python's ``regex`` and RE2: Java's and RE2's own classes differ from each other.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = "[^" + WS[1:]
#: The same for Python, which writes code points in another way.
PY_WS, PY_NOT_WS = (re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), c) for c in (WS, NOT_WS))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def split_lines(c: Column) -> Column:
    """Lines of a text; line ends of any kind, one trailing empty line dropped, none for an empty text."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)
    tail = (F.size(lines) > 1) & (F.element_at(lines, -1) == "")
    return F.when(c == "", F.array().cast("array<string>")).when(tail, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def is_blank(c: Column) -> Column:
    return c.rlike(f"^{WS}*$")


def normalise_line(c: Column, ignore_case: bool = False, ignore_whitespace: bool = False) -> Column:
    out = collapse(c) if ignore_whitespace else c
    return F.lower(out) if ignore_case else out


def split_words(c: Column) -> Column:
    """Words and the whitespace between them, in order; joined they are the text."""
    return F.regexp_extract_all(c, F.lit(f"({WS}+|{NOT_WS}+)"), F.lit(1))


def furniture_key(c: Column) -> Column:
    """What a running header keeps from page to page: digit runs become #."""
    return F.lower(F.regexp_replace(F.regexp_replace(trim(c), "[0-9]+", "#"), f"{WS}+", " "))


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


#: The named entities that are decoded, and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
}


def decode_entities(c: Column) -> Column:
    """Named (any case), decimal and hexadecimal entities in one pass; unknown ones stay as written."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&)"), F.lit(1))
    names = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (k, v)])

    def one(p: Column) -> Column:
        body = F.regexp_extract(p, "^&(.*);$", 1)
        code = F.when(body.rlike("^#[0-9]{1,7}$"), F.substring(body, 2, 7).cast("long")).when(body.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(body, 3, 6), 16, 10).cast("long"))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        named = F.element_at(names, F.lower(body))
        return F.when(valid, character(code)).otherwise(F.coalesce(named, p))

    return F.array_join(F.transform(pieces, one), "")


def tag_tokens(c: Column) -> Column:
    """Tags and the text between them, in order; a lone < vanishes."""
    return F.regexp_extract_all(c, F.lit("(<[^>]+>|[^<]+)"), F.lit(1))


#: Scripts and the code points that belong to them; everything else is latin.
SCRIPTS = {
    "devanagari": [(0x0900, 0x097F), (0xA8E0, 0xA8FF), (0x1CD0, 0x1CFF)], "bengali": [(0x0980, 0x09FF)], "gurmukhi": [(0x0A00, 0x0A7F)], "gujarati": [(0x0A80, 0x0AFF)], "oriya": [(0x0B00, 0x0B7F)],
    "tamil": [(0x0B80, 0x0BFF)], "telugu": [(0x0C00, 0x0C7F)], "kannada": [(0x0C80, 0x0CFF)], "malayalam": [(0x0D00, 0x0D7F)], "thai": [(0x0E00, 0x0E7F)],
    "hebrew": [(0x0590, 0x05FF)], "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
}


def script_of(code: Column) -> Column:
    """The script of a code point."""
    out = None
    for name, spans in SCRIPTS.items():
        hit = F.lit(False)
        for lo, hi in spans:
            hit = hit | code.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("latin")


def characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))


def scripts_in(c: Column) -> Column:
    """Distinct scripts other than latin, in order of first use."""
    return F.array_except(F.transform(characters(c), lambda x: script_of(F.ascii(x))), F.array(F.lit("latin")))


#: Characters beyond Latin-1 that the WinAnsi encoding has.
WIN_ANSI = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
SUPPORTED = rf"[\x{{0}}-\x{{FF}}{WIN_ANSI}]"


def unsupported_characters(c: Column) -> Column:
    """Distinct characters that WinAnsi lacks, in order of first use."""
    return F.array_distinct(characters(F.regexp_replace(c, SUPPORTED, "")))


def drawable(c: Column, missing: Column) -> Column:
    """``c`` with each of the ``missing`` characters as a question mark, which is what is measured and drawn."""
    shown = F.array_join(F.transform(characters(c), lambda x: F.when(F.array_contains(missing, x), F.lit("?")).otherwise(x)), "")
    return F.when(F.size(missing) > 0, shown).otherwise(c)


def unmapped_count(c: Column) -> Column:
    """Private-use, replacement and control characters, tabs and line feeds excepted."""
    return F.length(c) - F.length(F.regexp_replace(c, r"[\x{E000}-\x{F8FF}\x{FFFD}\x{F0000}-\x{FFFFD}\x{0}-\x{8}\x{B}-\x{1F}]", ""))


def visible_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[ \n]", ""))


#: What counts as a bullet and as a number.
BULLETS = "^[•▪◦·‣⁃∙●○−–-]$"
NUMBERED = r"^\(?(?:[0-9]{1,3}|[ivxlcdmIVXLCDM]{1,6}|[a-zA-Z])[.)]$"


def marker_of(c: Column) -> Column:
    """bullet, number or null for a list marker."""
    return F.when(trim(c).rlike(BULLETS), "bullet").when(trim(c).rlike(NUMBERED), "number")


def letters(n: Column) -> Column:
    """1 is a, 26 is z, 27 is aa; less than 1 counts as 1. Up to 12 letters."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)), F.struct(F.greatest(n.cast("long"), F.lit(1)).alias("n"), F.lit("").alias("s")),
        lambda a, _: F.when(a["n"] <= 0, a).otherwise(F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.char(F.pmod(a["n"] - 1, F.lit(26)) + 97), a["s"]).alias("s"))),
    )
    return steps["s"]


ROMAN = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def roman(n: Column) -> Column:
    left, out = F.greatest(n.cast("long"), F.lit(1)), F.lit("")
    for sign, value in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.greatest(F.lit(0), F.floor(left / value)).cast("int")))
        left = F.pmod(left, F.lit(value))
    return out


def ordered_marker(n: Column, depth: Column) -> Column:
    """1. a. i. by depth from 1, then again."""
    style = F.pmod(depth - 1, F.lit(3))
    return F.concat(F.when(style == 0, n.cast("string")).when(style == 1, letters(n)).otherwise(roman(n)), F.lit("."))


def bullet_marker(depth: Column) -> Column:
    return F.element_at(F.array(F.lit("•"), F.lit("o"), F.lit("-")), (F.pmod(depth - 1, F.lit(3)) + 1).cast("int"))


def escape_xml(c: Column) -> Column:
    """The five entities; what XML 1.0 forbids is dropped."""
    out = F.regexp_replace(c, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def font_style(font: Column) -> Column:
    """bold, italic and mono by a font's name, without subset prefix and digits at the end."""
    name = F.regexp_replace(F.regexp_replace(font, r"^[A-Z]{6}\+", ""), "-[0-9]+$", "")
    return F.struct(name.rlike("(?i)bold|black|heavy|semibold|demi").alias("bold"), name.rlike("(?i)italic|oblique").alias("italic"), name.rlike("(?i)mono|courier|consol|menlo").alias("mono"))
