"""Colours: parsing, conversion to RGB, WCAG contrast."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.files import round_half_up
from paperloom.functions.text import WS, trim

#: Colour names.
NAMED = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "lime": "#00ff00", "blue": "#0000ff", "yellow": "#ffff00", "cyan": "#00ffff", "magenta": "#ff00ff", "silver": "#c0c0c0",
    "gray": "#808080", "maroon": "#800000", "olive": "#808000", "green": "#008000", "purple": "#800080", "teal": "#008080", "navy": "#000080", "orange": "#ffa500", "gold": "#ffd700",
    "pink": "#ffc0cb", "hotpink": "#ff69b4", "crimson": "#dc143c", "salmon": "#fa8072", "tomato": "#ff6347", "coral": "#ff7f50", "orangered": "#ff4500", "firebrick": "#b22222",
    "darkred": "#8b0000", "indianred": "#cd5c5c", "brown": "#a52a2a", "sienna": "#a0522d", "chocolate": "#d2691e", "peru": "#cd853f", "tan": "#d2b48c", "wheat": "#f5deb3",
    "beige": "#f5f5dc", "khaki": "#f0e68c", "ivory": "#fffff0", "linen": "#faf0e6", "snow": "#fffafa", "seashell": "#fff5ee", "lavender": "#e6e6fa", "plum": "#dda0dd",
    "violet": "#ee82ee", "orchid": "#da70d6", "fuchsia": "#ff00ff", "indigo": "#4b0082", "darkviolet": "#9400d3", "blueviolet": "#8a2be2", "slateblue": "#6a5acd",
    "royalblue": "#4169e1", "dodgerblue": "#1e90ff", "deepskyblue": "#00bfff", "skyblue": "#87ceeb", "lightblue": "#add8e6", "steelblue": "#4682b4", "cadetblue": "#5f9ea0",
    "turquoise": "#40e0d0", "aquamarine": "#7fffd4", "mediumseagreen": "#3cb371", "seagreen": "#2e8b57", "forestgreen": "#228b22", "darkgreen": "#006400", "olivedrab": "#6b8e23",
    "yellowgreen": "#9acd32", "chartreuse": "#7fff00", "springgreen": "#00ff7f", "mintcream": "#f5fffa", "honeydew": "#f0fff0", "midnightblue": "#191970", "darkslategray": "#2f4f4f",
    "dimgray": "#696969", "slategray": "#708090", "lightgray": "#d3d3d3", "gainsboro": "#dcdcdc", "whitesmoke": "#f5f5f5", "aliceblue": "#f0f8ff", "ghostwhite": "#f8f8ff",
}


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def hex_to_rgb(c: Column) -> Column:
    """#abc, #abcd, #aabbcc or #aabbccdd; the hash may be missing and alpha is dropped."""
    s = F.regexp_replace(trim(c), "^#", "")
    s = F.when(F.length(s).isin(3, 4), F.regexp_replace(F.substring(s, 1, 3), "(.)", "$1$1")).when(F.length(s) == 8, F.substring(s, 1, 6)).otherwise(s)
    part = lambda at: F.conv(F.substring(s, at, 2), 16, 10)
    return F.when(s.rlike("^[0-9a-fA-F]{6}$"), rgb(part(1), part(3), part(5)))


def rgb_to_hex(c: Column) -> Column:
    two = lambda x: F.lower(F.lpad(F.hex(clamp(round_half_up(x), 0, 255).cast("long")), 2, "0"))
    return F.when(c.isNotNull(), F.concat(F.lit("#"), two(c["r"]), two(c["g"]), two(c["b"])))


def _wheel(hue: Column, c: Column, m: Column) -> Column:
    """RGB of a hue in degrees at chroma ``c`` above the grey ``m``."""
    turn = F.pmod(F.pmod(hue, F.lit(360.0)) + 360, F.lit(360.0)) / 60
    x = c * (1 - F.abs(F.pmod(turn, F.lit(2.0)) - 1))
    sector, zero = F.floor(turn), F.lit(0.0)
    pick = lambda *six: F.element_at(F.array(*six), (F.pmod(sector, F.lit(6)) + 1).cast("int"))
    full = lambda v: round_half_up((v + m) * 255)
    return rgb(full(pick(c, x, zero, zero, x, c)), full(pick(x, c, c, x, zero, zero)), full(pick(zero, zero, x, c, c, x)))


def hsl_to_rgb(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    light = clamp(l, 0, 100) / 100
    c = (1 - F.abs(2 * light - 1)) * clamp(s, 0, 100) / 100
    return _wheel(h, c, light - c / 2)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    c = clamp(v, 0, 100) / 100 * (clamp(s, 0, 100) / 100)
    return _wheel(h, c, clamp(v, 0, 100) / 100 - c)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    ink = lambda x: round_half_up(255 * (1 - clamp(x, 0, 100) / 100) * (1 - clamp(k, 0, 100) / 100))
    return rgb(ink(c), ink(m), ink(y))


def oklch_to_rgb(l: Column, c: Column, h: Column) -> Column:  # noqa: E741
    """By the published OKLab matrices."""
    a, b = F.cos(F.radians(h)) * c, F.sin(F.radians(h)) * c
    cube = lambda x, y: F.pow(l + x * a + y * b, F.lit(3.0))
    L, M, S = cube(0.3963377774, 0.2158037573), cube(-0.1055613458, -0.0638541728), cube(-0.0894841775, -1.291485548)
    gamma = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    mix = lambda x, y, z: round_half_up(clamp(gamma(x * L + y * M + z * S), 0, 1) * 255)
    return rgb(mix(4.0767416621, -3.3077115913, 0.2309699292), mix(-1.2684380046, 2.6097574011, -0.3413193965), mix(-0.0041960863, -0.7034186147, 1.707614701))


def parse_colour(c: Column) -> Column:
    """RGB of a name, hex code or rgb(), hsl(), hsv(), hsb(), cmyk() or oklch(); null if it is none.

    Percent signs are dropped without scaling, missing numbers are 0 and each number may have a tail, as in "12px".
    """
    s = F.lower(trim(c))
    named = F.element_at(F.create_map(*[F.lit(x) for x in chain(*NAMED.items())]), s)
    plain = s.rlike("^#[0-9a-f]{3,8}$") | s.rlike("^[0-9a-f]{6}$")
    form = rf"^([a-z]+){WS}*\(([^)]*)\)$"
    name = F.regexp_extract(s, form, 1)
    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract(s, form, 2), "/", " "), f"(?:{WS}|,)+"), lambda x: x != "")
    numbers = F.transform(parts, lambda p: F.regexp_extract(F.regexp_replace(p, "^([^%]*)%", "$1"), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?", 0).try_cast("double"))
    at = lambda i: F.coalesce(F.get(numbers, F.lit(i)), F.lit(0.0))
    p, q, r, t = at(0), at(1), at(2), at(3)
    by_form = (
        F.when(F.exists(numbers, lambda x: x.isNull()), F.lit(None)).when(name.isin("rgb", "rgba"), rgb(clamp(p, 0, 255), clamp(q, 0, 255), clamp(r, 0, 255)))
        .when(name.isin("hsl", "hsla"), hsl_to_rgb(p, q, r)).when(name.isin("hsv", "hsb"), hsv_to_rgb(p, q, r))
        .when(name == "cmyk", cmyk_to_rgb(p, q, r, t)).when(name == "oklch", oklch_to_rgb(F.when(p > 1, p / 100).otherwise(p), q, r))
    )
    return F.when(s == "", F.lit(None)).when(named.isNotNull(), hex_to_rgb(named)).otherwise(F.coalesce(F.when(plain, hex_to_rgb(s)), F.when(s.rlike(form), by_form)))


def luminance(c: Column) -> Column:
    """WCAG 2.1 relative luminance."""
    linear = lambda x: F.when(x / 255 <= 0.03928, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(c["r"]) + 0.7152 * linear(c["g"]) + 0.0722 * linear(c["b"])


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def scan_warning(dark: Column, light: Column) -> Column:
    """Why a code in these colours may not scan: inverted, low contrast, or null."""
    total = lambda c: c["r"] + c["g"] + c["b"]
    return F.when(total(dark) > total(light), "inverted").when(contrast(dark, light) < 3, "low contrast")
