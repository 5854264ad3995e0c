"""Column functions over image metadata values, office units and picture decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.files import round_half_up

SMALL_IMAGE = 4096


def ratio(pair: Column) -> Column:
    """n / d of a rational; 0 where d is 0."""
    return F.when(pair["d"] == 0, 0.0).otherwise(pair["n"] / pair["d"])


def dms_to_degrees(parts: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds as rationals; south and west are negative."""
    at = lambda i: F.coalesce(ratio(F.get(parts, F.lit(i))), F.lit(0.0))
    sign = F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (at(0) + at(1) / 60 + at(2) / 3600)


def emu(points: Column) -> Column:
    return round_half_up(points * 12700).cast("long")


def half_points(points: Column) -> Column:
    return F.greatest(F.lit(2), round_half_up(points * 2)).cast("long")


def twips_to_points(twips: Column) -> Column:
    return twips / 20


def classify_image(filters: Column, color_space: Column, has_mask: Column, size: Column, least: int = SMALL_IMAGE) -> Column:
    """What keeps a picture from being recompressed, or "recompress"."""
    return (
        F.when(has_mask, "transparency").when(~F.coalesce(F.array_contains(filters, "/DCTDecode"), F.lit(False)), "not a JPEG").when(size < least, "already small")
        .when(F.coalesce(color_space, F.lit("")).isin("/DeviceRGB", "/DeviceGray"), "recompress").otherwise("unsupported colour")
    )


#: Page sizes in points, short side first.
PAGES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0)}


def place_on_page(width: Column, height: Column, preset: str = "a4", orientation: str = "auto", margin: float = 0.0) -> Column:
    """Sheet and place of a picture: as large as fits within the margins, in the middle. Preset fit: the sheet is the picture."""
    names = ("sheet_width", "sheet_height", "x", "y", "width", "height")
    if preset == "fit":
        return F.struct(*[c.cast("double").alias(n) for n, c in zip(names, (width, height, F.lit(0.0), F.lit(0.0), width, height), strict=True)])
    short, long = PAGES.get(preset, PAGES["a4"])
    wide = (width > height) if orientation == "auto" else F.lit(orientation == "landscape")
    sheet_w, sheet_h = F.when(wide, long).otherwise(short), F.when(wide, short).otherwise(long)
    box = lambda side: F.greatest(F.lit(1.0), side - 2 * margin)
    scale = F.least(box(sheet_w) / width, box(sheet_h) / height)
    w, h = width * scale, height * scale
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(names, (sheet_w, sheet_h, (sheet_w - w) / 2, (sheet_h - h) / 2, w, h), strict=True)])


def render_plan(width: Column, height: Column, scale: float) -> Column:
    """Pixels of a page at a scale, whether it is left out as too large, and the largest scale that isn't."""
    from paperloom.functions.files import canvas_pixels, exceeds_canvas, largest_safe_scale

    pixels = canvas_pixels(width, height, F.lit(float(scale)))
    return F.struct(pixels.alias("pixels"), exceeds_canvas(pixels).alias("skipped"), largest_safe_scale(width, height).cast("double").alias("safe_scale"))


def hex_to_unit(c: Column) -> Column:
    """Red, green and blue in 0 to 1 of six hexadecimal digits; null for anything else, auto included."""
    part = lambda at: (F.conv(F.substring(c, at, 2), 16, 10).cast("double") / 255)
    return F.when(c.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
