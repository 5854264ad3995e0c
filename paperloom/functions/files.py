"""Column functions over file names, sizes, page ranges and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import trim

#: Limits in bytes and pixels.
IMAGE_LIMIT, PDF_LIMIT, BATCH_LIMIT, CANVAS_PIXELS = 40 << 20, 80 << 20, 200 << 20, 40_000_000
#: MIME type: (label, extension, lossy).
ENCODE_TYPES = {"image/png": ("PNG", "png", False), "image/jpeg": ("JPEG", "jpg", True), "image/webp": ("WebP", "webp", True)}


def is_encode_type(mime: Column) -> Column:
    """Whether pictures can be written as this type."""
    return F.coalesce(mime.isin(*ENCODE_TYPES), F.lit(False))


def encode_types(spark: SparkSession) -> DataFrame:
    """(mime, label, extension, lossy)."""
    return spark.createDataFrame([(m, *row) for m, row in ENCODE_TYPES.items()], "mime string, label string, extension string, lossy boolean")


def round_half_up(c: Column) -> Column:
    """Ties go towards positive infinity, unlike ``round``."""
    return F.floor(c + 0.5)


def format_bytes(c: Column) -> Column:
    """922 B, 9.4 MB, 94 MB; kB are 1024 bytes and GB is the largest unit."""
    n = c.cast("double")
    unit = F.when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), unit)
    tenths = F.floor(value * 10 + 0.5) / 10
    shown = F.when(value < 10, F.format_string("%.1f", tenths.cast("double"))).otherwise(round_half_up(value).cast("string"))
    valid = n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n < float("inf"))
    return F.when(~valid, "—").when(n < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(F.lit("kB"), F.lit("MB"), F.lit("GB")), unit)))


def format_limit(c: Column) -> Column:
    return F.concat(round_half_up(c / (1 << 20)).cast("string"), F.lit(" MB"))


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before <= 0, F.lit(0)).otherwise(round_half_up((before - after) / before * 100)).cast("long")


def canvas_pixels(width: Column, height: Column, scale: Column) -> Column:
    return (F.ceil(width * scale) * F.ceil(height * scale)).cast("long")


def exceeds_canvas(pixels: Column, budget: int = CANVAS_PIXELS) -> Column:
    return pixels > budget


def largest_safe_scale(width: Column, height: Column, budget: int = CANVAS_PIXELS) -> Column:
    exact = F.sqrt(F.lit(float(budget)) / (width * height))
    return F.when((width <= 0) | (height <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.floor(exact * 10) / 10))


def fit_within(width: Column, height: Column, most: Column) -> Column:
    """(width, height) of a picture made no larger than ``most`` on its longer side; never enlarged."""
    scale = F.least(most / width, most / height)
    fits = most.isNull() | (most <= 0) | ((width <= most) & (height <= most))
    side = lambda x: F.when(fits, x.cast("long")).otherwise(F.greatest(F.lit(1), round_half_up(x * scale))).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def sanitize_filename(c: Column, fallback: str = "file") -> Column:
    """Without folders, reserved and control characters and leading dots."""
    base = F.regexp_extract(c, r"(?s)([^\\/]*)$", 1)
    clean = trim(F.regexp_replace(F.regexp_replace(base, r"[<>:\"|?*\x{0}-\x{1F}]", ""), r"^\.+", ""))
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def stem_of(c: Column) -> Column:
    return F.regexp_replace(sanitize_filename(c), r"(?s)^(.+)\.[^.]*$", "$1")


def with_extension(c: Column, extension: Column) -> Column:
    return F.concat(stem_of(c), F.lit("."), F.regexp_replace(extension, r"^\.", ""))


def page_label(index: Column, total: Column) -> Column:
    width = F.greatest(F.length(total.cast("string")), F.length(index.cast("string")))
    return F.lpad(index.cast("string"), width, F.lit("0"))


def unique_names(names: Column) -> Column:
    """Names in order, each that is taken already with " (2)", " (3)" … before its extension."""

    def add(taken: Column, name: Column) -> Column:
        stem, ext = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"), F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
        tries = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))
        free = F.when(F.array_contains(taken, name), F.element_at(F.array_except(tries, taken), 1)).otherwise(name)
        return F.array_append(taken, free)

    return F.aggregate(names, F.array().cast("array<string>"), add)


def parse_page_range(expression: Column, total: Column) -> Column:
    """Pages of "1-5, 8, 11-", ascending and distinct. Blank: all. Single pages are decimal integers; other forms are skipped."""
    last = total.cast("int")
    whole = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    span = r"^([0-9]*)\s*[-–]\s*([0-9]*)$"

    def pages(part: Column) -> Column:
        chunk = trim(part)
        a, b = F.regexp_extract(chunk, span, 1), F.regexp_extract(chunk, span, 2)
        lo = F.when(a == "", F.lit(1)).otherwise(F.least(a.try_cast("long"), F.lit(2**31 - 1)))
        hi = F.when(b == "", last).otherwise(F.least(b.try_cast("long"), F.lit(2**31 - 1)))
        first, end = F.greatest(F.lit(1), F.least(lo, hi)).cast("int"), F.least(last, F.greatest(lo, hi)).cast("int")
        one = F.when(chunk.rlike("^[0-9]{1,9}$"), chunk.try_cast("int"))
        return F.when(chunk.rlike(span) & (first <= end), F.sequence(first, end)).when((one >= 1) & (one <= last), F.array(one)).otherwise(F.array().cast("array<int>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(expression, ","), pages))))
    return F.when(last <= 0, F.array().cast("array<int>")).when(trim(expression) == "", whole).otherwise(chosen)


def detect_container(content: Column) -> Column:
    """jpeg, png, gif, webp, heic, avif, tiff or null by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    boxed = (F.substring(head, 9, 8) == "66747970") & (F.length(content) > 12)
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & head.endswith("57454250") & (F.length(content) >= 12), "webp")
        .when(head.startswith("47494638"), "gif").when(boxed & brand.isin("avif", "avis"), "avif").when(boxed & brand.isin("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1"), "heic")
        .when((F.length(content) > 4) & (head.startswith("49492A00") | head.startswith("4D4D002A")), "tiff")
    )


def looks_like_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 5)).eqNullSafe(F.lit("255044462D")) & (F.length(content) > 5)


def looks_like_docx(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)).eqNullSafe(F.lit("504B0304")) & (F.length(content) > 4)


def accepts(name: Column, mime: Column, extensions: list[str], mimes: list[str]) -> Column:
    """Whether a file passes a filter by extension or MIME prefix; without a filter all do."""
    if not extensions and not mimes:
        return F.lit(True)
    hits = [F.endswith(F.lower(name), F.lit(e)) for e in extensions] + [F.startswith(F.coalesce(mime, F.lit("")), F.lit(m)) for m in mimes]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out
