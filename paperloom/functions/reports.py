"""One-sentence reports over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.files import format_bytes, savings_percent


def listed(parts: Column) -> Column:
    """a, b and c."""
    several = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(parts, -1))
    return F.when(F.size(parts) > 1, several).otherwise(F.get(parts, F.lit(0)))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """3 pages; null for none."""
    return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}")))


def describe_rejections(rejected: DataFrame, batch: str, name: str = "name", reason: str = "reason") -> DataFrame:
    """(batch, said): the file and why, or how many and why if there is one reason."""
    sums = rejected.groupBy(batch).agg(F.count("*").alias("n"), F.min(name).alias("name"), F.min(reason).alias("why"), (F.min(reason) == F.max(reason)).alias("one_reason"))
    single = F.concat("name", F.lit(" was skipped — "), "why", F.lit("."))
    many = F.concat(F.col("n").cast("string"), F.lit(" files were skipped"), F.when(F.col("one_reason"), F.concat(F.lit(" — "), "why")).otherwise(""), F.lit("."))
    return sums.select(batch, F.when(F.col("n") == 1, single).otherwise(many).alias("said"))


def describe_compression(before: Column, after: Column, touched: Column, skipped: Column, text_preserved: Column) -> Column:
    """``skipped`` is a map from reason to count."""
    percent = savings_percent(before, after)
    size = F.when(percent > 0, F.concat(percent.cast("string"), F.lit("% smaller"))).when(percent == 0, "the same size").otherwise(F.concat((-percent).cast("string"), F.lit("% larger")))
    reasons = F.transform(F.filter(F.array_sort(F.map_entries(skipped)), lambda e: e["value"] > 0), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"]))
    plural = lambda word: F.when(touched == 1, word).otherwise(word + "s")
    flat = F.concat(F.lit("Flattened "), touched.cast("string"), F.lit(" "), plural("page"), F.lit(" to images — "), size, F.lit(". Text is no longer selectable."))
    left = F.when(F.size(reasons) > 0, F.concat(F.lit(" Left alone: "), F.array_join(reasons, ", "), F.lit("."))).otherwise("")
    kept = F.concat(F.lit("Recompressed "), touched.cast("string"), F.lit(" "), plural("image"), F.lit(" — "), size, F.lit(". Text and vectors are untouched."), left)
    return F.when(text_preserved, kept).otherwise(flat)


def is_no_op(text_preserved: Column, touched: Column) -> Column:
    return text_preserved & (touched == 0)


def describe_estimate(before: Column, after: Column, touched: Column, sampled: Column) -> Column:
    percent, about = savings_percent(before, after), F.when(sampled, "≈ ").otherwise("")
    return (
        F.when(touched == 0, "Nothing here can be recompressed at this setting.")
        .when(percent <= 0, F.concat(about, format_bytes(after), F.lit(" — no smaller than the original.")))
        .otherwise(F.concat(about, format_bytes(after), F.lit(" · about "), percent.cast("string"), F.lit("% smaller")))
    )


def estimate_flatten(first_page: Column, pages: Column, original: Column) -> Column:
    """Bytes of a document whose pages become pictures: the first page's picture and 1536 bytes, times pages."""
    return F.when(pages == 0, original).otherwise(F.greatest(F.lit(1024), (first_page + 1536) * pages)).cast("long")


def describe_recovery(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, said) from (doc, paragraph, list, heading, table, pages)."""
    parts = F.array_compact(F.array(counted(F.col("paragraph"), "paragraph"), counted(F.col("list"), "list item"), counted(F.col("heading"), "heading"), counted(F.col("table"), "table")))
    said = F.concat(F.lit("Recovered "), F.coalesce(listed(parts), F.lit("no content")), F.lit(" from "), counted(F.col("pages"), "page"), F.lit("."))
    return counts.select(doc, F.when(F.size(parts) == 0, "No text could be extracted from this document.").otherwise(said).alias("said"))


def describe_furniture(lines: Column) -> Column:
    said = F.concat(F.lit("Left out "), counted(lines, "repeated header or footer line"), F.lit(", which would otherwise appear between the paragraphs on every page."))
    return F.when(lines > 0, said).otherwise("")


#: Fixed: what a conversion to pages doesn't carry over.
LAYOUT_CAVEATS = (
    "A nested table gets no cell formatting at all",
    "A page break in the middle of a paragraph is not reproduced; one before a paragraph, or on its own, is",
    "A text box keeps its content but is placed in the reading flow, not at its position on the page",
    "Shapes and their fills are not drawn",
    "Columns are equal width and are not balanced on the last page; a document that changes column count part-way uses its first section throughout",
    "Bold and italic in Indic, Arabic, Hebrew and Thai are synthesised rather than drawn from a designed face",
)


def describe_printing(pages: Column, blocks: Column, scripts: Column, missing_scripts: Column, right_to_left: Column, unsupported: Column, metric_fonts: Column, styled: Column, width: Column, height: Column, links: Column, dropped: Column) -> Column:
    """What a document's conversion to pages kept. ``scripts`` and ``missing_scripts`` are arrays of scripts' names,
    ``unsupported`` of characters; width and height are null where the document doesn't say."""
    number = lambda n: n.cast("string")
    few = F.array_join(F.slice(unsupported, 1, 6), " ")
    why = F.when(metric_fonts, "no embedded font covers them").otherwise("the font files could not be loaded, so the built-in fonts were used and those cover Latin only")
    parts = [
        F.concat(number(pages), F.when(pages == 1, " page").otherwise(" pages"), F.lit(" from "), number(blocks), F.lit(" blocks.")), F.lit("Text is selectable and searchable."),
        F.when(F.size(scripts) > 0, F.concat(F.array_join(scripts, ", "), F.lit(" rendered with an embedded font for that script."))),
        F.when(right_to_left, "Right-to-left text is shaped and reordered for display."),
        F.when(F.size(missing_scripts) > 0, F.concat(F.lit("Could not load a font for "), F.array_join(missing_scripts, ", "), F.lit(', so that text became "?".'))),
        F.concat(counted(F.size(unsupported), "character"), F.lit(" could not be drawn ("), few, F.lit(') and became "?" — '), why, F.lit(".")),
        F.when(~metric_fonts, "Line breaks may differ from Word: the metric-compatible fonts did not load."),
        F.concat(F.lit("Alignment, sizes, indents and tab stops recovered for "), counted(styled, "paragraph"), F.lit(".")),
        F.concat(F.lit("Page size taken from the document ("), number(F.floor(width + 0.5)), F.lit("x"), number(F.floor(height + 0.5)), F.lit(" pt).")),
        F.concat(counted(links, "link"), F.lit(" stayed clickable.")), F.concat(counted(dropped, "image"), F.lit(" in an unsupported format were left out.")),
    ]
    return F.array_join(F.array(*parts), " ")  # leaves out nulls
