"""Running headers and footers: lines that repeat at one height on most pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import furniture_key
from paperloom.plans.workspace import broadcast_if_small, save

#: Share of the page at either end, share of pages, points of movement and share of the widest line.
ZONE, PAGES, MOVE, WIDTH = 0.12, 0.6, 2.5, 0.7
#: Repeated keys (of a line's length each) that are broadcast at most.
BROADCAST_ROWS = 200_000


def furniture(lines: DataFrame, doc: str = "doc_id", share: float = PAGES) -> DataFrame:
    """Adds ``is_furniture`` to lines of (doc, page, text, x, y, right, height), y upwards.

    Keys are counted with partial aggregation; those that repeat enough are few and broadcast up to ``BROADCAST_ROWS``.
    """
    pages = lines.groupBy(doc).agg(F.count_distinct("page").alias("pages"))
    widest = lines.groupBy(doc, "page").agg(F.max(F.col("right") - F.col("x")).alias("widest"))
    zone = F.when(F.col("y") > F.col("height") * (1 - ZONE), "top").when(F.col("y") < F.col("height") * ZONE, "bottom")
    keyed = lines.join(widest, [doc, "page"]).withColumn("zone", F.when(F.col("right") - F.col("x") <= WIDTH * F.col("widest"), zone)).withColumn("key", furniture_key(F.col("text")))
    near = keyed.where("zone is not null and key <> ''")
    counted = near.groupBy(doc, "zone", "key").agg(F.count_distinct("page").alias("n"), (F.max("y") - F.min("y")).alias("moves"))
    repeated = counted.join(pages, doc).where((F.col("n") >= F.greatest(F.lit(2), F.ceil(share * F.col("pages")))) & (F.col("moves") <= MOVE)).select(doc, "zone", "key", F.lit(True).alias("is_furniture"))
    repeated = broadcast_if_small(save(repeated, "repeated"), BROADCAST_ROWS)
    return keyed.join(repeated, [doc, "zone", "key"], "left").withColumn("is_furniture", F.coalesce("is_furniture", F.lit(False))).select(*lines.columns, "is_furniture")


def page_quality(items: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per page: scanned (hardly any text, but pictures) and the share of characters without a mapping."""
    from paperloom.functions.text import trim, unmapped_count, visible_count

    sums = items.groupBy(doc, "page").agg(F.sum(F.length(trim(F.col("text")))).alias("chars"), F.sum(unmapped_count(F.col("text"))).alias("bad"), F.sum(visible_count(F.col("text"))).alias("seen"))
    joined = pages.join(sums, [doc, "page"], "left")
    return joined.select(doc, "page", ((F.coalesce("chars", F.lit(0)) < 12) & (F.col("image_count") > 0)).alias("scanned"), F.coalesce(F.col("bad") / F.nullif("seen", F.lit(0)), F.lit(0.0)).alias("unmapped"))


def multi_column(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per page of (x, right, gaps: array<struct<start,end>>, width): whether two columns of text stand side by side.

    Either at least 12 lines with 4 on each side of the middle and under a quarter across it, or at least 4 lines and half of
    all with a gap over the middle; pages of under 6 lines never.
    """
    middle = F.col("width") / 2
    over = F.exists("gaps", lambda g: (g["start"] < middle) & (g["end"] > middle))
    n, left, right = F.count("*"), F.count_if(F.col("right") < middle), F.count_if((F.col("x") > middle) & (F.col("right") >= middle))
    across, gapped = n - left - right, F.count_if(over)
    two = (n >= 12) & (left >= 4) & (right >= 4) & (across < 0.25 * n)
    return lines.groupBy(doc, "page").agg(((n >= 6) & (two | ((gapped >= 4) & (gapped >= 0.5 * n)))).alias("multi_column"))
