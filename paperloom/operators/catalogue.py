"""A catalogue of tools as a dimension table, and the sitemap over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "slug string, category string, status string"


def available(tools: DataFrame) -> DataFrame:
    return tools.where("status = 'available'")


def sitemap_paths(tools: DataFrame, pages: list[str]) -> DataFrame:
    """(path, priority) of static pages and available tools; the first page ranks highest."""
    spark = tools.sparkSession
    fixed = spark.createDataFrame([(p, "1.0" if p == "/" else "0.9") for p in pages], "path string, priority string")
    return fixed.unionByName(available(tools).select(F.concat(F.lit("/tools/"), "slug").alias("path"), F.lit("0.8").alias("priority")))


#: Addresses that one sitemap may hold: fixed by the format.
MOST = 50_000
OPENING = '<?xml version="1.0" encoding="UTF-8"?>\n'
SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def sitemap_xml(paths: DataFrame, base: str, modified: str, most: int = MOST) -> DataFrame:
    """(number, xml): sitemaps of at most ``most`` addresses, by priority and path; one of none at least.

    Addresses are put in order by ranges and cut within them, so a task gathers one sitemap at a time.
    """
    ranges = max(1, -(-paths.count() // most))
    ranked = paths.withColumn("r", -F.col("priority").cast("double")).repartitionByRange(ranges, "r", "path").withColumn("part", F.spark_partition_id())
    placed = ranked.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("part").orderBy("r", "path")) - 1) / most))
    entry = F.format_string("  <url>\n    <loc>%s%s</loc>\n    <lastmod>%s</lastmod>\n    <changefreq>weekly</changefreq>\n    <priority>%s</priority>\n  </url>", F.lit(base), "path", F.lit(modified), "priority")
    grouped = placed.groupBy("part", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "path", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    numbered = grouped.withColumn("number", (F.row_number().over(W.orderBy("part", "chunk")) - 1).cast("int"))
    none = paths.sparkSession.createDataFrame([(0, "")], "number int, body string")
    return (numbered.select("number", "body") if paths.limit(1).count() else none).select("number", F.concat(F.lit(f"{OPENING}<urlset {SPACE}>\n"), "body", F.lit("\n</urlset>\n")).alias("xml"))


def sitemap_index(sitemaps: DataFrame, base: str, modified: str) -> DataFrame:
    """One row with the index of sitemaps, which lie at /sitemap-0.xml and so on."""
    entry = F.format_string("  <sitemap>\n    <loc>%s/sitemap-%s.xml</loc>\n    <lastmod>%s</lastmod>\n  </sitemap>", F.lit(base), F.col("number").cast("string"), F.lit(modified))
    body = sitemaps.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    return body.select(F.concat(F.lit(f"{OPENING}<sitemapindex {SPACE}>\n"), "body", F.lit("\n</sitemapindex>\n")).alias("xml"))
