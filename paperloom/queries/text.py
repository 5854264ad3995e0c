"""Lines, words, entities, scripts and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.registry import query, sql_values, table, values

WS = T.WS
LINES = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"
LINED = f"""SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT doc_id, CASE WHEN text = '' THEN [] WHEN len(l) > 1 AND l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, text, {LINES} AS l FROM documents))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line). The filter on nulls is our own, so that none is inferred below the split, which would run twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.split_lines(F.col("text")).alias("lines"))
    return docs.select("doc_id", F.posexplode("lines").alias("pos", "line"))


@query(f"SELECT doc_id, pos::INT AS pos, line FROM ({LINED})")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


@query(f"SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(length(line))::BIGINT AS longest FROM ({LINED}) GROUP BY doc_id")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight from the array: no row of a document meets another, so nothing is shuffled."""
    sized = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.split_lines(F.col("text")), F.length).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return sized.where(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("n_lines"), total.alias("n_chars"), F.array_max("n").cast("long").alias("longest"))


@query(f"SELECT doc_id, pos::INT AS pos FROM ({LINED}) WHERE NOT regexp_full_match(line, '{WS}*')")
def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions are those of the whole text."""
    return lines(spark, sf_dir).where(~T.is_blank(F.col("line"))).select("doc_id", "pos")


@query(f"""SELECT doc_id, pos::INT AS pos, lower(line) AS lowered, trim(regexp_replace(line, '{WS}+', ' ', 'g'), ' ') AS collapsed,
  lower(trim(regexp_replace(line, '{WS}+', ' ', 'g'), ' ')) AS both_ways FROM ({LINED})""")
def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    found = lines(spark, sf_dir)
    return found.select("doc_id", "pos", T.normalise_line(line, True).alias("lowered"), T.normalise_line(line, False, True).alias("collapsed"), T.normalise_line(line, True, True).alias("both_ways"))


@query(f"SELECT item_id, len(w)::INT AS n_tokens, len(list_filter(w, lambda x: NOT regexp_full_match(x, '{WS}+')))::INT AS n_words, array_to_string(w, '') = text AS whole FROM (SELECT item_id, text, regexp_extract_all(text, '{WS}+|{T.NOT_WS}+') AS w FROM benchmark)")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", "text", T.split_words(F.col("text")).alias("w"))
    return found.select("item_id", F.size("w").alias("n_tokens"), F.size(F.filter("w", lambda x: ~x.rlike(f"^{WS}+$"))).alias("n_words"), (F.array_join("w", "") == F.col("text")).alias("whole"))


@query("""SELECT page_id, len(t)::INT AS n_tokens, len(list_filter(t, lambda x: x[1] = '<'))::INT AS n_tags, len(list_filter(t, lambda x: starts_with(x, '<a ')))::INT AS n_links
FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>|[^<]+') AS t FROM pages)""")
def html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", T.tag_tokens(F.col("html")).alias("t"))
    count = lambda start: F.size(F.filter("t", lambda x: x.startswith(start)))
    return found.select("page_id", F.size("t").alias("n_tokens"), count("<").alias("n_tags"), count("<a ").alias("n_links"))


@query("""SELECT page_id, generate_subscripts(l, 1)::INT - 1 AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


NAMED = list(T.ENTITIES.items())
_chain = "html"
for _name, _sign in [x for x in NAMED if x[0] != "amp"] + [("amp", "&")]:
    _chain = f"regexp_replace({_chain}, '&{_name};', '{_sign.replace(chr(39), chr(39) * 2)}', 'gi')"


@query(f"SELECT page_id, {_chain} AS decoded FROM pages")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(F.col("html")).alias("decoded"))


ENTITY_CASES = [
    ("&amp;lt;", "&lt;"), ("&#65;&#x42;&#X43;", "ABC"), ("&nbsp;|&NBSP;", " | "), ("&copy; &unknown; & &;", "&copy; &unknown; & &;"), ("&#128512;", "😀"), ("&#0;", "&#0;"),
    ("a &lt;b&gt; &quot;c&quot; &apos;d&apos;", "a <b> \"c\" 'd'"), ("", ""),
]


@query(f"SELECT source, expected AS decoded FROM {sql_values(ENTITY_CASES, 'source, expected')}")
def entity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, ENTITY_CASES, "source string, expected string").select("source", T.decode_entities(F.col("source")).alias("decoded"))


SCRIPT_CASES = [
    ("plain text", "", ""), ("नमस्ते world", "devanagari", "नमस्ते"), ("שלום عليكم", "hebrew,arabic", "שלוםعليكم"), ("ไทย และ हिन्दी", "thai,devanagari", "ไทยและहिन्दी"), ("“quoted” – €5 ™", "", ""), ("日本", "", "日本"),
]


@query(f"SELECT source, scripts, unsupported FROM {sql_values(SCRIPT_CASES, 'source, scripts, unsupported')}")
def script_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values(spark, SCRIPT_CASES, "source string, s string, u string")
    return found.select("source", F.array_join(T.scripts_in(F.col("source")), ",").alias("scripts"), F.array_join(T.unsupported_characters(F.col("source")), "").alias("unsupported"))


@query("SELECT doc_id, '' AS scripts, 0 AS n_unsupported FROM documents")
def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' texts are Latin throughout."""
    found = table(spark, sf_dir, "documents")
    return found.select("doc_id", F.array_join(T.scripts_in(F.col("text")), ",").alias("scripts"), F.size(T.unsupported_characters(F.col("text"))).alias("n_unsupported"))


@query("SELECT source, round(sum(length(text) - length(regexp_replace(text, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]', '', 'g'))) / nullif(sum(length(regexp_replace(text, '[ \\n]', '', 'g'))), 0), 9) AS ratio FROM documents GROUP BY source")
def unmapped_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.unmapped_count(F.col("text"))).alias("bad"), F.sum(T.visible_count(F.col("text"))).alias("total"))
    return sums.select("source", F.round(F.col("bad") / F.nullif("total", F.lit(0)), 9).alias("ratio"))


MARKER_CASES = [("•", "bullet"), (" - ", "bullet"), ("–", "bullet"), ("1.", "number"), ("(12)", "number"), ("iv)", "number"), ("a.", "number"), ("ab.", None), ("1234.", None), ("text", None), ("", None)]


@query(f"SELECT source, expected AS marker FROM {sql_values(MARKER_CASES, 'source, expected')}")
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, MARKER_CASES, "source string, expected string").select("source", T.marker_of(F.col("source")).alias("marker"))


ORDER_CASES = [(1, 1, "1."), (3, 2, "c."), (27, 2, "aa."), (703, 2, "aaa."), (4, 3, "iv."), (1994, 3, "mcmxciv."), (12, 4, "12."), (28, 5, "ab."), (0, 3, "i.")]


@query(f"SELECT n, depth, expected AS marker FROM {sql_values(ORDER_CASES, 'n, depth, expected')}")
def ordered_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, ORDER_CASES, "n int, depth int, expected string").select("n", "depth", T.ordered_marker(F.col("n"), F.col("depth")).alias("marker"))


FONT_CASES = [("ABCDEF+Calibri-Bold", True, False, False), ("Times-BoldItalic", True, True, False), ("CourierNew", False, False, True), ("Arial", False, False, False), ("Helvetica-Oblique-12", False, True, False), ("Inter-SemiBold", True, False, False)]


@query(f"SELECT font, bold, italic, mono FROM {sql_values(FONT_CASES, 'font, bold, italic, mono')}")
def font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, FONT_CASES, "font string, b boolean, i boolean, m boolean").select("font", T.font_style(F.col("font")).alias("s")).select("font", "s.*")


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def escaped_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_xml(F.col("text")).alias("escaped"))
