"""Overlap, modes, medians, baselines, screening, estimates, furniture and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.media import classify_image
from paperloom.operators import catalogue, furniture, overlap
from paperloom.plans.workspace import parts_of
from paperloom.queries.text import LINED, lines
from paperloom.registry import query, sql_values, table, values


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, left, right): each document and the next by id. Both sides are dealt out by id, which the join then keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = parts_of(spark)
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("right")).repartition(parts, "doc_id")
    return docs.repartition(parts, "doc_id").hint("merge").join(after, "doc_id").select("doc_id", F.col("text").alias("left"), "right")


@query(f"""WITH l AS ({LINED}), c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL), pairs AS (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
t AS (SELECT p.doc_id, line, n AS l, 0 AS r FROM pairs p JOIN c ON c.doc_id = p.doc_id UNION ALL SELECT p.doc_id, line, 0, n FROM pairs p JOIN c ON c.doc_id = p.doc_id + 1),
s AS (SELECT doc_id, line, sum(l)::BIGINT AS l, sum(r)::BIGINT AS r FROM t GROUP BY ALL)
SELECT doc_id, sum(least(l, r))::BIGINT AS shared, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right, round(sum(least(l, r)) / greatest(sum(l), sum(r)), 9) AS overlap FROM s GROUP BY doc_id""")
def line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select("doc_id")
    pairs = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id")
    left = found.join(pairs, "doc_id", "left_semi").select("doc_id", "line")
    right = found.select((F.col("doc_id") - 1).alias("doc_id"), "line").join(pairs, "doc_id", "left_semi")
    return overlap.multiset_overlap(left, right, ["doc_id"], "line").withColumn("overlap", F.round("overlap", 9))


@query("""WITH s AS (SELECT l_suppkey, floor(l_quantity * 2 + 0.5) / 2 AS k, sum(l_linenumber)::BIGINT AS w, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_suppkey, arg_max(k, struct_pack(w := w, f := -f)) AS mode, max(w) AS weight FROM s GROUP BY l_suppkey""")
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.weighted_mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.floor(F.col("l_quantity") * 2 + 0.5) / 2, F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("""WITH s AS (SELECT l_suppkey, floor(l_quantity + 0.5)::BIGINT AS x, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_max(x, struct_pack(n := n, x := -x)) AS margin, max(n) AS n FROM s GROUP BY l_suppkey""")
def margin_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.margin_mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity"))


@query("SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY source")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.upper_median(table(spark, sf_dir, "documents"), ["source"], F.col("n_chars"))


@query("""SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS line FROM (
  SELECT user_id, event_id, value, ts, coalesce((abs(lag(value) OVER w - value) > greatest(1.0, 0.35 * lag(event_id % 12) OVER w))::INT, 0) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, ts, event_id))""")
def baseline_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").withColumn("size", F.col("event_id") % 12)
    return overlap.baseline_groups(items, ["user_id"], "value", "ts", "size", "event_id").select("user_id", "event_id", "line")


@query("""WITH RECURSIVE f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT source, doc_id, i, CASE WHEN n_chars > 6000 THEN 'too large' WHEN n_chars > 40000 THEN 'over total' ELSE 'accepted' END AS verdict, CASE WHEN n_chars > 6000 OR n_chars > 40000 THEN 0 ELSE n_chars END AS running FROM f WHERE i = 1
  UNION ALL SELECT f.source, f.doc_id, f.i, CASE WHEN f.n_chars > 6000 THEN 'too large' WHEN g.running + f.n_chars > 40000 THEN 'over total' ELSE 'accepted' END,
    CASE WHEN f.n_chars > 6000 OR g.running + f.n_chars > 40000 THEN g.running ELSE g.running + f.n_chars END FROM g JOIN f ON f.source = g.source AND f.i = g.i + 1)
SELECT source, doc_id, verdict FROM g""")
def screen_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return overlap.screen_files(found, "source", "doc_id", "n_chars", 6000, 40000).select("source", "doc_id", "verdict")


DEPTHS = [(1, 0, 82.0, 0), (1, 1, 100.0, 1), (1, 2, 104.0, 1), (1, 3, 118.0, 2), (1, 4, 140.0, 2), (1, 5, 82.0, 0), (2, 0, 50.0, 0), (2, 1, 56.0, 0), (2, 2, 62.5, 1), (3, 0, 82.0, 0), (3, 1, 88.0, 1), (3, 2, 90.0, 1)]


@query(f"SELECT doc, seq, depth FROM {sql_values(DEPTHS, 'doc, seq, indent, depth')}")
def list_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values(spark, DEPTHS, "doc int, seq int, indent double, d int").drop("d")
    return overlap.list_depths(found, "doc", "indent").select("doc", "seq", "depth")


@query("""WITH r AS (SELECT lang, n_chars AS b, n_chars // 2 + doc_id % 3 AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
s AS (SELECT lang, sum(b)::BIGINT AS before, coalesce(sum(b) FILTER (r <= 6 AND a < b), 0)::BIGINT AS sb, coalesce(sum(a) FILTER (r <= 6 AND a < b), 0)::BIGINT AS sa, coalesce(sum(b) FILTER (r > 6), 0)::BIGINT AS rest,
  count(*) FILTER ((r <= 6 AND a < b) OR r > 6) AS touched, count(*) > 6 AS sampled FROM r GROUP BY lang)
SELECT lang, before, greatest(1024, before - (sb - sa + rest - floor(rest * CASE WHEN sb > 0 THEN sa / sb ELSE 1.0 END + 0.5)))::BIGINT AS after, touched, sampled FROM s""")
def estimate_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("lang", "doc_id", F.col("n_chars").alias("b"), (F.floor(F.col("n_chars") / 2) + F.col("doc_id") % 3).alias("a"))
    return overlap.estimate_recompress(found, "lang", "b", "a", "doc_id")


VERDICT = """SELECT p_partkey, p_brand, CASE WHEN p_size % 7 = 0 THEN 'transparency' WHEN p_size % 2 = 0 THEN 'not a JPEG' WHEN p_retailprice * 4 < 4096 THEN 'already small'
  WHEN p_size % 3 = 0 THEN 'unsupported colour' ELSE 'recompress' END AS verdict FROM part"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    filters = F.array(F.when(size % 2 == 0, "/FlateDecode").otherwise("/DCTDecode"))
    space = F.when(size % 3 == 0, "/DeviceCMYK").otherwise("/DeviceRGB")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", classify_image(filters, space, size % 7 == 0, F.col("p_retailprice") * 4).alias("verdict"))


@query(VERDICT)
def classify_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir)


@query(f"""SELECT p_brand, string_agg(verdict || '=' || n, ',' ORDER BY verdict) AS tally FROM (SELECT p_brand, verdict, count(*) AS n FROM ({VERDICT}) GROUP BY ALL) GROUP BY p_brand""")
def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.tally(verdicts(spark, sf_dir), ["p_brand"], "verdict")
    shown = F.transform(F.array_sort(F.map_entries("tally")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("p_brand", F.array_join(shown, ",").alias("tally"))


PAGES = f"""SELECT source, doc_id AS page, line, CASE WHEN pos = 0 THEN 780 ELSE 30 END + doc_id % 2 AS y, least(length(line), 400) AS w FROM (SELECT doc_id, line, pos, max(pos) OVER (PARTITION BY doc_id) AS last FROM ({LINED}))
  JOIN documents USING (doc_id) WHERE pos = 0 OR pos = last"""


@query(f"""WITH p AS ({PAGES}), m AS (SELECT source, page, max(w) AS widest FROM p GROUP BY ALL),
k AS (SELECT p.*, CASE WHEN y > 800 * 0.88 THEN 'top' ELSE 'bottom' END AS zone, lower(regexp_replace(regexp_replace(trim(line, ' '), '[0-9]+', '#', 'g'), '{T.WS}+', ' ', 'g')) AS key, w <= 0.7 * widest AS narrow FROM p JOIN m USING (source, page)),
n AS (SELECT source, count(DISTINCT page) AS pages FROM p GROUP BY source),
r AS (SELECT source, zone, key FROM k JOIN n USING (source) WHERE narrow AND key <> '' GROUP BY source, zone, key, pages HAVING count(DISTINCT page) >= greatest(2, ceil(0.02 * pages)) AND max(y) - min(y) <= 2.5)
SELECT k.source, page, y::DOUBLE AS y, line, r.key IS NOT NULL AS is_furniture FROM k LEFT JOIN r ON narrow AND r.source = k.source AND r.zone = k.zone AND r.key = k.key""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, first and last lines at the page's ends; a page share of 0.02 as sources have few common lines."""
    found = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), T.split_lines(F.col("text")).alias("l"))
    ends = found.where(F.size("l") > 0).select("source", "page", F.size("l").alias("n"), F.posexplode("l").alias("pos", "text")).where("pos = 0 or pos = n - 1")
    y = (F.when(F.col("pos") == 0, 780).otherwise(30) + F.col("page") % 2).cast("double")
    placed = ends.select("source", "page", "text", F.lit(0.0).alias("x"), y.alias("y"), F.least(F.length("text"), F.lit(400)).cast("double").alias("right"), F.lit(800.0).alias("height"))
    return furniture.furniture(placed, "source", share=0.02).select("source", "page", "y", F.col("text").alias("line"), "is_furniture")


TOOLS = [("qr", "image", "available"), ("photo-metadata", "image", "available"), ("paper-to-text", "pdf", "available"), ("later", "pdf", "coming-soon")]


@query(f"""SELECT path, CASE WHEN path = '/' THEN '1.0' WHEN path IN ('/about', '/tools') THEN '0.9' ELSE '0.8' END AS priority FROM (
SELECT * FROM (VALUES ('/'), ('/about'), ('/tools')) AS p(path) UNION ALL SELECT '/tools/' || slug FROM {sql_values(TOOLS, 'slug, category, status')} WHERE status = 'available')""")
def sitemap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.sitemap_paths(values(spark, TOOLS, catalogue.SCHEMA), ["/", "/about", "/tools"])


@query(f"SELECT category, count(*) AS n FROM {sql_values(TOOLS, 'slug, category, status')} WHERE status = 'available' GROUP BY category")
def tools_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.available(values(spark, TOOLS, catalogue.SCHEMA)).groupBy("category").agg(F.count("*").alias("n"))
