"""Comparison, layout, markup, pictures, codes and office documents. Where SQL can't run the algorithm it states what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import diff
from paperloom.plans.workspace import ship, spread
from paperloom.queries.relations import neighbours
from paperloom.queries.text import LINED
from paperloom.registry import query, table

COUNTED = f"""WITH n AS (SELECT doc_id, count(l.line) AS n FROM documents LEFT JOIN ({LINED}) l USING (doc_id) GROUP BY doc_id) SELECT a.doc_id, a.n AS n_left, b.n AS n_right"""


@query(f"{COUNTED}, true AS same_right FROM n a JOIN n b ON b.doc_id = a.doc_id + 1")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal and deleted lines are the left side, equal and inserted ones the right side, in order."""
    ship(spark)
    found = neighbours(spark, sf_dir).withColumn("d", diff.line_edits(F.col("left"), F.col("right"))["edits"])
    right = F.transform(F.filter("d", lambda e: e["b"].isNotNull()), lambda e: F.get(T.split_lines(F.col("right")), e["b"]))
    of = lambda op: F.size(F.filter("d", lambda e: e["op"] != op)).cast("long")
    return found.select("doc_id", of("insert").alias("n_left"), of("delete").alias("n_right"), (right == T.split_lines(F.col("right"))).alias("same_right"))


@query(f"{COUNTED}, true AS bounded FROM n a JOIN n b ON b.doc_id = a.doc_id + 1")
def compare_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed, changed and unchanged rows are the left side; similarity lies in 0 to 1 and is 1 for identical texts."""
    ship(spark)
    found = neighbours(spark, sf_dir).select("doc_id", diff.compare(F.col("left"), F.col("right")).alias("c"))
    shared = F.col("c.changed") + F.col("c.unchanged")
    s = F.col("c.similarity")
    bounded = (s >= 0) & (s <= 1) & (~F.col("c.identical") | (s == 1))
    return found.select("doc_id", (F.col("c.removed") + shared).cast("long").alias("n_left"), (F.col("c.added") + shared).cast("long").alias("n_right"), bounded.alias("bounded"))


@query()
def compare_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How similar neighbouring documents are and what changed."""
    ship(spark)
    found = neighbours(spark, sf_dir).select("doc_id", diff.compare(F.col("left"), F.col("right")).alias("c"))
    return found.select("doc_id", "c.added", "c.removed", "c.changed", "c.unchanged", F.round("c.similarity", 9).alias("similarity"), "c.identical", "c.truncated")


@query("SELECT a.doc_id, true AS symmetric FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def swap_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    left, right = F.col("left"), F.col("right")
    found = neighbours(spark, sf_dir).select("doc_id", diff.line_edits(left, right)["edits"].alias("x"), diff.line_edits(right, left)["edits"].alias("y"))
    n = lambda c, op: F.size(F.filter(c, lambda e: e["op"] == op))
    return found.select("doc_id", ((n("x", "insert") == n("y", "delete")) & (n("x", "delete") == n("y", "insert"))).alias("symmetric"))


@query("SELECT a.doc_id, a.text = b.text AS empty, true AS agrees FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def patch_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch is empty for equal texts only, and otherwise has hunks."""
    ship(spark)
    found = neighbours(spark, sf_dir).select("doc_id", diff.unified_patch(F.col("left"), F.col("right")).alias("p"))
    return found.select("doc_id", (F.col("p") == "").alias("empty"), ((F.col("p") == "") == (diff.hunks(F.col("p")) == 0)).alias("agrees"))


@query("SELECT item_id, replace(upper(replace(text, 'ß', 'ss')), 'ẞ', 'SS') AS left_text, replace(text, 'ß', 'ss') AS right_text, 1 AS n_runs FROM benchmark WHERE text <> ''")
def word_diff_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    plain = F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))  # whose capital isn't one letter everywhere
    found = table(spark, sf_dir, "benchmark").select("item_id", diff.word_segments(F.upper(plain), plain, case=True).alias("s"))
    joined = lambda side: F.array_join(F.transform(f"s.{side}", lambda x: x["text"]), "")
    return found.select("item_id", joined("left").alias("left_text"), joined("right").alias("right_text"), F.size("s.left").alias("n_runs"))


@query()
def paired_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.pair_changes(diff.exploded_edits(neighbours(spark, sf_dir), "doc_id", "left", "right"), "doc_id")


def laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each of the benchmark's items as a page of a document: a heading, its lines as paragraphs of their own, and a page number."""
    found = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 5).alias("doc_id"), (F.col("item_id") % 5).cast("int").alias("page"), T.split_lines(F.col("text")).alias("l"))
    body = found.select("doc_id", "page", F.posexplode("l").alias("seq", "text")).select("doc_id", "page", "seq", "text", F.lit(64.0).alias("x"), (700.0 - 30 * F.col("seq")).alias("y"), (5.0 * F.length("text")).alias("width"), F.lit(11.0).alias("size"))
    head = found.select("doc_id", "page", F.lit(-1).alias("seq"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("text"), F.lit(64.0), F.lit(730.0), F.lit(60.0), F.lit(20.0))
    foot = found.select("doc_id", "page", F.lit(999).alias("seq"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("text"), F.lit(280.0), F.lit(30.0), F.lit(40.0), F.lit(9.0))
    items = body.union(head).union(foot).withColumn("font", F.lit("Calibri"))
    return items, found.select("doc_id", "page", F.lit(595.28).alias("width"), F.lit(841.89).alias("height"), F.lit(0).alias("image_count"))


@query("""WITH l AS (SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark)),
n AS (SELECT item_id, count(*) FILTER (line <> '') AS n FROM l GROUP BY item_id)
SELECT item_id // 5 AS doc_id, (item_id % 5)::INT AS page, 'heading' AS kind, 1 AS n FROM n UNION ALL SELECT item_id // 5, (item_id % 5)::INT, 'paragraph', n FROM n WHERE n > 0""")
def inferred_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and paragraphs come back; page numbers are furniture."""
    from paperloom.operators import infer

    found = infer.documents(*laid_out(spark, sf_dir))
    return found.groupBy("doc_id", "page", "kind").agg(F.count("*").cast("int").alias("n"))


@query("""WITH i AS (SELECT item_id, 'Part ' || item_id % 5 || CASE WHEN item_id % 3 = 0 THEN chr(57344) ELSE '' END AS head, CASE WHEN item_id % 4 = 1 THEN '' ELSE 'Page ' || item_id % 5 || text END AS rest FROM benchmark),
n AS (SELECT item_id, length(regexp_replace(head || rest, '\\s', '', 'g')) AS seen FROM i)
SELECT (item_id // 5)::BIGINT AS doc_id, (item_id % 5)::INT AS page, item_id % 4 = 1 AND item_id % 8 <> 1 AS scanned, round(CASE WHEN item_id % 3 = 0 THEN 1.0::DOUBLE / seen ELSE 0.0::DOUBLE END, 9) AS unmapped FROM n""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages hold hardly any text, some of these pictures; some headings have a character without a mapping."""
    from paperloom.operators.furniture import page_quality as quality

    items, pages = laid_out(spark, sf_dir)
    item = 5 * F.col("doc_id") + F.col("page")
    bad = F.when((F.col("seq") == -1) & (item % 3 == 0), F.concat("text", F.lit("\ue000"))).otherwise(F.col("text"))
    found = quality(items.where((F.col("seq") == -1) | (item % 4 != 1)).withColumn("text", bad), pages.withColumn("image_count", (item % 8 != 1).cast("int")))
    return found.withColumn("unmapped", F.round("unmapped", 9))


@query("""SELECT page_id, len(h) AS n, array_to_string(list_transform(h, lambda x: replace(replace(replace(trim(x), '&quot;', '"'), '&lt;', '<'), '&amp;', '&')), '|') AS headings
FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda x: trim(x) <> '') AS h FROM pages)""")
def markup_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level headings of web pages, in order."""
    from paperloom.operators import markup

    ship(spark)
    found = spread(table(spark, sf_dir, "pages")).select("page_id", markup.blocks(F.col("html")).alias("b"))
    heads = F.filter("b", lambda x: (x["kind"] == "heading") & (x["level"] == 1))
    return found.select("page_id", F.size(heads).cast("long").alias("n"), F.array_join(F.transform(heads, lambda x: x["text"]), "|").alias("headings"))


STRIPPED = "regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '\\s+', '', 'g')"


@query(f"SELECT page_id, {STRIPPED.format('html')} AS squeezed FROM (SELECT page_id, replace(replace(html, '&quot;', '\"'), '&amp;', '&') AS html FROM pages)")
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks hold all text of a page but white space, in order."""
    from paperloom.operators import markup

    ship(spark)
    found = spread(table(spark, sf_dir, "pages")).select("page_id", markup.blocks(F.col("html")).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return found.select("page_id", F.regexp_replace(joined, r"\s+", "").alias("squeezed"))


@query()
def markup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import markup

    found = markup.exploded(spread(table(spark, sf_dir, "pages")), "page_id", "html")
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, content): a JPEG for each part with its name as a comment and an Exif block that turns it."""
    name = F.encode(F.col("p_name"), "UTF-8")
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    turn = F.col("p_size") % 8 + 1
    tiff = F.concat(F.unhex(F.lit("4d4d002a000000080001011200030000000100")), F.unhex(F.lpad(F.hex(turn), 2, "0")), F.unhex(F.lit("000000000000")))
    exif = F.concat(F.unhex(F.lit("ffe1")), two(F.length(tiff) + 8), F.unhex(F.lit("457869660000")), tiff)
    comment = F.concat(F.unhex(F.lit("fffe")), two(F.length(name) + 2), name)
    file = F.concat(F.unhex(F.lit("ffd8ffe000104a46494600010100000100010000")), exif, comment, F.unhex(F.lit("ffda00080101003f00")), name, F.unhex(F.lit("ffd9")))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", "p_name", file.alias("content"))


@query("SELECT p_partkey, 7 AS n_segments, true AS tiled, 'exif,comment' AS kinds FROM part")
def image_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments lie end to end from the first byte to the last."""
    from paperloom.operators import imgmeta

    found = pictures(spark, sf_dir).select("p_partkey", F.length("content").alias("n"), imgmeta.walk(F.col("content"))["segments"].alias("s"))
    end = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: F.when(a == x["start"], x["end"]).otherwise(-1))
    kinds = F.array_join(F.filter(F.transform("s", lambda x: x["kind"]), lambda k: k != "structural"), ",")
    return found.select("p_partkey", F.size("s").alias("n_segments"), (end == F.col("n")).alias("tiled"), kinds.alias("kinds"))


TURNED = "CASE p_size % 8 + 1 WHEN 1 THEN 'Normal' WHEN 2 THEN 'Mirrored' WHEN 3 THEN 'Rotated 180°' WHEN 4 THEN 'Mirrored, rotated 180°' WHEN 5 THEN 'Mirrored, rotated 90° CCW' WHEN 6 THEN 'Rotated 90° CW' WHEN 7 THEN 'Mirrored, rotated 90° CW' ELSE 'Rotated 90° CCW' END"


@query(f"SELECT p_partkey, 'Orientation' AS label, {TURNED} AS value, false AS sensitive FROM part UNION ALL SELECT p_partkey, 'Comment', p_name, true FROM part")
def image_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import imgmeta

    return imgmeta.metadata_fields(pictures(spark, sf_dir), "p_partkey").select("p_partkey", "label", "value", "sensitive")


@query("SELECT p_partkey, true AS pixels_kept, nullif(p_size % 8 + 1, 1)::INT AS orientation, (length(p_name) + 4 + CASE WHEN p_size % 8 = 0 THEN 36 ELSE 0 END)::BIGINT AS bytes_removed FROM part")
def image_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import imgmeta

    ship(spark)
    found = pictures(spark, sf_dir).select("p_partkey", imgmeta.strip(F.col("content")).alias("s"))
    return found.select("p_partkey", "s.pixels_kept", "s.orientation", "s.bytes_removed")


@query("SELECT s_suppkey, CASE WHEN length(s_name) <= 20 THEN 1 ELSE 2 END AS version, true AS framed FROM supplier")
def qr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names in capitals, as codes with their finder patterns in place."""
    from paperloom.operators import qr

    ship(spark)
    found = table(spark, sf_dir, "supplier").select("s_suppkey", qr.qr(F.translate(F.upper("s_name"), "#", "-"), "M").alias("m"))
    dark = lambda r, c: qr.is_dark(F.col("m"), r, c)
    last = F.col("m.size") - 1
    framed = dark(F.lit(0), F.lit(0)) & dark(F.lit(0), last) & dark(last, F.lit(0)) & ~dark(F.lit(1), F.lit(1)) & dark(F.lit(3), F.lit(3)) & dark(last - 7, F.lit(8)) & (F.length("m.data") == F.col("m.size") * F.col("m.size"))
    return found.select("s_suppkey", "m.version", framed.alias("framed"))


@query("""WITH l AS (SELECT item_id, unnest(l) AS line FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark)),
n AS (SELECT item_id // 5 AS doc_id, count(*) FILTER (line <> '') AS n, count(DISTINCT item_id) AS pages FROM l GROUP BY 1)
SELECT doc_id::BIGINT AS doc_id, 'heading' AS kind, pages AS n FROM n UNION ALL SELECT doc_id, 'paragraph', n FROM n""")
def office_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred blocks, written as a package a document and read back."""
    from paperloom.operators import infer, office

    packages = office.write_packages(infer.documents(*laid_out(spark, sf_dir)))
    found = packages.select("doc_id", F.inline(office.read(F.col("content"))["blocks"]))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT item_id // 5 AS doc_id, 595.3::DOUBLE AS width, 841.9::DOUBLE AS height, 56.7::DOUBLE AS margin, 1 AS columns, 0 AS missed FROM benchmark GROUP BY 1")
def office_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import infer, office

    packages = office.write_packages(infer.documents(*laid_out(spark, sf_dir)))
    found = packages.select("doc_id", office.read(F.col("content")).alias("r"))
    return found.select("doc_id", F.round("r.setup.width", 4).alias("width"), F.round("r.setup.height", 4).alias("height"), F.round("r.setup.margin", 4).alias("margin"), "r.setup.columns", "r.missed")


@query(f"SELECT page_id, {STRIPPED.format('html')} AS squeezed FROM (SELECT page_id, replace(replace(regexp_replace(html, '<li><a', '<li>•<a', 'g'), '&quot;', '\"'), '&amp;', '&') AS html FROM pages)")
def paginated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a page's blocks is drawn, in order, list items with their bullets."""
    from paperloom.operators import markup, paginate

    ship(spark)
    found = spread(table(spark, sf_dir, "pages")).select("page_id", paginate.drawn(markup.blocks(F.col("html"))).alias("d"))
    joined = F.array_join(F.transform(F.filter("d", lambda x: x["kind"] == "line"), lambda x: x["text"]), "")
    return found.select("page_id", F.regexp_replace(joined, r"\s+", "").alias("squeezed"))


@query()
def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import markup, paginate

    ship(spark)
    found = spread(table(spark, sf_dir, "pages")).select("page_id", F.inline(paginate.drawn(markup.blocks(F.col("html")), columns=2, column_gap=14.0)))
    return found.groupBy("page_id", "page").agg(F.count("*").alias("n_items"), F.round(F.min("y"), 6).alias("lowest"), F.round(F.max(F.col("x") + F.col("width")), 6).alias("rightmost"))


@query("SELECT page_id, true AS is_pdf, 'none' AS encryption, true AS whole FROM pages")
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as PDF files, looked at from outside."""
    from paperloom.functions.files import looks_like_pdf
    from paperloom.operators import markup, paginate

    ship(spark)
    found = spread(table(spark, sf_dir, "pages")).select("page_id", paginate.pdf(markup.blocks(F.col("html"))).alias("f"))
    tail = F.decode(F.expr("substring(f, -6)"), "ISO-8859-1")
    return found.select("page_id", looks_like_pdf(F.col("f")).alias("is_pdf"), paginate.encryption(F.col("f")).alias("encryption"), tail.contains("%%EOF").alias("whole"))


@query("""WITH n AS (SELECT item_id // 5 AS doc_id, count(DISTINCT item_id) AS pages, sum(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')))::BIGINT AS p FROM benchmark GROUP BY 1)
SELECT doc_id, 'Recovered ' || p || CASE WHEN p = 1 THEN ' paragraph' ELSE ' paragraphs' END || ' and ' || pages || CASE WHEN pages = 1 THEN ' heading' ELSE ' headings' END || ' from ' || pages || CASE WHEN pages = 1 THEN ' page.' ELSE ' pages.' END AS said FROM n""")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import infer

    return infer.describe(infer.documents(*laid_out(spark, sf_dir)))


@query("SELECT p_partkey, 2 AS total, 1 AS sensitive, 'authorship,technical' AS groups FROM part")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import imgmeta

    return imgmeta.summarise(imgmeta.metadata_fields(pictures(spark, sf_dir), "p_partkey"), "p_partkey")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Orientation' WHEN 1 THEN 'Lens model' WHEN 2 THEN 'Latitude' ELSE 'Tag 0xbeef' END AS label,
CASE p_partkey % 4 WHEN 0 THEN false ELSE true END AS sensitive FROM part""")
def tag_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import imgmeta

    kind = F.col("p_partkey") % 4
    ifd = F.element_at(F.array(F.lit("ifd0"), F.lit("exif"), F.lit("gps"), F.lit("exif")), (kind + 1).cast("int"))
    tag = F.element_at(F.array(F.lit(0x0112), F.lit(0xA434), F.lit(2), F.lit(0xBEEF)), (kind + 1).cast("int"))
    entries = table(spark, sf_dir, "part").select("p_partkey", ifd.alias("ifd"), tag.alias("tag"))
    pointers = entries.select("p_partkey", F.lit("ifd0").alias("ifd"), F.lit(0x8769).alias("tag"))
    return imgmeta.with_tag_info(entries.union(pointers)).select("p_partkey", "label", "sensitive")


@query("SELECT page_id, contains(html, '<b>') AS bold, false AS italic, false AS both, '' AS scripts FROM pages")
def face_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import markup

    return markup.face_needs(markup.exploded(spread(table(spark, sf_dir, "pages")), "page_id", "html"), "page_id")


@query("""SELECT p_partkey, p_name AS text, 1 AS n_pages, CASE WHEN p_partkey % 2 = 0 THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS fonts, 0 AS n_images, p_size + 8.0::DOUBLE AS largest, true AS inside
FROM (SELECT p_partkey, p_name, 3.0 AS p_size FROM part)""")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that was drawn into files and read back from them."""
    from paperloom.operators import markup, paginate, pdf_text

    ship(spark)
    name = F.col("p_name")
    html = F.concat(F.lit("<p>"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<b>"), name, F.lit("</b>"))).otherwise(name), F.lit("</p>"))
    files = spread(table(spark, sf_dir, "part")).select("p_partkey", paginate.pdf(markup.blocks(html)).alias("content"))
    pages = pdf_text.pages_of(files, "p_partkey", "content")
    items = F.col("items")
    inside = F.forall(items, lambda i: (i["transform"][4] >= 0) & (i["transform"][4] + i["width"] <= F.col("width")) & (i["transform"][5].between(0, F.col("height"))))
    return pages.select(
        F.col("doc_id").alias("p_partkey"), F.array_join(F.transform(items, lambda i: i["text"]), " ").alias("text"), (F.col("page") + 1).alias("n_pages"), F.array_join("fonts", ",").alias("fonts"),
        F.col("image_count").alias("n_images"), F.array_max(F.transform(items, lambda i: i["transform"][0])).alias("largest"), inside.alias("inside"),
    )


@query("""SELECT p_partkey, p_name AS text, 'paragraph' AS kind, 0 AS seq FROM part WHERE p_partkey % 2 = 1""")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to blocks: reading, layout inference and furniture in one."""
    from paperloom.operators import markup, paginate, pdf_text

    ship(spark)
    parts = spread(table(spark, sf_dir, "part").where("p_partkey % 2 = 1"))
    files = parts.select("p_partkey", paginate.pdf(markup.blocks(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")))).alias("content"))
    return pdf_text.documents(files, "p_partkey", "content").select(F.col("doc_id").alias("p_partkey"), "text", "kind", "seq")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'owner-only' ELSE 'user-password' END AS encryption, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'needs-password' ELSE 'wrong-password' END AS refused, p_name AS text, 'none' AS afterwards FROM part WHERE p_partkey <= 600")
def sealed_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with passwords: how they are sealed, what a reader without the right one is told, and what is in them."""
    from paperloom.operators import markup, paginate, pdf_text

    ship(spark)
    kind, brand = F.col("p_partkey") % 3, F.col("p_brand")
    parts = spread(table(spark, sf_dir, "part").where("p_partkey <= 600"))
    files = parts.select("p_partkey", kind.alias("kind"), "p_brand", paginate.pdf(markup.blocks(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")))).alias("f"))
    sealed = files.select("p_partkey", "kind", "p_brand", pdf_text.protect(F.col("f"), F.when(F.col("kind") != 0, brand), F.concat(brand, F.lit("!")), "AES-128", copying=False)["content"].alias("f"))
    said = pdf_text.read(F.col("f"), F.when(F.col("kind") == 2, "no"))["error"]
    opened = sealed.select("p_partkey", paginate.encryption(F.col("f")).alias("encryption"), said.alias("refused"), pdf_text.unlock(F.col("f"), F.concat(brand, F.lit("!")))["content"].alias("f"))
    items = pdf_text.read(F.col("f"))["pages"][0]["items"]
    return opened.select("p_partkey", "encryption", "refused", F.array_join(F.transform(items, lambda i: i["text"]), " ").alias("text"), paginate.encryption(F.col("f")).alias("afterwards"))
