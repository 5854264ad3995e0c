"""Sizes, names, ranges, colours, payloads and security texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import colour as C
from paperloom.functions import files as N
from paperloom.functions import payloads as P
from paperloom.registry import query, sql_values, table, values


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b || ' B' ELSE
  CASE WHEN v < 10 THEN printf('%.1f', floor(v * 10 + 0.5) / 10) ELSE floor(v + 0.5)::BIGINT::VARCHAR END || CASE WHEN b < 1048576 THEN ' kB' WHEN b < 1073741824 THEN ' MB' ELSE ' GB' END END AS shown,
  floor(b / 1048576 + 0.5)::BIGINT || ' MB' AS as_limit
FROM (SELECT l_orderkey, l_linenumber, b, b / CASE WHEN b < 1048576 THEN 1024.0::DOUBLE WHEN b < 1073741824 THEN 1048576.0::DOUBLE ELSE 1073741824.0::DOUBLE END AS v
      FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_quantity * l_quantity)::BIGINT * CASE WHEN l_linenumber = 1 THEN 1000 ELSE 1 END // CASE WHEN l_linenumber = 2 THEN 1000000 ELSE 1 END AS b FROM lineitem))""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity"))
    scaled = F.floor(base * F.when(F.col("l_linenumber") == 1, 1000).otherwise(1) / F.when(F.col("l_linenumber") == 2, 1000000).otherwise(1))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scaled.alias("b"))
    return found.select("l_orderkey", "l_linenumber", N.format_bytes(F.col("b")).alias("shown"), N.format_limit(F.col("b")).alias("as_limit"))


BYTE_CASES = [(0.0, "0 B"), (1023.0, "1023 B"), (1024.0, "1.0 kB"), (10199.0, "10.0 kB"), (98566144.0, "94 MB"), (-1.0, "—"), (None, "—"), (5.0e12, "4657 GB")]


@query(f"SELECT n::DOUBLE AS n, shown FROM {sql_values(BYTE_CASES, 'n, shown')}")
def format_bytes_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, BYTE_CASES, "n double, shown string").select("n", N.format_bytes(F.col("n")).alias("shown"))


@query("SELECT p_partkey, floor((p_retailprice - p_size * 40) / p_retailprice * 100 + 0.5)::BIGINT AS saved FROM part")
def savings_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.savings_percent(F.col("p_retailprice"), F.col("p_size") * 40).alias("saved"))


@query("""SELECT p_partkey, CASE WHEN w <= 1600 AND h <= 1600 THEN w ELSE greatest(1, floor(w * least(1600.0 / w, 1600.0 / h) + 0.5))::BIGINT END AS width,
  CASE WHEN w <= 1600 AND h <= 1600 THEN h ELSE greatest(1, floor(h * least(1600.0 / w, 1600.0 / h) + 0.5))::BIGINT END AS height,
  (ceil(w * 2.5::DOUBLE) * ceil(h * 2.5::DOUBLE))::BIGINT AS pixels, ceil(w * 2.5::DOUBLE) * ceil(h * 2.5::DOUBLE) > 40000000 AS too_large,
  greatest(0.1, floor(sqrt(40000000.0::DOUBLE / (w * h)) * 10) / 10) AS scale
FROM (SELECT p_partkey, p_size * 97 AS w, floor(p_retailprice * 2)::BIGINT AS h FROM part)""")
def fit_and_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    found = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("long").alias("w"), F.floor(F.col("p_retailprice") * 2).alias("h"))
    pixels = N.canvas_pixels(w, h, F.lit(2.5))
    fitted = found.select("p_partkey", N.fit_within(w, h, F.lit(1600.0)).alias("f"), pixels.alias("pixels"), N.exceeds_canvas(pixels).alias("too_large"), N.largest_safe_scale(w, h).cast("double").alias("scale"))
    return fitted.select("p_partkey", "f.*", "pixels", "too_large", "scale")


RANGE_CASES = [
    ("", 4, "1,2,3,4"), ("  ", 2, "1,2"), ("1-3", 5, "1,2,3"), ("3-1", 5, "1,2,3"), ("1-3, 8, 11-", 12, "1,2,3,8,11,12"), ("-2", 5, "1,2"), ("4-", 5, "4,5"), ("-", 3, "1,2,3"), ("0-3", 5, "1,2,3"),
    ("9-12", 5, ""), ("2,2,1", 5, "1,2"), ("x,3", 5, "3"), ("2–4", 5, "2,3,4"), ("7", 5, ""), ("1", 0, ""), ("5 - 6", 9, "5,6"),
]


@query(f"SELECT expression, total, pages FROM {sql_values(RANGE_CASES, 'expression, total, pages')}")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values(spark, RANGE_CASES, "expression string, total int, p string")
    return found.select("expression", "total", F.array_join(N.parse_page_range(F.col("expression"), F.col("total")).cast("array<string>"), ",").alias("pages"))


NAME_CASES = [
    ("a/b\\photo.final.png", "photo.final.png", "photo.final", "photo.final.jpg"), ("..hidden", "hidden", "hidden", "hidden.jpg"), ('we<i>r:d"n|a?m*e.txt', "weirdname.txt", "weirdname", "weirdname.jpg"),
    ("", "file", "file", "file.jpg"), ("???", "file", "file", "file.jpg"), ("tab\there.md", "tabhere.md", "tabhere", "tabhere.jpg"), ("dir/", "file", "file", "file.jpg"), ("a b-c.d", "a b-c.d", "a b-c", "a b-c.jpg"),
]


@query(f"SELECT name, clean, stem, renamed FROM {sql_values(NAME_CASES, 'name, clean, stem, renamed')}")
def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return values(spark, NAME_CASES, "name string, a string, b string, c string").select("name", N.sanitize_filename(c).alias("clean"), N.stem_of(c).alias("stem"), N.with_extension(c, F.lit(".jpg")).alias("renamed"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lpad(page_id::VARCHAR, greatest(length(page_id::VARCHAR), 6)::INT, '0') AS label FROM
  (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[<>:"|?*]', '', 'g'), '^[.]+', '') AS url FROM pages)""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.sanitize_filename(F.col("url"), "").alias("base"), N.page_label(F.col("page_id"), F.lit(100000)).alias("label"))


UNIQUE_CASES = [(1, "a.png,a.png,a.png", "a.png,a (2).png,a (3).png"), (2, "a (2).png,a.png,a.png", "a (2).png,a.png,a (3).png"), (3, "x,x,.h,.h", "x,x (2),.h,.h (2)"), (4, "b.tar.gz,b.tar.gz", "b.tar.gz,b.tar (2).gz")]


@query(f"SELECT batch, given, given_out AS names FROM {sql_values(UNIQUE_CASES, 'batch, given, given_out')}")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values(spark, UNIQUE_CASES, "batch int, given string, o string")
    return found.select("batch", "given", F.array_join(N.unique_names(F.split("given", ",")), ",").alias("names"))


MAGIC = [
    ("ffd8ffe000", "jpeg"), ("89504e470d0a1a0a00", "png"), ("524946460000000057454250", "webp"), ("474946383961", "gif"), ("0000001c667479706176696600", "avif"), ("0000001c667479706865696300", "heic"),
    ("49492a0008", "tiff"), ("4d4d002a00", "tiff"), ("255044462d312e37", None), ("", None), ("49492a00", None),
]


@query(f"SELECT hexed, kind, coalesce(hexed LIKE '255044462d%', false) AS pdf FROM {sql_values(MAGIC, 'hexed, kind')}")
def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.unhex("hexed")
    return values(spark, MAGIC, "hexed string, k string").select("hexed", N.detect_container(content).alias("kind"), N.looks_like_pdf(content).alias("pdf"))


COLOURS = [
    ("red", "#ff0000"), ("#abc", "#aabbcc"), ("abc", None), ("aabbcc", "#aabbcc"), ("#11223344", "#112233"), ("#12345", None), ("rgb(50%, 20, 300)", "#3214ff"), ("rgba(1 2 3 / 0.5)", "#010203"),
    ("hsl(120, 100%, 25%)", "#008000"), ("hsl(-120 100% 50%)", "#0000ff"), ("hsv(60,100,100)", "#ffff00"), ("cmyk(0,100,100,0)", "#ff0000"), ("oklch(0.628 0.2577 29.23)", "#ff0000"), ("rgb(12px, x, 3)", None),
    ("rgb()", "#000000"), ("constructor", None), ("", None), (" HotPink ", "#ff69b4"), ("lab(1,2,3)", None),
]


@query(f"SELECT source, hexed FROM {sql_values(COLOURS, 'source, hexed')}")
def colour_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, COLOURS, "source string, h string").select("source", C.rgb_to_hex(C.parse_colour(F.col("source"))).alias("hexed"))


@query("""WITH c AS (SELECT c_custkey, (c_custkey * 7919) % 256 AS r, (c_custkey * 104729) % 256 AS g, (c_custkey * 1299709) % 256 AS b FROM customer),
l AS (SELECT *, 0.2126 * f(r) + 0.7152 * f(g) + 0.0722 * f(b) AS y FROM (SELECT * FROM c))
SELECT c_custkey, printf('#%02x%02x%02x', r, g, b) AS hexed, round(greatest(1.05 / (y + 0.05), (y + 0.05) / 1.05), 6) AS on_white, CASE WHEN r + g + b > 765 THEN 'inverted' WHEN 1.05 / (y + 0.05) < 3 THEN 'low contrast' END AS warning FROM l""".replace("f(r)", "CASE WHEN r / 255.0::DOUBLE <= 0.03928 THEN r / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END").replace("f(g)", "CASE WHEN g / 255.0::DOUBLE <= 0.03928 THEN g / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END").replace("f(b)", "CASE WHEN b / 255.0::DOUBLE <= 0.03928 THEN b / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"))
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda k: (F.col("c_custkey") * k % 256).cast("string")
    text = F.concat(F.lit("rgb("), byte(7919), F.lit(","), byte(104729), F.lit(","), byte(1299709), F.lit(")"))
    white = C.rgb(F.lit(255), F.lit(255), F.lit(255))
    found = table(spark, sf_dir, "customer").select("c_custkey", C.parse_colour(text).alias("c"))
    return found.select("c_custkey", C.rgb_to_hex(F.col("c")).alias("hexed"), F.round(C.contrast(F.col("c"), white), 6).alias("on_white"), C.scan_warning(F.col("c"), white).alias("warning"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*:') THEN url ELSE 'https://' || url END AS link FROM pages")
def urlish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.normalize_urlish(F.col("url")).alias("link"))


URLISH = [("example.com", "https://example.com"), (" sub.example.co/x?y#z ", "https://sub.example.co/x?y#z"), ("mailto:a@b", "mailto:a@b"), ("not a link", "not a link"), ("localhost", "localhost"), ("", "")]


@query(f"SELECT source, link FROM {sql_values(URLISH, 'source, link')}")
def urlish_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, URLISH, "source string, l string").select("source", P.normalize_urlish(F.col("source")).alias("link"))


@query(r"""SELECT c_custkey, 'WIFI:S:' || replace(c_name, '#', '#') || ';T:' || CASE WHEN c_nationkey % 3 = 0 THEN 'nopass' ELSE 'WPA;P:' || 'k\;' || c_custkey END || CASE WHEN c_nationkey % 2 = 0 THEN ';H:true' ELSE '' END || ';;' AS payload FROM customer""")
def wifi_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    auth = F.when(F.col("c_nationkey") % 3 == 0, "nopass").otherwise("WPA")
    password = F.concat(F.lit("k;"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.wifi_payload(F.col("c_name"), password, auth, F.col("c_nationkey") % 2 == 0).alias("payload"))


@query("""SELECT s_suppkey, concat_ws(chr(13) || chr(10), 'BEGIN:VCARD', 'VERSION:3.0', 'N:Key ' || s_suppkey || ';' || s_name || ';;;', 'FN:' || s_name || ' Key ' || s_suppkey, 'ORG:A\\, B', 'URL:http://x', 'END:VCARD') AS payload FROM supplier""".replace("'N:Key ' || s_suppkey || ';' || s_name", "'N:' || s_suppkey || ';' || s_name || ' Key'"))
def vcard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("s_name"), F.lit(" Key "), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.vcard_payload(name, F.lit(" A, B"), F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("http://x")).alias("payload"))


@query("SELECT c_custkey, 'mailto:' || c_custkey || '@example.com?subject=' || replace(replace(c_name, ' ', '%20'), '#', '%23') || '&body=a%20%26%20b' AS payload FROM customer")
def email_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.email_payload(to, F.col("c_name"), F.lit("a & b ")).alias("payload"))


PASSWORDS = [("", 0, "Empty"), ("abc", 0, "Too short"), ("abcdefgh", 1, "Weak"), ("abcdefghijk", 1, "Weak"), ("Abcdef12", 2, "Fair"), ("Abcdefgh12", 3, "Good"), ("correct horse battery", 4, "Strong"), ("abcdefghijklmnop", 3, "Good")]


@query(f"SELECT password, score, label FROM {sql_values(PASSWORDS, 'password, score, label')}")
def password_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, PASSWORDS, "password string, s int, l string").select("password", P.password_strength(F.col("password")).alias("s")).select("password", "s.score", "s.label")


PERMISSIONS = [
    ("full", True, True, True, True, "No restrictions — the password is only needed to open the file."), ("none", True, True, True, True, "Readers that honour permissions will block printing."),
    ("low", False, True, True, True, "Readers that honour permissions will block high-quality printing and copying text."),
    ("none", False, False, False, False, "Readers that honour permissions will block printing, copying text, editing, commenting and filling forms."),
]


@query(f"SELECT printing, copying, modifying, said FROM {sql_values(PERMISSIONS, 'printing, copying, modifying, annotating, filling, said')}")
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values(spark, PERMISSIONS, "printing string, copying boolean, modifying boolean, annotating boolean, filling boolean, s string")
    return found.select("printing", "copying", "modifying", P.describe_permissions(*[F.col(c) for c in found.columns[:5]]).alias("said"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * (d + m / 60.0::DOUBLE + s / 3600.0::DOUBLE), 9) AS degrees FROM (SELECT c_custkey, c_acctbal, floor(abs(c_acctbal))::BIGINT % 90 AS d, c_custkey % 60 AS m, (c_custkey * 7) % 60 AS s FROM customer)")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.media import dms_to_degrees

    pair = lambda n: F.struct(n.cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    dms = F.array(pair(F.floor(F.abs("c_acctbal")) % 90), pair(F.col("c_custkey") % 60), pair(F.col("c_custkey") * 7 % 60))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(dms_to_degrees(dms, F.when(F.col("c_acctbal") < 0, "S").otherwise("N")), 9).alias("degrees"))


@query("SELECT p_partkey, p_size * 12700 AS emu, greatest(2, floor(p_size / 3.0::DOUBLE * 2 + 0.5)::BIGINT) AS half_points, p_retailprice * 1.0 / 20 AS points FROM part")
def office_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions import media as M

    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", M.emu(size).cast("int").alias("emu"), M.half_points(size / 3).alias("half_points"), M.twips_to_points(F.col("p_retailprice")).alias("points"))


@query("""WITH s AS (SELECT source, count(*) AS n, min('doc ' || lpad(doc_id::VARCHAR, 9, '0')) AS name, min(lang) AS lo, max(lang) AS hi FROM documents WHERE n_chars > 6000 GROUP BY source)
SELECT source, CASE WHEN n = 1 THEN name || ' was skipped — ' || lo || '.' ELSE n || ' files were skipped' || CASE WHEN lo = hi THEN ' — ' || lo ELSE '' END || '.' END AS said FROM s""")
def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.reports import describe_rejections

    large = table(spark, sf_dir, "documents").where("n_chars > 6000").select("source", F.concat(F.lit("doc "), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), F.col("lang").alias("reason"))
    return describe_rejections(large, "source")


REPORTS = [
    (1000, 400, 2, True, "Recompressed 2 images — 60% smaller. Text and vectors are untouched. Left alone: 1 no gain, 3 transparency."), (1000, 1000, 1, True, "Recompressed 1 image — the same size. Text and vectors are untouched. Left alone: 1 no gain, 3 transparency."),
    (1000, 1500, 1, False, "Flattened 1 page to images — 50% larger. Text is no longer selectable."),
]


@query(f"SELECT before, after, said FROM {sql_values(REPORTS, 'before, after, touched, kept, said')}")
def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.reports import describe_compression

    found = values(spark, REPORTS, "before long, after long, touched int, kept boolean, s string")
    skipped = F.create_map(F.lit("transparency"), F.lit(3), F.lit("no gain"), F.lit(1), F.lit("not a JPEG"), F.lit(0))
    return found.select("before", "after", describe_compression(F.col("before"), F.col("after"), F.col("touched"), skipped, F.col("kept")).alias("said"))


ESTIMATES = [(100000, 50000, 3, False, "49 kB · about 50% smaller"), (100000, 50000, 9, True, "≈ 49 kB · about 50% smaller"), (1000, 2000, 1, False, "2.0 kB — no smaller than the original."), (1000, 1000, 0, False, "Nothing here can be recompressed at this setting.")]


@query(f"SELECT before, after, said FROM {sql_values(ESTIMATES, 'before, after, touched, sampled, said')}")
def estimate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.reports import describe_estimate

    found = values(spark, ESTIMATES, "before long, after long, touched int, sampled boolean, s string")
    return found.select("before", "after", describe_estimate(F.col("before"), F.col("after"), F.col("touched"), F.col("sampled")).alias("said"))


@query("""SELECT p_partkey, round((sw - w * s) / 2, 6) AS x, round((sh - h * s) / 2, 6) AS y, round(w * s, 6) AS width, round(h * s, 6) AS height FROM (
SELECT *, least((sw - 40) / w, (sh - 40) / h) AS s FROM (SELECT p_partkey, w, h, CASE WHEN w > h THEN 841.89 ELSE 595.28 END::DOUBLE AS sw, CASE WHEN w > h THEN 595.28 ELSE 841.89 END::DOUBLE AS sh FROM
  (SELECT p_partkey, (p_size * 97)::DOUBLE AS w, floor(p_retailprice * 2)::DOUBLE AS h FROM part)))""")
def page_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.media import place_on_page

    found = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("double").alias("w"), F.floor(F.col("p_retailprice") * 2).cast("double").alias("h"))
    placed = found.select("p_partkey", place_on_page(F.col("w"), F.col("h"), margin=20.0).alias("p"))
    return placed.select("p_partkey", *[F.round(f"p.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


@query("""SELECT p_partkey, (ceil(w * 4) * ceil(h * 4))::BIGINT AS pixels, ceil(w * 4) * ceil(h * 4) > 40000000 AS skipped, greatest(0.1, floor(sqrt(40000000.0::DOUBLE / (w * h)) * 10) / 10) AS safe_scale
FROM (SELECT p_partkey, (p_size * 97)::DOUBLE AS w, p_retailprice AS h FROM part)""")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.media import render_plan as plan

    return table(spark, sf_dir, "part").select("p_partkey", plan((F.col("p_size") * 97).cast("double"), F.col("p_retailprice"), 4.0).alias("p")).select("p_partkey", "p.*")


UNITS = [("ff0080", 1.0, 0.0, 0.501960784), ("auto", None, None, None), ("FFF", None, None, None), ("000000", 0.0, 0.0, 0.0)]


@query(f"SELECT source, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM {sql_values(UNITS, 'source, r, g, b')}")
def unit_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.media import hex_to_unit

    found = values(spark, UNITS, "source string, r double, g double, b double").select("source", hex_to_unit(F.col("source")).alias("c"))
    return found.select("source", *[F.round(f"c.{x}", 9).alias(x) for x in "rgb"])


@query("""WITH k AS (SELECT p_partkey, p_brand || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE p_type END AS w, p_partkey % 50 = 0 AS none FROM part),
n AS (SELECT p_partkey, CASE WHEN none THEN '' ELSE w END AS w FROM k),
c AS (SELECT p_partkey, w, length(w) AS n, (regexp_matches(w, '[a-z]')::INT + regexp_matches(w, '[A-Z]')::INT + regexp_matches(w, '[0-9]')::INT + regexp_matches(w, '[^A-Za-z0-9]')::INT) AS kinds FROM n),
b AS (SELECT *, CASE WHEN n >= 20 THEN 4 WHEN n >= 14 THEN 3 WHEN n >= 10 THEN 2 ELSE 1 END AS s FROM c),
f AS (SELECT *, CASE WHEN n < 6 THEN 0 WHEN kinds >= 3 AND s < 4 THEN s + 1 WHEN kinds = 1 AND n < 16 AND s > 1 THEN s - 1 ELSE s END AS score FROM b)
SELECT p_partkey, score, CASE WHEN n = 0 THEN 'Anyone can open the file.' WHEN n < 6 THEN 'Use at least 8 characters.' ELSE
['Trivially guessable.', 'Add length — a short phrase beats a mangled word.', 'More length helps more than more symbols.', 'A few more words would make it strong.', 'Store it somewhere you will not lose it.'][score + 1] END AS hint FROM f""")
def password_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.col("p_type"))
    word = F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.concat("p_brand", tail))
    return parts.select("p_partkey", P.password_strength(word).alias("s")).select("p_partkey", "s.score", "s.hint")


@query("""SELECT p_partkey, mime, e.label, coalesce(e.lossy, false) AS lossy, e.mime IS NOT NULL AS known
FROM (SELECT p_partkey, ['image/png', 'image/jpeg', 'image/webp', 'image/gif', 'toString'][1 + p_partkey % 5] AS mime FROM part)
LEFT JOIN (VALUES ('image/png', 'PNG', false), ('image/jpeg', 'JPEG', true), ('image/webp', 'WebP', true)) AS e(mime, label, lossy) USING (mime)""")
def encode_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions import files

    kinds = F.array(*map(F.lit, ("image/png", "image/jpeg", "image/webp", "image/gif", "toString")))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("mime"))
    known = parts.join(F.broadcast(files.encode_types(spark)), "mime", "left")
    return known.select("p_partkey", "mime", "label", F.coalesce("lossy", F.lit(False)).alias("lossy"), files.is_encode_type(F.col("mime")).alias("known"))


@query("""WITH k AS (SELECT p_partkey AS k, 1 + p_partkey % 3 AS pages, p_size AS blocks, p_partkey % 2 = 0 AS metric, p_partkey % 4 AS styled, p_partkey % 5 = 0 AS sized, p_partkey % 3 AS links, p_partkey % 7 = 0 AS arabic FROM part)
SELECT k AS p_partkey, concat_ws(' ', pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END || ' from ' || blocks || ' blocks.', 'Text is selectable and searchable.',
CASE WHEN arabic THEN 'Arabic, Thai rendered with an embedded font for that script.' END, CASE WHEN arabic THEN 'Right-to-left text is shaped and reordered for display.' END,
CASE WHEN pages = 3 THEN 'Could not load a font for Tamil, so that text became "?".' END,
CASE WHEN styled = 1 THEN '1 character could not be drawn (☃) and became "?" — ' || CASE WHEN metric THEN 'no embedded font covers them.' ELSE 'the font files could not be loaded, so the built-in fonts were used and those cover Latin only.' END
     WHEN styled = 2 THEN '7 characters could not be drawn (a b c d e f) and became "?" — ' || CASE WHEN metric THEN 'no embedded font covers them.' ELSE 'the font files could not be loaded, so the built-in fonts were used and those cover Latin only.' END END,
CASE WHEN NOT metric THEN 'Line breaks may differ from Word: the metric-compatible fonts did not load.' END,
CASE WHEN styled > 0 THEN 'Alignment, sizes, indents and tab stops recovered for ' || styled || CASE WHEN styled = 1 THEN ' paragraph.' ELSE ' paragraphs.' END END,
CASE WHEN sized THEN 'Page size taken from the document (595x842 pt).' END, CASE WHEN links > 0 THEN links || CASE WHEN links = 1 THEN ' link' ELSE ' links' END || ' stayed clickable.' END,
CASE WHEN links = 2 THEN '1 image in an unsupported format were left out.' END) AS said FROM k""")
def printing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions import reports

    k = F.col("p_partkey")
    words = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    missing = F.when(k % 4 == 1, F.array(F.lit("☃"))).otherwise(words(k % 4 == 2, *"abcdefg"))
    sized = lambda x: F.when(k % 5 == 0, F.lit(x))
    said = reports.describe_printing(1 + k % 3, F.col("p_size"), words(k % 7 == 0, "Arabic", "Thai"), words(k % 3 == 2, "Tamil"), k % 7 == 0, missing, k % 2 == 0, k % 4, sized(595.28), sized(841.89), k % 3, F.when(k % 3 == 2, 1).otherwise(0))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))
