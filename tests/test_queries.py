"""Every query against its SQL at the smallest scale, and the plans that matter."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.registry.queries()]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def shown(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.registry.oracle_sql().get(name)
    if not sql:
        assert rows is not None
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in order) for r in rows) == sorted(tuple(shown(r[names.index(c)]) for c in order) for r in found.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.registry.queries()["line_stats"](spark, SF))
    assert "Exchange" not in text and "lang" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "Exchange" not in plan(entry.registry.queries()["html_tags"](spark, SF))
    assert plan(entry.registry.queries()["image_walk"](spark, SF)).count("ArrowEvalPython") == 1


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_files_and_parts(spark, tmp_path):
    from pyspark.sql import functions as F

    from paperloom.operators import office_kernel as O
    from paperloom.sources import files, parts

    package = O.package(O.build([]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(package)
    (tmp_path / "in" / "b.txt").write_bytes(b"x\r\ny\n")
    found = files.read_files(spark, str(tmp_path / "in"), most_bytes=1 << 20)
    assert {r["kind"] for r in found.collect()} == {"docx", None}
    assert [r["lines"] for r in files.read_texts(spark, str(tmp_path / "in" / "b.txt")).collect()] == [["x", "y"]]
    refused = files.read_texts(spark, str(tmp_path / "in"), most_bytes=10).orderBy("path").collect()
    assert [(r["path"][-5:], r["text"], r["reason"]) for r in refused] == [(".docx"[-5:], None, "larger than 10 B"), ("b.txt", "x\r\ny\n", None)]
    read = lambda: parts.read_parts(spark, f"file://{tmp_path}/in")
    assert read().where("part = 'word/document.xml'").count() == 1 and read().count() == 6
    out = spark.createDataFrame([("one.bin", bytearray(b"1")), ("two.bin", bytearray(b"22"))], "name string, content binary")
    parts.write_files(out, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.bin", "two.bin"]
    again = found.where("kind = 'docx'").select(F.lit(1).alias("b"), F.lit("a.docx").alias("n"), "content", F.lit(0).alias("o"))
    from paperloom.operators.office import zip_batch

    assert zip_batch(again, "b", "n", "content", "o").count() == 1


def test_lines_stream(spark, tmp_path):
    from paperloom.streaming import stream_lines

    (tmp_path / "f.txt").write_text("a\nb\n")
    run = stream_lines(spark, str(tmp_path)).writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["line"] for r in spark.table("lines").collect()) == ["a", "b"]


def test_furniture_and_columns(spark):
    from paperloom.operators.furniture import furniture, multi_column

    rows = [(1, p, t, 64.0, y, r, 800.0) for p in range(3) for t, y, r in ((f"Page {p}", 20.0, 100.0), ("Chapter", 780.0, 120.0), ("body text", 400.0, 500.0), (f"only {'x' * p}", 790.0, 110.0))]
    found = furniture(spark.createDataFrame(rows, "doc_id long, page int, text string, x double, y double, right double, height double"))
    assert {r["text"] for r in found.where("is_furniture").collect()} == {"Page 0", "Page 1", "Page 2", "Chapter"}
    two = [(1, 0, x, x + 200, [], 600.0) for x in (64.0, 330.0) for _ in range(7)]
    schema = "doc_id long, page int, x double, right double, gaps array<struct<start:double,end:double>>, width double"
    assert multi_column(spark.createDataFrame(two, schema)).first()["multi_column"]
    assert not multi_column(spark.createDataFrame(two[:5], schema)).first()["multi_column"]


def test_sitemaps_hold_every_address(spark):
    import re

    from paperloom.operators import catalogue

    paths = spark.createDataFrame([(f"/p{i:03}", "0.8" if i % 3 else "0.9") for i in range(250)] + [("/", "1.0")], "path string, priority string")
    whole = catalogue.sitemap_xml(paths, "https://x.org", "2026-01-01").collect()
    assert len(whole) == 1 and whole[0]["xml"].count("<loc>") == 251 and whole[0]["xml"].index("org/</loc>") < whole[0]["xml"].index("/p000") < whole[0]["xml"].index("/p001")
    several = catalogue.sitemap_xml(paths, "https://x.org", "2026-01-01", most=40)
    found = several.orderBy("number").collect()
    places = [p for r in found for p in re.findall("<loc>https://x.org(.*?)</loc>", r["xml"])]
    assert max(r["xml"].count("<loc>") for r in found) <= 40 and [r["number"] for r in found] == list(range(len(found)))
    assert places == re.findall("<loc>https://x.org(.*?)</loc>", whole[0]["xml"])
    index = catalogue.sitemap_index(several, "https://x.org", "2026-01-01").collect()
    assert len(index) == 1 and index[0]["xml"].count("<sitemap>") == len(found) and "sitemap-0.xml" in index[0]["xml"]
    assert catalogue.sitemap_xml(paths.limit(0), "https://x.org", "2026-01-01").count() == 1
