"""Documents from positioned text: lines, furniture, blocks, warnings.

Two passes, as furniture needs all pages: lines per page in Arrow batches; furniture by aggregation and a join; then
blocks per page. A page is one group, so work is spread by page whatever a document's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.operators import infer_kernel as K
from paperloom.operators.furniture import furniture
from paperloom.plans.workspace import parts_of, ship

SPAN = "struct<text:string,size:double,x:double,width:double,bold:boolean,italic:boolean,mono:boolean,family:string>"
LINES = f"doc_id long, page int, line int, text string, x double, right double, y double, size double, spans array<{SPAN}>"
BLOCKS = f"doc_id long, page int, seq int, kind string, level int, marker string, indent int, depth int, text string, spans array<{SPAN}>, cells array<array<string>>"
LINE_NAMES = ("doc_id", "page", "line", "text", "x", "right", "y", "size", "spans")
BLOCK_NAMES = ("doc_id", "page", "seq", "kind", "level", "marker", "indent", "depth", "text", "spans", "cells")
#: Rows of a batch that a task gives out.
ROWS = 2000


def normalise_items(df: DataFrame) -> DataFrame:
    """Raw runs (transform of six numbers, height) to items: x, y and the size that the transform gives."""
    a, b = F.get("transform", F.lit(0)), F.get("transform", F.lit(1))
    size = F.coalesce(F.nullif(F.hypot(a, b), F.lit(0.0)), F.nullif("height", F.lit(0.0)), F.lit(11.0))
    return df.withColumns({"x": F.get("transform", F.lit(4)), "y": F.get("transform", F.lit(5)), "size": size}).drop("transform", "height")


def _by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """(doc_id, page) and the rows of each page, from batches of whole sorted pages laid end to end."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["doc_id"], row["page"])
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _paged(df: DataFrame, order: str, work: Callable[[tuple, list[dict]], list[dict]], schema: str) -> DataFrame:
    """``work`` over each page's rows in order: pages are dealt out whole, and many share a task and a batch."""
    ship(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        out: list[dict] = []
        for key, rows in _by_page(batches):
            out += work(key, rows)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    dealt = df.repartition(parts_of(df.sparkSession), "doc_id", "page").sortWithinPartitions("doc_id", "page", order)
    return dealt.mapInArrow(run, schema)


def lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text, x, y, width, size, font) to lines."""

    def work(key, rows):
        found = K.lines_of([tuple(r[c] for c in ("text", "x", "y", "width", "size", "font")) for r in rows])
        return [dict(zip(LINE_NAMES, (*key, i, K.text_of(n), n.x, n.right, n.y, n.size, [asdict(s) for s in n.spans]), strict=True)) for i, n in enumerate(found)]

    return _paged(items, "seq", work, LINES)


def blocks(page_lines: DataFrame) -> DataFrame:
    """Lines to blocks in reading order; tables have cells, all have text."""

    def work(key, rows):
        found = [K.Line([K.Span(**s) for s in r["spans"]], r["x"], r["right"], r["y"], r["size"]) for r in rows]
        cells = lambda b: None if b.rows is None else [["".join(s.text for s in c) for c in row] for row in b.rows]
        return [dict(zip(BLOCK_NAMES, (*key, i, b.kind, b.level, b.marker, b.indent, b.depth, K.as_text(b), [asdict(s) for s in b.spans], cells(b)), strict=True)) for i, b in enumerate(K.blocks_of(found))]

    return _paged(page_lines, "line", work, BLOCKS)


def documents(items: DataFrame, pages: DataFrame, keep_furniture: bool = False) -> DataFrame:
    """Items and page geometry (doc_id, page, width, height) to blocks, without running headers and footers."""
    found = lines(items)
    if not keep_furniture:
        placed = furniture(found.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]))
        found = placed.where(~F.col("is_furniture")).drop("is_furniture", "height")
    return blocks(found)


def flatten_table(cells: str = "cells"):
    """A table as text: cells by tabs, rows by line feeds."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, "\t")), "\n")


def describe(found: DataFrame) -> DataFrame:
    """(doc_id, said): what was recovered, in one sentence."""
    from paperloom.functions.reports import describe_recovery

    counts = found.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("heading", "paragraph", "list", "table")], F.count_distinct("page").alias("pages"))
    return describe_recovery(counts)
