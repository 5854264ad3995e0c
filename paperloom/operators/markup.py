"""Markup columns to block tables, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import markup_kernel as K
from paperloom.plans.workspace import ship

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,script:string,href:string,anchor:string>"
BLOCK = f"struct<kind:string,level:int,ordered:boolean,marker:string,runs:array<{RUN}>,rows:array<array<struct<runs:array<{RUN}>,span:int,row_span:int>>>,data_uri:string,text:string>"
_run = pa.struct([("text", pa.string()), *[(k, pa.bool_()) for k in ("bold", "italic", "underline", "strike")], *[(k, pa.string()) for k in ("script", "href", "anchor")]])
_cell = pa.struct([("runs", pa.list_(_run)), ("span", pa.int32()), ("row_span", pa.int32())])
_block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("ordered", pa.bool_()), ("marker", pa.string()), ("runs", pa.list_(_run)), ("rows", pa.list_(pa.list_(_cell))), ("data_uri", pa.string()), ("text", pa.string())])


def blocks(html: Column) -> Column:
    """An array of blocks; null and empty markup have none."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([[b | {"text": K.block_text(b)} for b in K.parse_blocks(h)] for h in pages.to_pylist()], pa.list_(_block))

    return parse.asNondeterministic()(html)


def exploded(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, block fields)."""
    ship(df.sparkSession)
    return df.select(key, F.posexplode(blocks(F.col(html))).alias("seq", "b")).select(key, "seq", "b.*")


def face_needs(blocks_: DataFrame, key: str) -> DataFrame:
    """(key, bold, italic, both, scripts): which faces a document's runs call for."""
    from paperloom.functions.text import scripts_in

    runs = blocks_.select(key, F.explode_outer("runs").alias("r")).select(key, "r.*")
    return runs.groupBy(key).agg(
        F.coalesce(F.bool_or("bold"), F.lit(False)).alias("bold"), F.coalesce(F.bool_or("italic"), F.lit(False)).alias("italic"), F.coalesce(F.bool_or(F.col("bold") & F.col("italic")), F.lit(False)).alias("both"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(scripts_in(F.coalesce("text", F.lit(""))))))), ",").alias("scripts"),
    )
