"""Image metadata over a binary column: walk, report, removal. One bad file gives warnings, never a failed job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import imgmeta_kernel as K
from paperloom.plans.workspace import ship

_segment = pa.struct([("kind", pa.string()), ("where", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("payload_start", pa.int64()), ("payload_end", pa.int64()), ("keyword", pa.string())])
_field = pa.struct([("source", pa.string()), ("label", pa.string()), ("value", pa.string()), ("group", pa.string()), ("sensitive", pa.bool_())])
_block = pa.struct([("kind", pa.string()), ("where", pa.string()), ("bytes", pa.int64()), ("category", pa.string()), ("keyword", pa.string())])
_removed = pa.struct([("where", pa.string()), ("kind", pa.string()), ("bytes", pa.int64())])
WALK = "struct<container:string,rewritable:boolean,segments:array<struct<kind:string,where:string,start:bigint,end:bigint,payload_start:bigint,payload_end:bigint,keyword:string>>,warnings:array<string>>"
REPORT = (
    "struct<container:string,rewritable:boolean,blocks:array<struct<kind:string,where:string,bytes:bigint,category:string,keyword:string>>,fields:array<struct<source:string,label:string,value:string,group:string,"
    "sensitive:boolean>>,latitude:double,longitude:double,orientation:int,thumbnail_bytes:bigint,metadata_bytes:bigint,file_bytes:bigint,warnings:array<string>,said:string>"
)
STRIPPED = "struct<ok:boolean,reason:string,content:binary,removed:array<struct<where:string,kind:string,bytes:bigint>>,bytes_removed:bigint,orientation:int,warnings:array<string>,pixels_kept:boolean>"
TYPES = {
    WALK: pa.struct([("container", pa.string()), ("rewritable", pa.bool_()), ("segments", pa.list_(_segment)), ("warnings", pa.list_(pa.string()))]),
    REPORT: pa.struct([
        ("container", pa.string()), ("rewritable", pa.bool_()), ("blocks", pa.list_(_block)), ("fields", pa.list_(_field)), ("latitude", pa.float64()), ("longitude", pa.float64()), ("orientation", pa.int32()),
        ("thumbnail_bytes", pa.int64()), ("metadata_bytes", pa.int64()), ("file_bytes", pa.int64()), ("warnings", pa.list_(pa.string())), ("said", pa.string()),
    ]),
    STRIPPED: pa.struct([
        ("ok", pa.bool_()), ("reason", pa.string()), ("content", pa.binary()), ("removed", pa.list_(_removed)), ("bytes_removed", pa.int64()), ("orientation", pa.int32()), ("warnings", pa.list_(pa.string())),
        ("pixels_kept", pa.bool_()),
    ]),
}


def _over_files(kind: str, work):
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            yield pa.array([None if f is None else work(f) for f in (x.as_py() for x in files)], TYPES[kind])

    return run.asNondeterministic()


def _walk(data: bytes) -> dict | None:
    found = K.walk(data)
    return found and {"container": found.container, "rewritable": found.rewritable, "segments": [s._asdict() for s in found.segments], "warnings": found.warnings}


def _report(data: bytes) -> dict:
    found = K.read(data)
    place, thumb = found["coordinates"] or (None, None), found["thumbnail"]
    return found | {"latitude": place[0], "longitude": place[1], "thumbnail_bytes": thumb and thumb[1], "said": K.describe(found)}


def walk(content: Column) -> Column:
    return _over_files(WALK, _walk)(content)


def report(content: Column) -> Column:
    return _over_files(REPORT, _report)(content)


def strip(content: Column, remove: tuple[str, ...] = K.REMOVED, keep_orientation: bool = True) -> Column:
    def work(data: bytes) -> dict:
        found = K.strip(data, remove, keep_orientation)
        return found | {"pixels_kept": K.pixels(data) == K.pixels(found["content"]) if found["ok"] else None}

    return _over_files(STRIPPED, work)(content)


def metadata_fields(files: DataFrame, key: str = "path", content: str = "content", most: int | None = None) -> DataFrame:
    """(key, source, label, value, group, sensitive). ``most``: files over so many bytes are left out before their content is read."""
    ship(files.sparkSession)
    small = files if most is None else files.where(F.col("length") <= most)
    return small.select(key, F.inline(report(F.col(content))["fields"]))


def tag_registry(spark) -> DataFrame:
    """(ifd, tag, label, group, sensitive, pointer): a dimension small enough to broadcast."""
    rows = [(ifd, tag, label, group, sensitive, False) for ifd, tags in K.TAGS.items() for tag, (label, group, sensitive) in tags.items()]
    rows += [(ifd, tag, None, None, None, True) for tag, (ifd, _) in K.POINTERS.items()] + [("ifd1", tag, None, None, None, True) for tag in K.THUMBNAIL]
    return spark.createDataFrame(rows, "ifd string, tag int, label string, group string, sensitive boolean, pointer boolean")


def with_tag_info(entries: DataFrame) -> DataFrame:
    """Entries (ifd, tag, …) with what is known of their tags. Unknown tags count as sensitive, pointers are left out."""
    known = tag_registry(entries.sparkSession)
    joined = entries.join(F.broadcast(known), ["ifd", "tag"], "left").where(~F.coalesce("pointer", F.lit(False))).drop("pointer")
    named = F.coalesce("label", F.concat(F.lit("Tag 0x"), F.lower(F.lpad(F.hex("tag"), 4, "0"))))
    return joined.withColumns({"label": named, "group": F.coalesce("group", F.lit("technical")), "sensitive": F.coalesce("sensitive", F.lit(True))})


def summarise(fields: DataFrame, key: str = "path") -> DataFrame:
    """(key, total, sensitive, groups) of exploded fields."""
    sums = fields.groupBy(key).agg(F.count("*").alias("total"), F.count_if("sensitive").alias("sensitive"), F.array_sort(F.collect_set("group")).alias("groups"))
    return sums.withColumn("groups", F.array_join("groups", ","))
