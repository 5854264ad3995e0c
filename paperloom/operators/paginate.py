"""Blocks to drawn items, a document at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.operators import paginate_kernel as K

ITEM = "struct<page:int,kind:string,x:double,y:double,width:double,height:double,text:string,size:double,pieces:array<struct<text:string,x:double,width:double,size:double,rise:double,script:string>>>"
_piece = pa.struct([("text", pa.string()), ("x", pa.float64()), ("width", pa.float64()), ("size", pa.float64()), ("rise", pa.float64()), ("script", pa.string())])
_item = pa.struct([("page", pa.int32()), ("kind", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "width", "height")], ("text", pa.string()), ("size", pa.float64()), ("pieces", pa.list_(_piece))])


def _flat(pages: list[list[dict]]) -> list[dict]:
    out = []
    for n, items in enumerate(pages):
        for d in items:
            row = {"page": n, "kind": d["kind"], "x": d["x"], "y": d["y"], "width": d.get("width"), "height": d.get("height")}
            if line := d.get("line"):
                row |= {"width": line.width, "height": line.height, "size": line.size, "text": "".join(p.text for p in line.pieces)}
                row["pieces"] = [{"text": p.text, "x": p.x, "width": p.width, "size": p.size, "rise": p.rise, "script": p.script} for p in line.pieces]
            out.append(row)
    return out


def drawn(blocks: Column, measure: K.Measure = K.half_em, **options) -> Column:
    """Items of every page from an array of blocks as the markup and package readers give them."""

    @F.arrow_udf(f"array<{ITEM}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            yield pa.array([None if d is None else _flat(K.paginate(d, measure=measure, **options)) for d in documents.to_pylist()], pa.list_(_item))

    return run.asNondeterministic()(blocks)


def pdf(blocks: Column, geometry: tuple = K.A4, **options) -> Column:
    """A PDF file of an array of blocks, with selectable text in Helvetica."""
    from paperloom.operators import pdf_kernel as P

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            pages = [None if d is None else K.paginate(d, geometry, P.helvetica, **options) for d in documents.to_pylist()]
            yield pa.array([None if p is None else P.draw(p, *geometry[:2]) for p in pages], pa.binary())

    return run.asNondeterministic()(blocks)


def encryption(content: Column) -> Column:
    """none, owner-only, user-password or unknown for a PDF file."""
    from paperloom.operators import pdf_kernel as P

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            yield pa.array([None if f is None else P.encryption(f) for f in (x.as_py() for x in files)], pa.string())

    return run(content)
