"""QR codes of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.operators import qr_kernel as K

MATRIX = "struct<size:int,version:int,data:binary,svg:string,error:string>"
_type = pa.struct([("size", pa.int32()), ("version", pa.int32()), ("data", pa.binary()), ("svg", pa.string()), ("error", pa.string())])


def qr(text: Column, level: str = "M", **style) -> Column:
    """Size, version, modules row by row and SVG; empty and overlong texts have an error instead."""

    def one(t: str | None) -> dict:
        try:
            version, rows = K.build(t or "", level)
        except ValueError as error:
            return {"error": str(error)}
        return {"size": len(rows), "version": version, "data": bytes(v for r in rows for v in r), "svg": K.svg(rows, **style)}

    @F.arrow_udf(MATRIX)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(t) for t in texts.to_pylist()], _type)

    return run.asNondeterministic()(text)


def is_dark(matrix: Column, row: Column, column: Column) -> Column:
    return F.substring(F.hex(matrix["data"]), 2 * (row * matrix["size"] + column) + 2, F.lit(1)) == "1"
