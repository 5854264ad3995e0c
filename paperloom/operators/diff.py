"""Comparison of two text columns: edits, side-by-side rows with counts, patches.

The search for a shortest script is sequential, so it runs in Arrow batches of Python; what comes before and after is
column expressions. The functions are marked non-deterministic: otherwise the optimizer would run them once more for a
filter that it infers below ``inline``. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import diff_kernel as K
from paperloom.plans.workspace import ship

EDITS = "struct<edits: array<struct<op: string, a: int, b: int>>, truncated: boolean>"
ROWS = "struct<rows: array<struct<op: string, a: int, b: int>>, added: int, removed: int, changed: int, unchanged: int, similarity: double, identical: boolean, truncated: boolean>"
WORDS = "struct<left: array<struct<text: string, op: string>>, right: array<struct<text: string, op: string>>>"


def _over_pairs(kind: str, work):
    """An Arrow function of two text columns that gives one value a row."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([work(a or "", b or "") for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], TYPES[kind])

    return run.asNondeterministic()


_edit = pa.list_(pa.struct([("op", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
_side = pa.list_(pa.struct([("text", pa.string()), ("op", pa.string())]))
TYPES = {
    EDITS: pa.struct([("edits", _edit), ("truncated", pa.bool_())]), "string": pa.string(), WORDS: pa.struct([("left", _side), ("right", _side)]),
    ROWS: pa.struct([("rows", _edit), *[(c, pa.int32()) for c in ("added", "removed", "changed", "unchanged")], ("similarity", pa.float64()), ("identical", pa.bool_()), ("truncated", pa.bool_())]),
}


def _named(edits: list) -> list[dict]:
    return [{"op": op, "a": a, "b": b} for op, a, b in edits]


def line_edits(left: Column, right: Column, **options) -> Column:
    def work(a: str, b: str) -> dict:
        edits, gave_up = K.line_edits(K.lines_of(a), K.lines_of(b), **options)
        return {"edits": _named(edits), "truncated": gave_up}

    return _over_pairs(EDITS, work)(left, right)


def compare(left: Column, right: Column, **options) -> Column:
    def work(a: str, b: str) -> dict:
        found = K.compare(a, b, **options)
        return found | {"rows": _named(found["rows"])}

    return _over_pairs(ROWS, work)(left, right)


def word_segments(left: Column, right: Column, **options) -> Column:
    def work(a: str, b: str) -> dict:
        sides = K.word_segments(a, b, **options)
        return {name: [{"text": t, "op": o} for t, o in side] for name, side in zip(("left", "right"), sides, strict=True)}

    return _over_pairs(WORDS, work)(left, right)


def unified_patch(left: Column, right: Column, **options) -> Column:
    return _over_pairs("string", lambda a, b: K.unified(a, b, **options))(left, right)


def hunks(patch: Column) -> Column:
    return F.regexp_count(patch, F.lit("(?m)^@@ "))


def exploded_edits(df: DataFrame, pair: str, left: str, right: str, **options) -> DataFrame:
    """(pair, seq, op, a, b)."""
    ship(df.sparkSession)
    found = df.select(pair, line_edits(F.col(left), F.col(right), **options)["edits"].alias("edits"))
    return found.select(pair, F.posexplode("edits").alias("seq", "e")).select(pair, "seq", "e.*")


def pair_changes(edits: DataFrame, pair: str) -> DataFrame:
    """(pair, a, b): the k-th deletion of a run with the k-th insertion of the run right after it, by windows over exploded edits."""
    from pyspark.sql import Window as W

    w = W.partitionBy(pair).orderBy("seq")
    starts = F.coalesce((F.lag("op").over(w) != F.col("op")).cast("int"), F.lit(1))
    runs = edits.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    placed = runs.withColumn("k", F.row_number().over(W.partitionBy(pair, "run").orderBy("seq")))
    gone = placed.where("op = 'delete'").select(pair, "run", "k", "a")
    come = placed.where("op = 'insert'").select(pair, (F.col("run") - 1).alias("run"), "k", "b")
    return gone.join(come, [pair, "run", "k"]).select(pair, "a", "b")
