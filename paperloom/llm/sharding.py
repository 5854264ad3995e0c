"""Sharding by sampled splitters.

1. Rows get a key, the 64-bit hash of their text, so that equal texts stand together, and a size in bytes. Their order is
   by (key, id, place in the table), so no two rows tie.
2. A sample of rows, drawn with a probability in proportion to size by a hash, gives weighted quantiles of that order:
   the splitters of fine ranges of nearly equal bytes, ``RANGES_PER_SHARD`` to a shard. A splitter keeps equal texts
   together, unless their key is the quantile several times over: such a group is cut by id and place.
3. Exact bytes and rows of each range are counted. A range of more than twice its share, its largest row left aside, is
   subdivided by splitters sampled from that range alone, and at its first row if those don't cut it, until none is left.
4. Ranges are laid end to end and cut at the shards' quantiles of bytes: a record's shard and its slot within it follow
   from its range and its rank there, so no task ever holds a shard. The driver holds ``SAMPLE_PER_RANGE`` rows and a count
   of each range, whose number doesn't grow with the table.

Defined results: null texts have size 1 (no bytes, plus 1) and the checksum of an empty text; null ids sort first; texts of
any length count whole and aren't shuffled; repeated rows take slots of their own, in different shards if there are many;
an empty table gives an empty result; other columns, whatever their names, are not read. Shards' bytes differ by no more
than four ranges and the largest record.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.plans.workspace import discard, save, ship

RANGES_PER_SHARD, SAMPLE_PER_RANGE = 256, 24
SEED = 9
#: What rows are ordered by.
ORDER = ("key", "tie", "uid")
TOP = np.iinfo(np.int64).max


def _sample(rows: DataFrame, wanted: int, total: int, seed: int) -> list[tuple]:
    """((key, tie, uid), weight), sorted; each row with a probability of size * wanted / total, at most 1."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "uid"), 12) + 0.5) / F.lit(float(2**52))
    picked = rows.where(draw < chance).select(*ORDER, (F.col("size") / chance).alias("weight"))
    return sorted((tuple(r[c] for c in ORDER), r["weight"]) for r in picked.collect())


def _quantiles(sample: list[tuple], ranges: int) -> list[tuple]:
    """Distinct (key, tie, uid) that end each range but the last."""
    if not sample:
        return []
    run = np.cumsum([w for _, w in sample])
    at = np.searchsorted(run, run[-1] * np.arange(1, ranges) / ranges)
    keys = [sample[i][0][0] for i in at]
    often = {k for i, k in enumerate(keys[1:]) if k == keys[i]}
    return sorted({sample[i][0] if sample[i][0][0] in often else (sample[i][0][0], TOP, TOP) for i in at})


def _below(splitters: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """How many splitters, sorted by their columns, stand below each row of values."""
    low = np.searchsorted(splitters[0], values[0], "left")
    out = low.astype(np.int64)
    if len(splitters) > 1:
        high = np.searchsorted(splitters[0], values[0], "right")
        tied = np.flatnonzero(high > low)
        for at in np.unique(low[tied]).tolist():
            rows = tied[low[tied] == at]
            stop = int(high[rows[0]])
            out[rows] += _below([c[at:stop] for c in splitters[1:]], [v[rows] for v in values[1:]])
    return out


def _with_range(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Adds ``part``, the number of splitters below a row."""
    columns = [np.array([s[i] for s in splitters], np.int64) for i in range(len(ORDER))]

    def place(batches):
        for batch in batches:
            part = _below(columns, [batch.column(i).to_numpy() for i in range(len(ORDER))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    first = [*ORDER, *[c for c in rows.columns if c not in (*ORDER, "part")]]
    kinds = dict(rows.dtypes)
    return rows.select(first).mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in first) + ", part long")


def _counted(rows: DataFrame) -> dict[int, tuple]:
    """Range to (bytes, rows, bytes of the largest row, first row)."""
    found = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest"), F.min(F.struct(*ORDER)).alias("first"))
    return {r["part"]: (r["bytes"], r["n"], r["largest"], tuple(r["first"])) for r in found.collect()}


def shard(df: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id", ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, range."""
    ship(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = save(
        df.select(
            F.col(id_col).cast("long").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("key"), F.monotonically_increasing_id().alias("uid"),
        ).withColumn("tie", F.coalesce("id", F.lit(-(2**63)))), "rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(n, shards * ranges_per_shard))
    share = total / ranges
    splitters = _quantiles(_sample(rows, ranges * SAMPLE_PER_RANGE, total, SEED), ranges)
    placed = save(_with_range(rows, splitters), "placed")
    counts, again = _counted(placed), 0
    while over := {p: c for p, c in counts.items() if c[1] > 1 and c[0] - c[2] > 2 * share}:
        again += 1
        wide = placed.join(F.broadcast(df.sparkSession.createDataFrame([(p,) for p in over], "part long")), "part", "left_semi")
        found = _by_part(_sample(wide, sum(math.ceil(c[0] / share) for c in over.values()) * SAMPLE_PER_RANGE, sum(c[0] for c in over.values()), SEED + again), splitters)
        known = set(splitters)
        for part, (size, _, _, first) in over.items():
            extra = {x for x in _quantiles(found.get(part, []), max(2, math.ceil(size / share))) if bisect.bisect_left(splitters, x) == part}
            known |= extra - known or {first}
        splitters = sorted(known)
        old, placed = placed, save(_with_range(placed, splitters), "placed")
        discard(old)
        counts = _counted(placed)
    cuts, before, slots, plan = total / shards if total else 1, 0, [0] * shards, []
    for part in sorted(counts):
        size, number = counts[part][:2]
        where = min(shards - 1, int((before + size / 2) / cuts))
        plan.append((part, where, slots[where]))
        slots[where] += number
        before += size
    laid = df.sparkSession.createDataFrame(plan or [], "part long, shard int, offset long")
    rank = F.row_number().over(W.partitionBy("part").orderBy(*ORDER))
    out = placed.withColumn("rank", rank).join(F.broadcast(laid), "part")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.col("part").alias("range"))


def _by_part(sample: list[tuple], splitters: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for row in sample:
        out.setdefault(bisect.bisect_left(splitters, row[0]), []).append(row)
    return out
