"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions only.

A Misra-Gries sketch (Spark's ``approx_top_k``, built on the frequent-items sketch of Apache DataSketches)
finds digests that may be frequent; one pass counts those candidates exactly. Verified winners, at most
``tracked`` of them, are broadcast and settle their rows without a shuffle. All other digests, none of them
frequent, meet by an ordinary shuffle.

Equal means: identical text, null counting as empty; texts are compared by SHA-256. Of equal texts the row with
the largest id stays (a null id is smaller than any other; of repeated rows that tie for it exactly one stays).
Texts of any length are digested whole and never shuffled, but for repeated rows that tie. An empty table gives
an empty result. Extra columns of any name pass through; names of our own start with ``__pl_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.plans.workspace import broadcast_if_small, save

#: Counters of each sketch and, at once, the most winners that can be broadcast (56 bytes each).
TRACKED = 2048
#: Sketches are merged in this many groups before the last merge, so that no task reads one from every partition.
MERGERS = 64
#: Beyond so many rows (40 bytes each) the list of rows that go is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
WINNER = "digest binary, best struct<id: bigint, uid: bigint>, n bigint"


def with_digest(df: DataFrame, text: str, name: str = "__pl_digest") -> DataFrame:
    return df.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def heavy_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest, best, n) of digests with more than 1 in ``tracked`` of the rows, exactly counted.

    ``rows`` has digest, id and uid, and is read three times, so it should be a written table. There are fewer than
    ``tracked`` such digests whatever the table, which bounds what is collected and broadcast.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.xxhash64("digest"))
    total = rows.count()
    least = max(2, total // tracked)
    sketches = keyed.groupBy((F.spark_partition_id() % MERGERS).alias("part")).agg(F.expr(f"approx_top_k_accumulate(key, {8 * tracked})").alias("sketch"))
    # A constant group: without one, tasks that have no rows would add buffers that the merge can't read.
    top = sketches.groupBy((F.col("part") < 0).alias("none")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {8 * tracked}), {tracked})").alias("top")).first() if total else None
    candidates = [(x["item"],) for x in top["top"] if x["count"] >= least] if top and top["top"] else []
    if not candidates:
        return spark.createDataFrame([], WINNER)
    exact = keyed.join(F.broadcast(spark.createDataFrame(candidates, "key long")), "key", "left_semi").groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("best"), F.count("*").alias("n"))
    return spark.createDataFrame(exact.where(F.col("n") > least).collect(), WINNER)


def _decided(df: DataFrame, text: str, id_col: str, tracked: int) -> tuple[DataFrame, DataFrame]:
    """(rows, heavy): each row's digest, id, uid, best and n, and the winners among digests."""
    rows = save(with_digest(df, text).select(F.col(id_col).cast("long").alias("id"), F.col("__pl_digest").alias("digest"), F.monotonically_increasing_id().alias("uid")), "digests")
    winners = heavy_digests(rows, tracked)
    heavy = F.broadcast(winners)
    alike = W.partitionBy("digest")
    light = rows.join(heavy, "digest", "left_anti").select("*", F.max(F.struct("id", "uid")).over(alike).alias("best"), F.count("*").over(alike).alias("n"))
    return rows.join(heavy, "digest").select(light.columns).union(light), winners


def group_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    both, _ = _decided(df, text, id_col, tracked)
    return both.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", tracked: int = TRACKED) -> DataFrame:
    """The rows of ``df`` that stay, whole.

    Only digests are shuffled. Rows of frequent digests go on the map side unless they have the id that stays; other rows
    that go are listed by id and digest, and that list is broadcast up to ``BROADCAST_ROWS`` and joined by a shuffle beyond.
    Where a row that stays is repeated with its id, its texts meet once more.
    """
    both, winners = _decided(df, text, id_col, tracked)
    heavy = winners.select(F.col("digest").alias("__pl_digest"), F.col("best.id").alias("__pl_keep"), F.lit(True).alias("__pl_heavy"))
    doc = F.col(id_col).cast("long")
    left = with_digest(df, text).join(F.broadcast(heavy), "__pl_digest", "left").where(F.col("__pl_heavy").isNull() | doc.eqNullSafe(F.col("__pl_keep")))
    goes = both.where("n > 1").groupBy("digest", "id").agg(F.max(F.col("uid") == F.col("best.uid")).alias("stays"), F.count("*").alias("rows"))
    goes = save(goes.where("not stays or rows > 1").join(F.broadcast(winners.select("digest", F.lit(True).alias("heavy"))), "digest", "left"), "goes")
    gone = goes.where("not stays and heavy is null").select(F.col("digest").alias("__pl_gone"), F.col("id").alias("__pl_id"))
    left = left.join(broadcast_if_small(gone, BROADCAST_ROWS), (F.col("__pl_digest") == F.col("__pl_gone")) & doc.eqNullSafe(F.col("__pl_id")), "left_anti")
    if goes.where("stays").limit(1).count():
        left = left.withColumn("__pl_n", F.row_number().over(W.partitionBy("__pl_digest").orderBy(F.lit(0)))).where("__pl_n = 1")
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
