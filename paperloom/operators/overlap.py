"""Relational operators: multiset overlap, weighted modes, medians, baselines, screening, top-k estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multiset_overlap(left: DataFrame, right: DataFrame, pair: list[str], item: str) -> DataFrame:
    """Per pair: size of the multiset intersection over the longer side's length, 1 if both are empty.

    Both sides are pre-aggregated to (pair, item, count), so the one shuffle moves distinct items only.
    """
    tall = left.select(*pair, F.col(item), F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*pair, F.col(item), F.lit(0), F.lit(1)))
    counts = tall.groupBy(*pair, item).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counts.groupBy(*pair).agg(F.sum(F.least("l", "r")).alias("shared"), F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).select(
        *pair, "shared", "n_left", "n_right", (F.col("shared") / F.greatest("n_left", "n_right")).alias("overlap")
    )


def weighted_mode(df: DataFrame, by: list[str], key: Column, weight: Column, order: Column) -> DataFrame:
    """Per group the key of most weight; of ties the one seen first."""
    sums = df.groupBy(*by, key.alias("key")).agg(F.sum(weight).alias("weight"), F.min(order).alias("first"))
    return sums.groupBy(*by).agg(F.max_by("key", F.struct("weight", (-F.col("first")).alias("first"))).alias("mode"), F.max("weight").alias("weight"))


def margin_mode(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """Per group the most frequent rounded x; of ties the smaller."""
    counts = df.groupBy(*by, F.floor(x + 0.5).alias("x")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by("x", F.struct("n", (-F.col("x")).alias("x"))).alias("margin"), F.max("n").alias("n"))


def upper_median(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Per group the element at n / 2 of the sorted values, from counts of distinct values."""
    counts = df.where(value.isNotNull()).groupBy(*by, value.alias("v")).agg(F.count("*").alias("n"))
    running = W.partitionBy(*by).orderBy("v")
    placed = counts.select(*by, "v", F.sum("n").over(running).alias("upto"), F.sum("n").over(W.partitionBy(*by)).alias("total"))
    return placed.where("upto > floor(total / 2)").groupBy(*by).agg(F.min("v").alias("median"))


def baseline_groups(df: DataFrame, by: list[str], y: str, x: str, size: str, order: str) -> DataFrame:
    """Adds ``line``: items of one baseline, top to bottom; nulls come last. A line ends where y moves by more than max(1, 0.35 of the size before).

    The share is 35 hundredths, divided last: the nearest double to the exact product, which 0.35 * size misses (3 gives less than 1.05).
    """
    w = W.partitionBy(*by).orderBy(F.desc_nulls_last(y), F.asc_nulls_last(x), F.asc_nulls_last(order))
    new = F.abs(F.lag(y).over(w) - F.col(y)) > F.greatest(F.lit(1.0), F.lag(size).over(w).cast("double") * 35 / 100)
    return df.withColumn("starts", F.coalesce(new, F.lit(False)).cast("int")).withColumn("line", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("starts")


def screen_files(df: DataFrame, batch: str, order: str, size: str, per_file: int, total: int, held: int = 0) -> DataFrame:
    """Adds ``verdict``: accepted, too large, or over the batch total; a refused file doesn't count towards the total.

    The running total depends on each decision before it, so a batch is folded in order; a batch is what one caller hands
    over, and its array holds sizes only.
    """
    files = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("files"))
    state = F.struct(F.lit(held).cast("long").alias("running"), F.array().cast("array<struct<o:bigint,verdict:string>>").alias("out"))

    def step(a: Column, f: Column) -> Column:
        large, over = f["s"] > per_file, a["running"] + f["s"] > total
        verdict = F.when(large, "too large").when(over, "over total").otherwise("accepted")
        running = F.when(large | over, a["running"]).otherwise(a["running"] + f["s"])
        return F.struct(running.alias("running"), F.array_append(a["out"], F.struct(f["o"].cast("long").alias("o"), verdict.alias("verdict"))).alias("out"))

    folded = files.select(batch, F.inline(F.aggregate("files", state, step)["out"])).withColumnRenamed("o", order)
    return df.join(folded, [batch, order])


def list_depths(df: DataFrame, doc: str, indent: str, step: float = 6.0, deepest: int = 2) -> DataFrame:
    """Adds ``depth``: tiers start where an indent is more than ``step`` beyond the last tier; an item belongs to the last tier
    that starts at its indent plus ``step`` or before."""
    x = F.col(indent).cast("double")
    tiers = F.aggregate(
        F.array_sort(F.collect_set(x)), F.array().cast("array<double>"),
        lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > step), F.array_append(a, v)).otherwise(a),
    )
    found = df.join(df.groupBy(doc).agg(tiers.alias("_tiers")), doc)
    return found.withColumn("depth", F.least(F.lit(deepest), F.size(F.filter("_tiers", lambda t: t <= x + step)) - 1)).drop("_tiers")


def estimate_recompress(df: DataFrame, doc: str, before: str, after: str, order: str, sample: int = 6) -> DataFrame:
    """Per document: bytes before and after, from the ``sample`` largest pictures, the rest at their ratio."""
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(doc).orderBy(F.desc(before), F.asc(order))))
    gains = (F.col("r") <= sample) & (F.col(after) < F.col(before))
    sums = ranked.groupBy(doc).agg(
        F.sum(before).alias("before"), F.coalesce(F.sum(F.when(gains, F.col(before))), F.lit(0)).alias("sb"), F.coalesce(F.sum(F.when(gains, F.col(after))), F.lit(0)).alias("sa"),
        F.coalesce(F.sum(F.when(F.col("r") > sample, F.col(before))), F.lit(0)).alias("rest"), F.count_if(gains | (F.col("r") > sample)).alias("touched"), (F.count("*") > sample).alias("sampled"),
    )
    ratio = F.when(F.col("sb") > 0, F.col("sa") / F.col("sb")).otherwise(1.0)
    saved = F.col("sb") - F.col("sa") + F.col("rest") - F.floor(F.col("rest") * ratio + 0.5)
    return sums.select(doc, "before", F.greatest(F.lit(1024), F.col("before") - saved).cast("long").alias("after"), "touched", "sampled")


def tally(df: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Per group a map from reason to count, in order of reason."""
    counts = df.groupBy(*by, reason).agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("tally"))
