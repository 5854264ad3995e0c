"""Mixing sources to target weights by Pareto order sampling.

1. Every source gets a target in words from its weight, and every document a weight of its own, by default log2(2 + its
   words), rounded to steps of a ninth or so. Its expected copies are in proportion to that, stopped at ``limit``, so that
   a source's expected words are its target.
2. The whole part of a document's expected copies is certain, those that reach the limit included; the fraction p is its
   inclusion probability. Among a source's documents those with the smallest [u / (1 - u)] / [p / (1 - p)] are drawn, u
   uniform from a hash of seed, id and text, until the source's words are reached: Pareto order sampling, with the size
   fixed in words.
3. The cut is found on a histogram of ranks, then on the sums of equal ranks within the one bin that it falls in, then on a
   histogram of the rows that tie there, so no task holds a source or a group of repeated rows. Sources themselves, one
   row each, are put in order by one task.

Defined results: null texts and texts without words have size 0 and are taken with 0 words; texts of any length are counted
whole; a null source is a source of its own, last in order; sources of size 0 have target 0; rows that repeat id and text
have one rank, and where the cut falls among them as many are taken as come nearest, chosen by their places in the table;
an empty table gives an empty result; extra columns of any name pass through, but none may start with ``__pl_``. Same
input and seed give the same sample on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.plans.workspace import broadcast_if_small, save

BINS = 4096
SEED = 20
WORDS = r"[^\x20\x09-\x0D]+"
#: Steps of a document's weight to each doubling; rows of a plan, one for each source and step, that are broadcast at most.
STEPS, BROADCAST_ROWS = 6, 200_000
#: Least weight, which null and others that aren't positive numbers count as; its inverse is the largest.
LEAST = 2.0**-30


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """(s, total, target) of sources (s, total): ``share`` of all sizes dealt by weight, which repeat in the order of the
    sources, stopped at ``limit`` times a source's size, and the excess dealt again.

    That comes to one level: a source gets its weight times the level, or is full. Sources become full in the order of
    limit * total / weight; the level follows from the first that doesn't.
    """
    in_order = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("s"))
    known = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    filling = W.partitionBy(F.lit(0)).orderBy(limit * F.col("total") / F.col("w"), F.asc_nulls_last("s"))
    known = known.withColumns({
        "all": F.sum("total").over(W.partitionBy(F.lit(0))), "full": F.coalesce(F.sum("total").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("w").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    level = (share * F.col("all") - limit * F.col("full")) / F.col("open")
    first = F.min(F.when(level * F.col("w") <= limit * F.col("total"), F.struct(limit * F.col("total") / F.col("w"), (-level).alias("level")))).over(W.partitionBy(F.lit(0)))
    known = known.withColumn("level", -first["level"])
    return known.select("s", "total", F.least(limit * F.col("total"), F.coalesce(F.col("level") * F.col("w"), limit * F.col("total"))).alias("target"))


def _planned(keys: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """(s, step, total, target, expected): the expected copies of a source's documents whose weight is of that step."""
    steps = save(keys.groupBy("s", "step").agg(F.sum("size").alias("size")), "steps")
    goal = targets(steps.groupBy("s").agg(F.sum("size").alias("total")), weights, share, limit).withColumnRenamed("s", "gs")
    heaviest_first = W.partitionBy("gs").orderBy(F.desc("step"))
    known = steps.join(broadcast_if_small(save(goal, "targets"), BROADCAST_ROWS), F.col("s").eqNullSafe(F.col("gs"))).withColumn("w", F.pow(F.lit(2.0), F.col("step") / STEPS))
    full = F.coalesce(F.sum("size").over(heaviest_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("size")).over(heaviest_first.rowsBetween(W.currentRow, W.unboundedFollowing))
    known = known.withColumn("c", (F.col("target") - limit * full) / F.when(rest > 0, rest)).withColumn("c", F.when(F.col("c") * F.col("w") <= limit, F.col("c")))
    c = F.max(F.struct(F.col("c").isNotNull().alias("open"), "step", "c")).over(W.partitionBy("gs"))["c"]
    expected = F.when(F.col("total") > 0, F.least(F.lit(float(limit)), F.coalesce(c * F.col("w"), F.lit(float(limit))))).otherwise(0.0)
    return save(known.select("s", "step", "total", "target", expected.alias("expected")), "planned")


def _keyed(df: DataFrame, text: str, id_col: str, source: str, seed: int, weight: Column | None) -> DataFrame:
    """``df`` with what the draw needs, in columns __pl_s, _size, _step (of the weight), _h (hash of id and text) and _tie."""
    sized = df.withColumn("__pl_size", word_count(text))
    weight = F.log2(2 + F.col("__pl_size")) if weight is None else weight.cast("double")
    weight = F.greatest(F.lit(LEAST), F.least(F.lit(1 / LEAST), F.coalesce(F.nanvl(weight, F.lit(0.0)), F.lit(0.0))))
    return sized.withColumns({
        "__pl_s": F.col(source), "__pl_step": F.round(STEPS * F.log2(weight)).cast("int"), "__pl_h": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)), "__pl_tie": F.xxhash64(F.monotonically_increasing_id()),
    })


def _with_rank(keys: DataFrame, plan: DataFrame, prefix: str) -> DataFrame:
    """``keys`` with total, target, whole (certain copies), rank and bin; the last two null where the fraction is zero."""
    p = lambda name: f"{prefix}{name}"
    plan = plan.select(*[F.col(c).alias(f"__pl_p_{c}") for c in plan.columns])
    on = F.col(p("s")).eqNullSafe(F.col("__pl_p_s")) & F.col(p("step")).eqNullSafe(F.col("__pl_p_step"))
    out = keys.join(broadcast_if_small(plan, BROADCAST_ROWS), on).withColumns({p("total"): F.col("__pl_p_total"), p("target"): F.col("__pl_p_target"), p("whole"): F.floor("__pl_p_expected")})
    fraction = F.col("__pl_p_expected") - F.col(p("whole"))
    u = (F.shiftrightunsigned(p("h"), 12) + 0.5) / F.lit(float(2**52))
    odds = F.when(fraction > 0, (u / (1 - u)) / (fraction / (1 - fraction)))
    out = out.withColumn(p("rank"), odds / (1 + odds)).withColumn(p("bin"), F.least(F.floor(F.col(p("rank")) * BINS), F.lit(BINS - 1)))
    return out.drop("__pl_p_s", "__pl_p_step", "__pl_p_total", "__pl_p_target", "__pl_p_expected")


def _nearest(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of (s, need, size, ...): each source's row at which the running sum of sizes in ``order`` passes its need, and the sum ``before`` it."""
    running = F.sum("size").over(W.partitionBy("s").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    passing = rows.withColumn("before", running - F.col("size")).where("before < need and before + size >= need")
    return passing.groupBy("s").agg(F.min(F.struct(*order, "before", "need", *[c for c in rows.columns if c not in ("s", "need", *order)])).alias("c")).select("s", "c.*")


def _cuts(keys: DataFrame) -> DataFrame:
    """(s, bin, rank, h, tie): what is drawn of a source, up to and with that row in the order of these; none with bin -1."""
    bins = save(keys.groupBy("s", "bin").agg(F.sum("size").alias("size"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.max("target").alias("target")), "bins")
    need = save(bins.groupBy("s").agg((F.max("target") - F.sum("sure")).alias("need")), "need")
    needs = broadcast_if_small(need.withColumnRenamed("s", "ns"), BROADCAST_ROWS)
    at_bin = save(_nearest(bins.where("bin is not null").join(needs, F.col("s").eqNullSafe(F.col("ns"))).select("s", "need", "size", "bin"), ["bin"]), "at_bin")
    wanted = broadcast_if_small(at_bin.select(F.col("s").alias("cs"), F.col("bin").alias("cbin"), (F.col("need") - F.col("before")).alias("need")), BROADCAST_ROWS)
    inside = save(keys.select("s", "bin", "rank", "h", "tie", "size").join(wanted, F.col("s").eqNullSafe(F.col("cs")) & (F.col("bin") == F.col("cbin"))).select("s", "bin", "need", "rank", "h", "tie", "size"), "inside")
    alike = inside.groupBy("s", "bin", "need", "rank", "h").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    at_rank = _nearest(alike, ["rank", "h"]).withColumn("each", F.col("size") / F.col("n"))
    take = F.least(F.col("n"), F.ceil((F.col("need") - F.col("before")) / F.col("each") - 0.5))  # of the rows that tie
    at_rank = save(at_rank.select("s", "bin", "rank", "h", F.when(F.col("each") > 0, take).otherwise(F.col("n")).alias("take"), "n"), "at_rank")
    some = broadcast_if_small(at_rank.where("take > 0 and take < n").select(F.col("s").alias("cs"), F.col("rank").alias("crank"), F.col("h").alias("ch"), F.col("take").cast("double").alias("need")), BROADCAST_ROWS)
    tied = save(inside.select("s", "rank", "h", "tie").join(some, F.col("s").eqNullSafe(F.col("cs")) & (F.col("rank") == F.col("crank")) & (F.col("h") == F.col("ch"))).select("s", "need", "tie", F.shiftright("tie", 52).alias("part")), "tied")
    at_part = save(_nearest(tied.groupBy("s", "need", "part").agg(F.count("*").alias("size")), ["part"]), "at_part")
    part = broadcast_if_small(at_part.select(F.col("s").alias("cs"), F.col("part").alias("cpart"), (F.col("need") - F.col("before")).alias("left")), BROADCAST_ROWS)
    one = tied.drop("need").join(part, F.col("s").eqNullSafe(F.col("cs")) & (F.col("part") == F.col("cpart"))).select("s", F.col("left").alias("need"), F.lit(1).alias("size"), "tie")
    at_tie = _nearest(one, ["tie"]).select(F.col("s").alias("ts"), F.col("tie").alias("upto"))
    top, low = F.lit(2**63 - 1), F.lit(-(2**63))
    tie = F.when(F.col("take") <= 0, low).when(F.col("take") >= F.col("n"), top).otherwise(F.col("upto"))
    exact = at_rank.join(at_tie, F.col("s").eqNullSafe(F.col("ts")), "left").select(F.col("s").alias("es"), "bin", "rank", "h", tie.alias("tie"))
    # Where no sum passes the need, there is none to fill, or all that can be drawn is.
    every = need.join(exact, F.col("s").eqNullSafe(F.col("es")), "left")
    return save(every.select("s", F.coalesce("bin", F.when(F.col("need") <= 0, -1).otherwise(BINS)).alias("bin"), "rank", "h", "tie"), "cuts")


def mix(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """The rows of ``df`` with __pl_size, __pl_total, __pl_target and __pl_copies, the times that the mix takes them.

    ``weight``: of a document, a column of ``df`` of 2**-30 to 2**30, the nearer of which other numbers count as, and null as the
    least; a literal gives all documents of a source the same chance. ``weights``, of sources, are positive.
    """
    names = ("s", "step", "size", "h", "tie")
    rows = _keyed(df, text, id_col, source, seed, weight)
    keys = save(rows.select(*[F.col(f"__pl_{n}").alias(n) for n in names]), "keys")
    plan = _planned(keys, list(weights), share, limit)
    cuts = _cuts(save(_with_rank(keys, plan, ""), "ranked"))
    cuts = cuts.select(*[F.col(c).alias(f"__pl_c_{c}") for c in cuts.columns])
    out = _with_rank(rows, plan, "__pl_").join(broadcast_if_small(cuts, BROADCAST_ROWS), F.col("__pl_s").eqNullSafe(F.col("__pl_c_s")))
    earlier = (F.col("__pl_rank") < F.col("__pl_c_rank")) | ((F.col("__pl_rank") == F.col("__pl_c_rank")) & ((F.col("__pl_h") < F.col("__pl_c_h")) | ((F.col("__pl_h") == F.col("__pl_c_h")) & (F.col("__pl_tie") <= F.col("__pl_c_tie")))))
    drawn = F.coalesce((F.col("__pl_bin") < F.col("__pl_c_bin")) | ((F.col("__pl_bin") == F.col("__pl_c_bin")) & earlier), F.lit(False))
    copies = (F.col("__pl_whole") + drawn.cast("long")).cast("long").alias("__pl_copies")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "__pl_size", "__pl_total", "__pl_target", copies)


def mixed_rows(df: DataFrame, copy: str | None = None, **options) -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it is taken; ``copy``: a column to add with the copy's number."""
    found = mix(df, **options)
    return found.where("__pl_copies > 0").withColumn("__pl_copy", F.explode(F.sequence(F.lit(1), F.col("__pl_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns], *([F.col("__pl_copy").alias(copy)] if copy else []))
