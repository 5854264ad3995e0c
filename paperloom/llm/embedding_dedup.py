"""Near-duplicate embeddings by randomised-rotation binary codes.

1. Vectors are scaled to length 1 in double precision; identical ones are one class. Each class is rotated (zero-padded)
   by one random orthogonal matrix to ``BITS`` dimensions; the signs are its code, and the inner product of code and
   rotated vector is stored as its correction factor. Vectors of each number of dimensions are compared with each other.
2. Code bits, drawn into bands, give buckets: the number of bits a band grows with the logarithm of the table, so that a
   bucket of unrelated vectors holds a few rows at any size, and the number of bands follows so that a pair at the
   threshold meets in some band but for a chance of ``MISS``, averaged over how many bits of its codes differ.
3. Pairs of a bucket whose codes differ in more bits than the threshold's angle explains are left out; a pair that shares
   several bands is handled in the first.
4. For the others, <code, other vector> / factor estimates the cosine without bias. Where the confidence bound rules
   out the threshold the pair goes; all that remain are computed again exactly, in double precision.
5. Buckets of more than ``HOT`` classes take their vectors along, and are cut into tiles, pairs of blocks of about ``TILE``
   classes. A task holds one tile, does steps 3 and 4 in it, and gives out each class's count of links and the links of a
   spanning forest, so a group's pairs are never written.

Defined results: vectors that are null, empty or zero, or that hold a null or non-finite component, link with nothing and
are their own component; a cosine of exactly the threshold links; repeated rows are vectors of their own; an empty table
gives an empty result; other columns, whatever their names, are not read, so texts of any length don't matter.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.components import connected_components
from paperloom.plans.workspace import broadcast_if_small, discard, save, ship

BITS, MISS, SIGMAS, TILE, HOT, SEED = 512, 1e-4, 5.5, 512, 32, 0x5EED_0002


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """(dims, bits) with orthonormal rows: the part of a random rotation that a zero-padded vector meets."""
    bits = max(BITS, 64 * -(-dims // 64))
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dims)))
    return (q * np.sign(np.diag(r))).T


def band_plan(n: int, threshold: float, bits: int) -> list[np.ndarray]:
    """Bit positions of each band for ``n`` vectors."""
    angle = math.acos(threshold) / math.pi
    width = min(40, max(6, math.ceil(math.log2(max(n, 2)))))
    differ = np.arange(bits - width + 1)
    log_choose = lambda k: math.lgamma(bits + 1) - np.array([math.lgamma(x + 1) + math.lgamma(bits - x + 1) for x in k])
    chance = np.exp(log_choose(differ) + differ * math.log(angle) + (bits - differ) * math.log(1 - angle))
    meets = np.array([math.exp(sum(math.log((bits - d - i) / (bits - i)) for i in range(width))) for d in differ.tolist()])
    count = 1
    while (chance * (1 - meets) ** count).sum() > MISS:
        count += max(1, count // 50)
    rng = np.random.default_rng(SEED + 1)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(count)]


def _units(vectors) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the usable rows of an Arrow list array, by number of dimensions."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = []
    for dims in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dims)
        found = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls: nan
        top = np.abs(found).max(1)
        good = np.isfinite(top) & (top > 0)
        found = found[good] / top[good, None]
        out.append((at[good], found / np.sqrt((found * found).sum(1))[:, None] + 0.0))
    return out


CODES = "vec long, uid long, fp binary, dims int, unit array<double>, code binary, factor double"


def _coder(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        fp, dims, unit, code, factor = ([None] * batch.num_rows for _ in range(5))
        for at, found in _units(batch.column(2)):
            turn = rotation(found.shape[1])
            turned = found @ turn
            packed = np.packbits(turned > 0, axis=1)
            factors = np.abs(turned).sum(1) / math.sqrt(turn.shape[1])
            for i, u, c, f in zip(at.tolist(), found, packed, factors.tolist(), strict=True):
                fp[i], dims[i], unit[i], code[i], factor[i] = hashlib.blake2b(u.tobytes(), digest_size=16).digest(), len(u), u, c.tobytes(), f
        columns = [pa.array(fp, pa.binary()), pa.array(dims, pa.int32()), pa.array(unit, pa.list_(pa.float64())), pa.array(code, pa.binary()), pa.array(factor, pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec", "uid", "fp", "dims", "unit", "code", "factor"])


def _bander(bands: list[np.ndarray]):
    def band(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1), axis=1)
            keys = np.empty((n, len(bands)), np.int64)
            for b, at in enumerate(bands):
                keys[:, b] = (bits[:, at].astype(np.int64) << np.arange(len(at), dtype=np.int64)).sum(1) | (b << 41)
            node = np.repeat(batch.column(0).to_numpy(), len(bands))
            codes = batch.column(1).take(pa.array(np.repeat(np.arange(n), len(bands))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), codes], names=["key", "node", "code"])

    return band


def _candidates(tile: tuple, code: np.ndarray, masks: np.ndarray, most: int):
    """Places (i, j) of pairs within runs of equal (key, x, y) of sorted rows, of a tile x < y only pairs across its two
    blocks, that differ in few enough bits and share no earlier band."""
    key, x, y, block = tile
    edge = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
    ends = np.repeat(np.append(edge, len(key)), np.diff(np.concatenate([[0], edge, [len(key)]])))
    here, step = np.arange(len(key)), 1
    while len(here := here[here + step < ends[here]]):
        i, j = here, here + step
        ok = (x[i] == y[i]) | (block[i] != block[j])
        i, j = i[ok], j[ok]
        differ = code[i] ^ code[j]
        near = np.bitwise_count(differ).sum(1, dtype=np.int64) <= most
        i, j, differ = i[near], j[near], differ[near]
        if len(i):
            band, first = key[i] >> 41, np.ones(len(i), bool)
            for b in range(int(band.max())):  # handled before, in band b
                first &= (b >= band) | (differ & masks[b]).any(1)
            yield i[first], j[first]
        step += 1


def _matcher(bands: list[np.ndarray], bits: int, most: int, dims: int, threshold: float, hot: bool):
    """Pairs (a, b) of small buckets; of hot ones links (a, b) of a spanning forest and, with b null, counts n of links."""
    masks = np.zeros((len(bands), bits), np.uint8)
    for b, at in enumerate(bands):
        masks[b, at] = 1
    masks = np.packbits(masks, axis=1).view(np.uint64)

    def match(batches):
        import pyarrow as pa

        held: list = []

        def run(table):
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            node, *tile = (table.column(c).to_numpy() for c in ("node", "key", "x", "y", "block"))
            if not hot:
                for i, j in _candidates(tile, code, masks, most):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])
                return
            unit = table.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            factor, size = table.column("factor").to_numpy(), table.column("size").to_numpy()
            signs, turned = np.unpackbits(code.view(np.uint8), axis=1), unit @ rotation(dims)
            count, root, links = np.zeros(len(node), np.int64), np.arange(len(node)), []
            for i, j in _candidates(tile, code, masks, most):
                maybe = _possible(signs[i], turned[j], factor[i], threshold)
                i, j = i[maybe], j[maybe]
                linked = (unit[i] * unit[j]).sum(1) >= threshold
                i, j = i[linked], j[linked]
                count[i] += size[j]  # a place occurs once in i, and once in j
                count[j] += size[i]
                for k in np.flatnonzero(root[i] != root[j]).tolist():
                    one, two = root[i[k]], root[j[k]]
                    if one != two:
                        root[root == max(one, two)] = min(one, two)
                        links.append((int(node[i[k]]), int(node[j[k]]), None))
            some = np.flatnonzero(count)
            rows = links + [(int(a), None, int(n)) for a, n in zip(node[some], count[some], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n"])

        for batch in batches:  # a run may go on in the next batch; it has at most two blocks
            table = pa.Table.from_batches([*held, batch])
            if not table.num_rows:
                continue
            last = [table.column(c).to_numpy() for c in ("key", "x", "y")]
            same = (last[0] == last[0][-1]) & (last[1] == last[1][-1]) & (last[2] == last[2][-1])
            cut = table.num_rows - int(same.sum())
            if cut:
                yield from run(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from run(pa.Table.from_batches(held))

    return match


def _possible(signs: np.ndarray, turned: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Where the estimate plus its error bound reaches the threshold; ``signs`` as 0 and 1."""
    bits = turned.shape[1]
    guess = ((signs * 2.0 - 1) * turned).sum(1) / math.sqrt(bits) / factor
    return guess + SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (bits - 1)) >= threshold


def _estimator(dims: int, threshold: float):
    """Keeps pairs (a, b, code, factor, unit) whose estimate leaves the threshold possible."""

    def estimate(batches):
        import pyarrow as pa

        turn = rotation(dims)
        for batch in batches:
            signs = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            turned = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, dims) @ turn
            yield batch.filter(pa.array(_possible(signs, turned, batch.column(3).to_numpy(), threshold))).select(["a", "b"])

    return estimate


def _links(nodes: DataFrame, dims: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that join all that is linked, counts (node, n) of the vectors that each class links with, in parts)."""
    spark = nodes.sparkSession
    bits = rotation(dims).shape[1]
    bands = band_plan(nodes.count(), threshold, bits)
    angle = math.acos(threshold) / math.pi
    most = math.ceil(bits * angle + SIGMAS * math.sqrt(bits * angle * (1 - angle)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    members = save(nodes.select("node", "code").repartition(parts).mapInArrow(_bander(bands), "key long, node long, code binary"), "members")
    sizes = save(members.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "sizes")
    members = members.join(broadcast_if_small(sizes, 1_000_000), "key")
    zero = F.lit(0).cast("long")
    deal = lambda df: df.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")

    few = members.where(F.col("rows") <= HOT).select("key", "node", "code", zero.alias("block"), zero.alias("x"), zero.alias("y"))
    pairs = save(deal(few).mapInArrow(_matcher(bands, bits, most, dims, threshold, False), "a long, b long"), "pairs")
    one = nodes.select(F.col("node").alias("a"), "code", "factor")
    two = nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub"))
    maybe = pairs.join(one, "a").join(two, "b").select("a", "b", "code", "factor", F.col("ub").alias("unit")).mapInArrow(_estimator(dims, threshold), "a long, b long")
    exact = maybe.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a").join(two, "b")
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    links = save(exact.where(cosine >= threshold).select("a", "b"), "links")
    both = links.union(links.select("b", "a")).toDF("a", "b")
    counts = both.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("n")), "b").select(F.col("a").alias("node"), "n")

    blocks = F.ceil(F.col("rows") / TILE).cast("long")
    many = members.where(F.col("rows") > HOT).withColumn("g", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")))
    many = many.withColumn("other", F.explode(F.sequence(zero, F.col("g") - 1))).select("key", "node", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    tiled = deal(many.join(nodes.select("node", "code", "factor", "size", "unit"), "node").select("key", "node", "code", "block", "x", "y", "factor", "size", "unit"))
    found = save(tiled.mapInArrow(_matcher(bands, bits, most, dims, threshold, True), "a long, b long, n long"), "tiles")
    discard(sizes, pairs)
    return links.union(found.where("b is not null").select("a", "b")), counts.union(found.where("b is null").select("a", "n"))


def near_duplicates(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", threshold: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (least id reachable), kept."""
    spark = df.sparkSession
    ship(spark)
    vectors = df.select(F.col(id_col).cast("long").alias("vec"), F.monotonically_increasing_id().alias("uid"), F.col(vector).cast("array<double>").alias("v"))
    rows = save(vectors.mapInArrow(_coder, CODES), "codes")
    classes = save(rows.where("fp is not null").groupBy("fp", "dims").agg(F.min("uid").alias("node"), F.count("*").alias("size")), "classes")
    nodes = save(rows.select(F.col("uid").alias("node"), "unit", "code", "factor").join(classes.select("node", "size", "dims"), "node"), "nodes")
    lengths = [r["dims"] for r in classes.groupBy("dims").count().where("count > 1").orderBy("dims").collect()]
    found = [_links(nodes.where(F.col("dims") == dims), dims, threshold) for dims in lengths]
    empty = spark.createDataFrame([], "a long, b long")
    links = reduce(DataFrame.union, [x for x, _ in found], empty)
    others = reduce(DataFrame.union, [x for _, x in found], empty.toDF("node", "n")).groupBy("node").agg(F.sum("n").alias("others"))
    roots = connected_components(links)
    placed = classes.join(others, "node", "left").join(roots, "node", "left").select("fp", "dims", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = save(placed, "placed")
    least = rows.where("fp is not null").groupBy("fp", "dims").agg(F.min("vec").alias("least")).join(placed.select("fp", "dims", "root"), ["fp", "dims"]).groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(broadcast_if_small(save(least, "least"), 1_000_000), "root").select("fp", "dims", "n_links", "component_id")
    linked = rows.where("fp is not null").select("vec", "fp", "dims").join(broadcast_if_small(save(placed, "decided"), 500_000), ["fp", "dims"]).select("vec", "n_links", "component_id")
    alone = rows.where("fp is null").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    return linked.union(alone).select(F.col("vec").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(False)).alias("kept"))
