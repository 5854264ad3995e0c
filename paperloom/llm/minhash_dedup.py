"""Near-duplicate documents by MinHash.

1. Every text becomes the set of its distinct word shingles; documents with one set are one class (fingerprint of 128 bits).
2. Each class gets 128 minima of universal hashes, cut into 32 bands of 4. Two sets of similarity 0.75 miss each
   other in all bands with a probability of 5e-6; 0.8 and more, below 6e-8.
3. In each band bucket every class is paired with the bucket's best-connected class (a star, not all pairs), pairs are
   sifted by a 256-bit digest of the signatures and confirmed on the full sets, and links become components.
4. Classes of one bucket that are still in different components are compared with each other, so that no link is lost
   to a star's centre; within a component nothing is compared again, so a group of copies never meets itself in full.
   In buckets of up to ``SMALL`` classes this is a join of pairs, sifted and confirmed as before. Larger buckets are cut
   into tiles, pairs of blocks of about ``TILE`` classes with their full sets; a task holds one tile, compares each pair
   in the first band that it shares, and gives out one link for two components, so no pairs are written.
5. Components come from alternating large-star and small-star passes.

Defined results: texts that are null, empty or all white space have an empty set and link with nothing; fewer words
than a shingle has are one shingle; texts of any length are read whole; a similarity of exactly the threshold links;
repeated rows and repeated ids are documents of their own, and of rows that tie the one read first stays; a null id never
becomes a component's id unless all of its ids are null; an empty table gives an empty result; other columns, whatever
their names, are not read, or pass through where rows are returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.components import connected_components
from paperloom.plans.workspace import broadcast_if_small, discard, give_back, save, ship

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Positions of 128 whose two low bits may differ: 24 expected at similarity 0.75; 5.5 standard deviations on top.
MAX_MISMATCH = 48
#: Beyond so many rows (16 bytes each) a list of rows is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 1_000_000
#: Classes with more than 1 in so many of the rows are settled on the map side; pairs of one class that a task joins.
HEAVY, HUB_PAIRS = 2048, 512
#: Largest bucket whose pairs are joined, and classes in a block of a larger one.
SMALL, TILE = 16, 384
#: Words remembered by a Python worker, and shingles hashed at once.
WORD_CACHE, BLOCK = 250_000, 1 << 15
SEED = 0x5EED_0001

U64 = np.uint64
PAIR_BITS = 0x5555555555555555


class _Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and U+0009 to U+000D, on UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(cache.__getitem__, words), U64, n)
    odd = _mix(np.arange(1, max(k, 1) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if n < k:
        return _mix(np.sum(h * odd[:n], keepdims=True, dtype=U64) + U64(n))
    total = np.full(n - k + 1, k, U64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * odd[i]
    return np.unique(_mix(total))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of (a * x + b) mod 2**64 >> 32, x of 32 bits: a strongly universal family. One row of 128 for each set."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 2**64, HASHES, U64), rng.integers(0, 2**64, HASHES, U64)
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        stop, n = at, 0
        while stop < len(sets) and (n == 0 or n + len(sets[stop]) <= BLOCK):
            n += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[at:stop]) >> U64(32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : stop - 1]], dtype=np.int64)]).astype(np.int64)
        low = np.full((stop - at, HASHES), 0xFFFFFFFF, np.uint32)
        if stop - at == 1:  # a long text of its own, in pieces
            for i in range(0, len(x), BLOCK):
                for k in range(HASHES):
                    low[0, k] = min(low[0, k], (((x[i : i + BLOCK] * a[k]) + b[k]) >> U64(32)).min())
        else:
            t = np.empty_like(x)
            for k in range(HASHES):
                np.multiply(x, a[k], out=t)
                t += b[k]
                t >>= U64(32)
                low[:, k] = np.minimum.reduceat(t, starts)
        out[at:stop] = low
        at = stop
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + np.zeros((len(rows), 1), U64)
    for i in range(ROWS):
        key = _mix(key ^ rows[:, :, i])
    return key.view(np.int64)


def _digests(signatures: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum: 4 words of 64 bits a row."""
    shift = np.arange(0, 64, 2, dtype=U64)
    return np.bitwise_or.reduce((signatures & np.uint32(3)).astype(U64).reshape(len(signatures), 4, 32) << shift, axis=2).view(np.int64)


SKETCH = "id long, uid long, text_hash long, n_shingles long, fp binary, bits array<long>, bands array<long>"
SETS = "node long, members array<long>"


def _sketcher(k: int):
    def sketch(batches):
        import hashlib

        import pyarrow as pa

        cache = _Words()
        schema = pa.schema([("id", pa.int64()), ("uid", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(words_of(t), k, cache) for t in part.column(3).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                bits, bands, fp = [[] for _ in sets], [[] for _ in sets], [b"" for _ in sets]
                if full:
                    found = _signatures([sets[i] for i in full])
                    for i, x, y in zip(full, _digests(found).tolist(), _bands(found).tolist(), strict=True):
                        bits[i], bands[i] = x, y
                        fp[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(bits, schema.field("bits").type), pa.array(bands, schema.field("bands").type)], schema=schema)
        del cache
        give_back()

    return sketch


def _set_maker(k: int):
    def sets(batches):
        import pyarrow as pa

        cache = _Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [shingle_set(words_of(t), k, cache) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "members"])
        del cache
        give_back()

    return sets


def _tile_matcher(percent: int):
    """One link (a, b) for each two components of a tile that have one; rows come sorted by tile (key, x, y)."""

    def links(t: dict):
        n, root, node, bits, bands, block = (t[c] for c in ("n", "root", "node", "bits", "bands", "block"))
        at = t["start"]
        order = np.unique(t["members"], return_inverse=True)[1]
        flag = np.zeros(order.max(initial=0) + 1, np.int64)
        across = t["x"] != t["y"]
        found = []
        for i in range(len(n)):
            j = np.arange(i + 1, len(n))
            j = j[(root[j] != root[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if across:
                j = j[block[j] != block[i]]
            differ = bits[j] ^ bits[i]
            j = j[np.bitwise_count((differ | (differ >> U64(1))) & U64(PAIR_BITS)).sum(1) <= MAX_MISMATCH]
            if len(j):
                j = j[(bands[j] == bands[i]).argmax(1) == t["band"]]  # handled in an earlier band otherwise
            if not len(j):
                continue
            mine = order[at[i] : at[i + 1]]
            flag[mine] = 1
            size = n[j]
            stop = np.cumsum(size)
            both = np.add.reduceat(flag[order[np.repeat(at[j] - stop + size, size) + np.arange(stop[-1])]], stop - size)
            flag[mine] = 0
            j = j[100 * both >= percent * (size + n[i] - both)]
            found += [(root[i], root[k], node[i], node[k]) for k in j]
        return {(min(a, b), max(a, b)): (x, y) for a, b, x, y in found}.values()

    def match(batches):
        import pyarrow as pa

        held: list = []

        def run(table, cuts):
            lists = {c: table.column(c).combine_chunks() for c in ("bits", "bands", "members")}
            flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
            cols = {c: table.column(c).to_numpy() for c in ("key", "x", "y", "node", "n", "root", "block")}
            cols |= {"bits": flat["bits"].view(U64).reshape(-1, 4), "bands": flat["bands"].reshape(-1, BANDS)}
            start = np.concatenate([[0], np.cumsum(cols["n"])])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                one = {c: v[lo:hi] for c, v in cols.items()}
                one |= {"x": cols["x"][lo], "y": cols["y"][lo], "start": start[lo : hi + 1] - start[lo], "members": flat["members"][start[lo] : start[hi]]}
                one["band"] = int((one["bands"][0] == cols["key"][lo]).argmax())
                if out := list(links(one)):
                    yield pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], names=["a", "b"])

        def tiles(table, last: bool):
            """Whole tiles of the rows at hand; the rest is held back for the next batch."""
            key, x, y = (table.column(c).to_numpy() for c in ("key", "x", "y"))
            edge = (np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()
            cuts = [0, *edge, *([table.num_rows] if last else [])]
            yield from run(table, cuts)
            held[:] = [] if last else table.slice(cuts[-1]).combine_chunks().to_batches()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                table = pa.Table.from_batches([*held, batch.slice(start, 256)])
                yield from tiles(table, False)
        if held:
            yield from tiles(pa.Table.from_batches(held), True)

    return match


def _join_sets(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the set of their ``side``. The set of a class with many pairs, a hub, has a copy for each ``HUB_PAIRS`` of them."""
    hubs = pairs.groupBy(side).agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("copies")).where("copies > 1").withColumnRenamed(side, "hub")
    hubs = broadcast_if_small(save(hubs, "hubs"), BROADCAST_ROWS)
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(hubs, F.col(side) == F.col("hub"), "left").withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("hub", "copies")
    copied = sets.join(hubs, F.col("node") == F.col("hub"), "left").select(F.col("node").alias(side), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.col("members").alias(f"set_{side}"))
    return dealt.join(copied, [side, "copy"]).drop("copy")


class _Search:
    """The steps over one table; ``docs`` is read again for the full sets of classes that have candidates."""

    def __init__(self, df: DataFrame, text: str, id_col: str, k: int, percent: int):
        self.k, self.percent = k, percent
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
        ship(df.sparkSession)
        rows = self.docs.select("id", F.monotonically_increasing_id().alias("uid"), "text_hash", "text")
        self.rows = save(rows.mapInArrow(_sketcher(k), SKETCH), "sketches")
        small = self.rows.where("n_shingles > 0").select("fp", "id", "uid", "text_hash", "n_shingles")
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
        self.classes = save(small.groupBy("fp").agg(F.min("uid").alias("node"), F.min("id").alias("least"), F.min(place).alias("first"), F.count("*").alias("rows")), "classes")

    def buckets(self) -> DataFrame:
        """(key, node, n, bits) of buckets that hold two classes at least; deg tells how many others a class meets."""
        nodes = self.rows.join(self.classes.select(F.col("node").alias("uid")), "uid", "left_semi")
        keys = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        keys = save(keys, "keys")
        members = nodes.select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "bits", F.explode("bands").alias("key"))
        members = save(members.join(broadcast_if_small(keys, BROADCAST_ROWS), "key"), "buckets")
        degree = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("deg"))
        out = save(members.drop("size").join(degree, "node"), "members")
        discard(keys, members)
        return out

    def sift(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b) of pairs (x, y) that sizes and signatures leave possible."""
        wrong = sum(F.bit_count((F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])).bitwiseOR(F.shiftright(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i]), 1)).bitwiseAND(F.lit(PAIR_BITS))) for i in range(4))
        near = (100 * F.least("x.n", "y.n") >= self.percent * F.greatest("x.n", "y.n")) & (wrong <= MAX_MISMATCH)
        return pairs.where(near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def star_pairs(self, members: DataFrame) -> DataFrame:
        hub = F.max(F.struct("deg", F.xxhash64("node").alias("tie"), "node", "n", "bits")).alias("y")
        hubs = members.groupBy("key").agg(hub)
        return self.sift(members.alias("x").join(hubs, "key").where("x.node <> y.node"))

    def cross_links(self, members: DataFrame, root: DataFrame) -> DataFrame:
        """Links between components, all of them in effect: at least one for two components that have any."""
        placed = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
        placed = save(placed.join(broadcast_if_small(mixed, BROADCAST_ROWS), "key").select("key", "size", "node", "n", "bits", "root"), "mixed")
        small, large = placed.where(F.col("size") <= SMALL), placed.where(F.col("size") > SMALL)
        pairs = self.sift(small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root"))))
        sets = self.sets_of(large.select(F.col("node").alias("uid")).distinct())
        full = sets.join(self.rows.select(F.col("uid").alias("node"), "bands"), "node")
        blocks = F.ceil(F.col("size") / TILE).cast("long")
        tiled = large.withColumn("g", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        tiled = tiled.select("key", "node", "n", "bits", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).join(full, "node")
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        columns = ["key", "x", "y", "node", "n", "root", "block", "bits", "bands", "members"]
        dealt = tiled.select(columns).repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
        return self.confirm(pairs).union(dealt.mapInArrow(_tile_matcher(self.percent), "a long, b long"))

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, members) of the classes ``wanted`` (uid), from their texts: one row a class, however often its text is repeated."""
        wanted = save(self.rows.select("uid", "id", "text_hash").join(broadcast_if_small(wanted, BROADCAST_ROWS), "uid", "left_semi"), "wanted")
        w = broadcast_if_small(wanted, BROADCAST_ROWS).alias("w")
        same = lambda left: (F.col(f"{left}.text_hash") == F.col("w.text_hash")) & F.col(f"{left}.id").eqNullSafe(F.col("w.id"))
        again = save(self.rows.alias("r").join(w, same("r")).groupBy("w.uid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("uid").alias("node")), "again")
        texts = self.docs.alias("d").join(w, same("d")).select(F.col("w.uid").alias("node"), F.col("d.text").alias("text"))
        if again.limit(1).count():
            repeated = broadcast_if_small(again, BROADCAST_ROWS)
            texts = texts.join(repeated, "node", "left_anti").union(texts.join(repeated, "node", "left_semi").dropDuplicates(["node"]))
        return save(texts.mapInArrow(_set_maker(self.k), SETS), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        pairs = save(pairs, "pairs")
        sets = self.sets_of(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct())
        both = _join_sets(_join_sets(pairs, sets, "a", "b"), sets, "b", "a")
        same = F.size(F.array_intersect("set_a", "set_b"))
        links = save(both.where(100 * same >= self.percent * (F.size("set_a") + F.size("set_b") - same)).select("a", "b").distinct(), "links")
        discard(sets, pairs)
        return links

    def components(self) -> DataFrame:
        """(node, root) of linked classes."""
        members = self.buckets()
        links = self.confirm(self.star_pairs(members))
        first = save(connected_components(links), "first")
        edges = first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(self.cross_links(members, first))
        return connected_components(edges)


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id of the component), kept, text_hash, row_kept.

    ``kept`` is id = component_id; ``row_kept`` marks exactly one row of each component, also where ids repeat or are null.
    """
    search = _Search(df, text, id_col, k, percent)
    roots = save(search.components(), "roots")
    linked = search.classes.join(broadcast_if_small(roots, BROADCAST_ROWS), "node").select("fp", "root", "least", "first", "rows")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first")["uid"].alias("first_uid"))
    linked = save(linked.select("fp", "root", "rows").join(broadcast_if_small(save(of_root, "of_root"), BROADCAST_ROWS), "root").select("fp", "rows", "component_id", "first_uid"), "linked")
    # A class of several rows that is linked with no other; what then remains are rows of their own.
    unlinked = search.classes.where("rows > 1").join(broadcast_if_small(roots.select("node"), BROADCAST_ROWS), "node", "left_anti")
    decided = save(linked.union(unlinked.select("fp", "rows", F.col("least").alias("component_id"), F.col("first")["uid"].alias("first_uid"))), "decided")
    rows = search.rows.where("n_shingles > 0").select("id", "uid", "text_hash", "n_shingles", "fp")
    heavy = F.broadcast(decided.where(F.col("rows") * HEAVY > rows.count()).drop("rows"))  # fewer than HEAVY classes
    light = broadcast_if_small(decided.where(F.col("rows") * HEAVY <= rows.count()).drop("rows"), BROADCAST_ROWS)
    known = rows.join(heavy, "fp").unionByName(rows.join(heavy, "fp", "left_anti").join(light, "fp", "left"))
    single = F.col("first_uid").isNull()
    found = known.select("id", "n_shingles", F.when(single, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (single | (F.col("uid") == F.col("first_uid"))).alias("row_kept"), "text_hash")
    alone = search.rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("row_kept"), "text_hash")
    return found.union(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_hash", "row_kept")


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``df`` that stay, whole: one row of each component, and all texts without words.

    Rows with one id and one text count as one document.
    """
    found = save(near_duplicates(df, text, id_col, k, percent), "decisions")
    whole = found.groupBy(F.col(id_col).alias("__pl_id"), F.col("text_hash").alias("__pl_hash")).agg(F.max("row_kept").alias("stays"), F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    whole = save(whole.where("not stays or (n > 1 and size > 0)"), "decided")
    gone = broadcast_if_small(whole.where("not stays").select("__pl_id", "__pl_hash"), BROADCAST_ROWS)
    marked = df.withColumns({"__pl_doc": F.col(id_col).cast("long"), "__pl_text": F.xxhash64(text)})
    left = marked.join(gone, F.col("__pl_doc").eqNullSafe(F.col("__pl_id")) & (F.col("__pl_text") == F.col("__pl_hash")), "left_anti")
    if whole.where("stays").limit(1).count():
        from pyspark.sql import Window as W

        again = W.partitionBy("__pl_doc", "__pl_text").orderBy(F.lit(0))
        left = left.withColumn("__pl_n", F.row_number().over(again)).where((F.col("__pl_n") == 1) | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
