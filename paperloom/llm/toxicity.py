"""Toxicity by a linear softmax over averaged subword-bag embeddings, trained jointly in numpy.

A word's bag is the word and its character n-grams of 3 to 5 letters, edges marked, hashed into ``BUCKETS`` rows of an
embedding table; so a misspelling that was never seen shares most vectors with the word it stands for. The vectors of
``WINDOW`` consecutive words are averaged and go through one linear softmax layer; a document's score is that of its
most toxic window, so one insult counts as much in a long text as in a short one. Embeddings and softmax are trained
together on each document's most toxic window under the current model, and on random windows of clean documents;
embeddings start from their rows' log odds, without which the first windows would be arbitrary.

The fit takes a bounded sample of labelled rows, ``PER_CLASS`` of each class by hash of their ids and at most
``FIT_BYTES`` characters of text of each class, where a text that doesn't fit is left out alone; scoring reads every whole text.

A word of more than ``LONGEST`` letters, as runs of letters are in scripts without spaces, is cut into pieces of ``PIECE``
letters that overlap by half, which are words of their own, so a term inside it is seen.

Defined results: null, empty and wordless texts get the score of an empty bag, the softmax of the bias; texts of any length
are scored whole; repeated rows score alike; an id that has both labels counts as toxic; of windows that tie any gives the
score; without labelled rows of both classes the score is 0.5 times the share of label 1 (0 without labels) and no text is
called toxic; an empty table gives an empty result; other columns are not read, or pass, except that one of the name of the
score is replaced.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.workspace import give_back, ship

BUCKETS, DIMS, WINDOW = 1 << 18, 8, 4
SHORT, LONG = 3, 5
LONGEST, PIECE = 40, 16
PER_CLASS, FIT_BYTES = 3000, 10_000_000
EPOCHS, RATE, LAYER_RATE, DECAY, EPSILON = 60, 0.05, 0.02, 1e-6, 1e-4
NEGATIVE_WEIGHT = 1.5
#: Logit of a bag that says nothing: words have to argue for toxicity, clean ones needn't argue against it.
START_BIAS = -4.0
#: Texts' worth of prior that a row's share of toxic texts is shrunk by; log odds that count as clear.
SHRINK, CLEAR = 5.0, 1.0
#: Words whose bags are summed at once.
FIT_WORDS = 50_000
#: Tokens whose windows are averaged at once.
FIT_PART = 400_000
SEED = 0x5EED_0008
WORD_CACHE, GRAM_CACHE = 300_000, 300_000
_WORD = re.compile(r"[^\W_]+(?:['@$!*][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    if found and len(max(found, key=len)) > LONGEST:
        step = PIECE // 2
        found = [p for w in found for p in ([w] if len(w) <= LONGEST else [w[i : i + PIECE] for i in range(0, len(w) - step, step)])]
    return found


def grams(word: str) -> list[int]:
    """Rows of the embedding table for a word's bag."""
    edged = f"<{word}>"
    found = [edged] + [edged[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(edged) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in found]


@dataclass
class Model:
    """``weights`` holds, per bucket, the difference of the two logits that its embedding adds to a bag's mean."""

    weights: np.ndarray | None
    bias: float
    prior: float

    def scorer(self):
        cache: dict = {}

        class Words(dict):
            def __missing__(own, word: str) -> float:
                value = float(self.weights[grams(word)].mean())
                if len(own) < WORD_CACHE:
                    own[word] = value
                return value

        cache = Words()

        def score(text: str | None) -> float:
            if self.weights is None:
                return 0.5 * self.prior
            words = words_of(text)
            if not words:
                return float(1 / (1 + np.exp(-self.bias)))
            total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))])
            width = min(WINDOW, len(words))
            return float(1 / (1 + np.exp(-np.clip((total[width:] - total[:-width]).max() / width + self.bias, -40, 40))))

        return score


def _add_up(rows: np.ndarray, by_word: np.ndarray, bag_size: np.ndarray, bag_end: np.ndarray) -> np.ndarray:
    """Sums of words' values over the rows of their bags, some words at a time."""
    out = np.zeros(BUCKETS + 1)
    for at in range(0, len(bag_size), FIT_WORDS):
        size = bag_size[at : at + FIT_WORDS]
        lo, hi = bag_end[at] - size[0], bag_end[at + len(size) - 1]
        out += np.bincount(rows[lo:hi], np.repeat(by_word[at : at + FIT_WORDS], size), BUCKETS + 1)
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Full-batch gradient descent over embeddings and softmax at once."""
    y = np.asarray(labels, np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or prior in (0.0, 1.0):
        return Model(None, 0.0, prior)
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of 1 MB and more go back to the machine when freed
    except (OSError, AttributeError):  # another C library
        pass
    rng = np.random.default_rng(SEED)
    ids: dict[str, int] = {}
    tokens = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)] or [-1], np.int32) for t in texts]
    parts, rows, sizes = [], array("i"), array("i")
    for w in ids:
        found = grams(w)
        rows.extend(found)
        sizes.append(len(found))
        if len(rows) > 1 << 20:
            parts.append(np.array(rows, np.int32))
            del rows[:]
    n_words = len(ids)
    parts += [np.array(rows, np.int32), np.array([BUCKETS], np.int32)]
    del ids, rows
    give_back()  # the words themselves are the largest part of a fit
    bag_rows = np.concatenate(parts)
    bag_size = np.append(np.frombuffer(sizes, np.int32), np.int32(1)).astype(np.int64)
    del parts
    bag_end = np.cumsum(bag_size)
    del sizes
    doc_len = np.array([len(t) for t in tokens])
    doc_end = np.cumsum(doc_len)
    flat = np.concatenate(tokens)
    flat[flat < 0] = n_words  # the empty bag
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), doc_len)
    del tokens
    width = np.minimum(WINDOW, doc_len)
    start_ok = np.arange(len(flat)) <= (doc_end - width)[doc_of]
    starts = np.flatnonzero(start_ok).astype(np.int32)
    start_doc = doc_of[starts]
    first = np.searchsorted(start_doc, np.arange(len(y)))
    start_width = width.astype(np.int32)[start_doc]
    spans, clean = np.diff(np.append(first, len(starts))), np.flatnonzero(y == 0)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 * NEGATIVE_WEIGHT / max((1 - y).sum(), 1))

    # Start: a row's embedding points where its share of toxic texts does, shrunk towards the prior and only if clear.
    pairs = np.unique(doc_of.astype(np.int64) * len(bag_size) + flat)
    of_doc, of_word = pairs // len(bag_size), pairs % len(bag_size)
    seen = [_add_up(bag_rows, np.bincount(of_word[y[of_doc] == c], minlength=len(bag_size)), bag_size, bag_end) for c in (0, 1)]
    del pairs, of_doc, of_word
    odds = np.log((seen[1] + SHRINK * prior) / (seen[0] + SHRINK * (1 - prior)) * (1 - prior) / prior)
    start = WINDOW * np.maximum(odds - CLEAR, 0)
    start[-1] = 0
    layer = np.zeros((DIMS, 2), np.float32)
    layer[:, 1] = rng.standard_normal(DIMS) * 0.5
    layer[:, 0] = -layer[:, 1]
    gap = layer[:, 1] - layer[:, 0]
    table = (start[:, None] * gap / (gap @ gap)).astype(np.float32)
    bias = np.array([-START_BIAS / 2, START_BIAS / 2], np.float32)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("table", table), ("layer", layer), ("bias", bias))}

    def step(name: str, value: np.ndarray, slope: np.ndarray, t: int, rate: float) -> None:
        """Adam."""
        m, v = state[name]
        m += 0.1 * (slope - m)
        v += 0.001 * (slope * slope - v)
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + EPSILON)

    for epoch in range(1, EPOCHS + 1):
        gap = table @ (layer[:, 1] - layer[:, 0])
        word = np.empty(len(bag_size), np.float32)
        for at in range(0, len(bag_size), FIT_WORDS):
            size, stop = bag_size[at : at + FIT_WORDS], bag_end[at : at + FIT_WORDS]
            lo = stop[0] - size[0]
            word[at : at + FIT_WORDS] = np.add.reduceat(gap[bag_rows[lo : stop[-1]]], stop - size - lo) / size
        run = np.concatenate([[0.0], np.cumsum(word[flat], dtype=np.float64)])
        mean = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), FIT_PART):
            there, over = starts[at : at + FIT_PART], start_width[at : at + FIT_PART]
            mean[at : at + FIT_PART] = (run[there + over] - run[there]) / over
        hits = np.flatnonzero(mean == np.maximum.reduceat(mean, first)[start_doc])
        best = np.full(len(y), -1)
        best[start_doc[hits][::-1]] = hits[::-1]
        other = first[clean] + (rng.random(len(clean)) * spans[clean]).astype(np.int64)
        pick = np.concatenate([best, other])
        doc = start_doc[pick]
        lo, hi = starts[pick], starts[pick] + width[doc]
        n = hi - lo
        mean = (run[hi] - run[lo]) / n
        p = 1 / (1 + np.exp(-np.clip(mean + bias[1] - bias[0], -40, 40)))
        slope = (p - y[doc]) * weight[doc]  # of the loss by the logit of class 1; class 0 has the opposite
        spread = np.zeros(len(flat) + 1)
        np.add.at(spread, lo, slope / n)
        np.add.at(spread, hi, -slope / n)
        np.cumsum(spread, out=spread)
        by_word = np.zeros(len(bag_size))
        for at in range(0, len(flat), FIT_PART):
            by_word += np.bincount(flat[at : at + FIT_PART], spread[at : at + FIT_PART][: len(flat) - at], len(bag_size))
        by_row = _add_up(bag_rows, by_word / bag_size, bag_size, bag_end).astype(np.float32)
        joint = by_row @ table
        step("table", table, by_row[:, None] * (layer[:, 1] - layer[:, 0]) + DECAY * table, epoch, RATE)
        step("layer", layer, np.stack([-joint, joint], 1), epoch, LAYER_RATE)
        step("bias", bias, np.array([-slope.sum(), slope.sum()], np.float32), epoch, LAYER_RATE)
        gap = layer[:, 1] - layer[:, 0]
        against = np.minimum(table @ gap, 0)  # no word argues against another word's toxicity
        table -= against[:, None] * gap / (gap @ gap)
        table[-1] = 0
    return Model((table @ (layer[:, 1] - layer[:, 0]))[:-1].astype(np.float32), float(bias[1] - bias[0]), prior)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on a bounded sample of ``labels`` joined to ``docs``; both are read whole to find it."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(SEED), "id")
    sized = docs.select(F.col(id_col).alias("id"), F.length(text).alias("size")).join(known, "id")
    chosen: list = []
    fits = F.coalesce("size", F.lit(0)) <= FIT_BYTES
    for y in (0, 1):
        spent = 0
        for r in sized.where(fits & (F.col("y") == y)).orderBy(order, "id").limit(PER_CLASS).select("id", "size").collect():
            if spent + (r["size"] or 0) <= FIT_BYTES:
                spent += r["size"] or 0
                chosen.append((r["id"], y))
    if not chosen:
        return Model(None, 0.0, 0.0)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted(set(chosen)), "id long, y int"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(wanted, "id").select("id", "text", "y")
    ship(spark)
    found = rows.repartition(1).mapInArrow(_fit_task, "weights binary, bias double, prior double").first()
    return Model(np.frombuffer(found["weights"], np.float32) if found["weights"] else None, found["bias"], found["prior"])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits in one task, which an executor that is lost passes on, so that the driver needs no room for the sample."""
    rows = sorted(((r["id"], r["text"] or "", r["y"]) for batch in batches for r in batch.to_pylist()))
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    del rows
    give_back()
    weights = None if model.weights is None else model.weights.tobytes()
    yield pa.RecordBatch.from_pylist([{"weights": weights, "bias": model.bias, "prior": model.prior}], pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("prior", pa.float64())]))


def with_score(df: DataFrame, model: Model, text: str = "text", name: str = "__pl_score") -> DataFrame:
    """``df`` with the score of every whole text."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = sent.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")
        del one
        give_back()

    return df.withColumn(name, score(F.col(text)))
