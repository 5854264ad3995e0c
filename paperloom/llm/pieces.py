"""SentencePiece encoding with seeded merge-dropout, and decoding.

A model of merge type (BPE with byte fallback) is read once per worker. Text is cut where no piece can reach across:
before a run of spaces that follows other characters, and around line feeds. In each such stretch adjacent symbols are
merged from an agenda, best score first and leftmost of equals. With dropout, a candidate that comes up is skipped if a
hash keyed by seed, document, copy, stretch, its number in the text, position and piece falls below the rate; so runs
agree on any cluster, and each occurrence of a word has a draw of its own. The agendas of many stretches are worked off at
once, one candidate of each at a time, in numpy; nothing is remembered from one draw to the next.

Decoding is lossless for every text: characters without a piece go to byte pieces, and so does U+2581, which the model
uses for spaces.

Defined results: a null text has null tokens and decodes to null; an empty one has none and decodes to an empty text;
texts of any length are cut whole, some stretches at a time; of candidates that tie in score the leftmost comes first;
repeated rows of one id (and copy, where given) are cut alike; an empty table gives an empty result; extra columns pass,
except that one of the name of the result is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.workspace import give_back, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, RATE = 6, 0.1
#: Characters of texts, and stretches of a longer text, that are cut at once.
CHUNK, LONG_CHUNK = 200_000, 40_000
#: Widths of the tables in which agendas are worked off; longer stretches have an agenda of their own.
WIDTHS = (6, 10, 16, 32)
STRETCH = re.compile(r" *[^ \n]+| +|\n")
META = "▁"
ID_BITS, MASK, NONE, GONE = 20, 2**64 - 1, 1 << 30, -2


class Pieces:
    """A model's pieces as numbers: ``pairs`` has, for two adjacent pieces that merge, the place of the merged piece in
    order of score; ``merged`` its id."""

    def __init__(self, model: str):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model)
        plain: dict[str, int] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(read.get_piece_size()):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif read.is_control(i) or read.is_unknown(i) or read.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain[piece.replace(META, " ")] = i
                self.bytes_of.append(piece.replace(META, " ").encode())
        self.char = {p: i for p, i in plain.items() if len(p) == 1}
        self.merged: list[int] = []
        self.pairs: dict[int, int] = {}
        for piece, i in sorted(((p, i) for p, i in plain.items() if len(p) > 1), key=lambda x: (-read.get_score(x[1]), x[1])):
            for cut in range(1, len(piece)):
                left, right = plain.get(piece[:cut]), plain.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = len(self.merged)
            self.merged.append(i)
        if len(self.merged) << 5 >= NONE:
            raise ValueError("a model of more pieces than the agenda's numbers hold")
        self.merged_ids = np.array(self.merged, np.int32)
        self.byte_ids = np.array(self.byte, np.int32)
        self.char_ids = np.full(0x110000, -1, np.int32)
        self.char_ids[[ord(c) for c in self.char]] = list(self.char.values())
        # The pairs again as a hash table: places by multiplication, the next free one where taken.
        self.shift = 64 - max(4, (4 * len(self.pairs)).bit_length())
        self.keys = np.full((1 << 64 - self.shift) + 64, -1, np.int64)
        self.orders = np.full(len(self.keys), NONE, np.int32)
        left = np.array(list(self.pairs), np.int64)
        order, at = np.array(list(self.pairs.values()), np.int32), self._place(left)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.orders[at[free]] = left[free], order[free]
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, order, at = left[rest], order[rest], at[rest] + 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def order_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Orders of the pieces that pairs of symbols merge to; ``NONE`` where they don't."""
        keys = left.astype(np.int64) << ID_BITS | right
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.orders[at], NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] += 1
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.orders[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


def _mix(x):
    """A number's bits mixed; numpy arrays too."""
    if isinstance(x, int):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
        return x ^ (x >> 31)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a stretch's hash starts from and is multiplied by at each character.
START, TIMES = 0xCBF29CE484222325, 0x9E3779B97F4A7C15


def salt_of(stretch: str, key: int) -> int:
    """What keys the draws of a stretch: an odd number from its characters and ``key``, that of document and occurrence."""
    h = START
    for c in stretch:
        h = (h ^ ord(c)) * TIMES & MASK
    return _mix(h ^ _mix(key)) | 1


def _skipped(salt: int, order: int, place: int, limit: int) -> bool:
    """A multiply-shift hash of the candidate, keyed by document, occurrence and stretch through ``salt``."""
    return (salt * (order << 20 | place + 1) & MASK) < limit


def _limit(rate: float) -> int:
    return min(MASK, int(rate * 2**64))


def _by_heap(symbols: list[int], pieces: Pieces, limit: int, salt: int) -> tuple[list[int], list[int]]:
    """For long stretches: (symbols, places) after the merges, from a heap and linked neighbours."""
    pairs, merged, n = pieces.pairs, pieces.merged, len(symbols)
    agenda = []  # order of score, then place
    for i in range(n - 1):
        if (found := pairs.get(symbols[i] << ID_BITS | symbols[i + 1])) is not None:
            agenda.append((found, i))
    heapq.heapify(agenda)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    while agenda:
        order, i = heapq.heappop(agenda)
        j = after[i]
        if gone[i] or j >= n or pairs.get(symbols[i] << ID_BITS | symbols[j]) != order:
            continue  # one of the two has been merged meanwhile
        if limit and _skipped(salt, order, i, limit):
            continue
        symbols[i] = merged[order]
        gone[j] = True
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := pairs.get(symbols[i] << ID_BITS | symbols[k])) is not None:
                heapq.heappush(agenda, (found, i))
        h = before[i]
        if h >= 0 and (found := pairs.get(symbols[h] << ID_BITS | symbols[i])) is not None:
            heapq.heappush(agenda, (found, h))
    left = [i for i in range(n) if not gone[i]]
    return [symbols[i] for i in left], left


def segment(stretch: str, pieces: Pieces, rate: float = 0.0, key: int = 0) -> tuple[int, ...]:
    """Merge one stretch from an agenda; ``key`` decides which candidates are skipped."""
    char = pieces.char.get
    symbols = [char(c, -1) for c in stretch]  # -1: a character for byte pieces, which merges with nothing
    symbols, places = _by_heap(symbols, pieces, _limit(rate), salt_of(stretch, key) if rate else 0)
    out: list[int] = []
    for s, i in zip(symbols, places, strict=True):
        out += [s] if s >= 0 else [pieces.byte[b] for b in stretch[i].encode("utf-8", "surrogatepass")]
    return tuple(out)


def _work_off(points: np.ndarray, length: np.ndarray, keys: np.ndarray, pieces: Pieces, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The draws of :func:`segment` for many stretches: (ids end to end, how many each has).

    ``points`` has a stretch's code points in a column, ``length`` of them. A column of ``agenda`` holds the orders of
    adjacent symbols at the place of the left one, with the place in the low bits, so the smallest is what comes up next.
    """
    width, n = points.shape
    all_ = np.arange(n)
    inside = np.arange(width)[:, None] < length
    symbol = np.full((width + 1, n), GONE, np.int32)  # the last row: what follows the last symbol
    symbol[:width] = np.where(inside, pieces.char_ids[points], GONE)
    after = np.repeat(np.arange(1, width + 2, dtype=np.int8)[:, None], n, 1)
    after[length - 1, all_] = width
    before = np.repeat(np.arange(-1, width, dtype=np.int8)[:, None], n, 1)  # -1 is the last row too
    agenda = np.full((width, n), NONE, np.int32)
    for i in range(width - 1):
        order = pieces.order_of(symbol[i], symbol[i + 1])
        agenda[i] = np.where(order < NONE, order << 5 | i, NONE)
    salt = np.empty(0, np.uint64)
    if limit:
        salt = np.full(n, START, np.uint64)
        for i in range(width):
            salt = np.where(inside[i], (salt ^ points[i].astype(np.uint64)) * np.uint64(TIMES), salt)
        salt = _mix(salt ^ _mix(keys)) | np.uint64(1)
    row = all_
    while len(row):
        best = agenda.min(0)
        here = np.flatnonzero(best < NONE)
        if 2 * len(here) < len(row):
            agenda, row, best = agenda[:, here], row[here], best[here]
            here = np.arange(len(row))
        best = best[here]
        place, order, at = best & 31, best >> 5, row[here]
        agenda[place, here] = NONE  # it has come up
        if limit:
            goes_on = salt[at] * (order.astype(np.uint64) << np.uint64(20) | (place + 1).astype(np.uint64)) >= np.uint64(limit)
            here, place, order, at = here[goes_on], place[goes_on], order[goes_on], at[goes_on]
        new = pieces.merged_ids[order]
        right = after[place, at]
        follows = after[right, at]
        symbol[place, at], symbol[right, at] = new, GONE
        after[place, at] = follows
        before[follows, at] = place
        agenda[np.minimum(right, width - 1), here] = NONE
        order = pieces.order_of(new, symbol[follows, at])
        agenda[place, here] = np.where(order < NONE, order << 5 | place, NONE)
        left = before[place, at]
        some = np.flatnonzero(left >= 0)
        left, here, at, new = left[some].astype(np.int32), here[some], at[some], new[some]
        order = pieces.order_of(symbol[left, at], new)
        agenda[left, here] = np.where(order < NONE, order << 5 | left, NONE)
    return _with_bytes(symbol[:width].T, points.T, pieces)


def _with_bytes(symbol: np.ndarray, points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each row) of rows of symbols, with byte pieces for characters that have none of their own."""
    there = symbol != GONE
    ids, count = symbol[there], there.sum(1)
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, count
    point = points[there][bare].astype(np.int64)
    more = (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)  # bytes after the first
    size = np.ones(len(ids), np.int64)
    size[bare] += more
    start = np.cumsum(size) - size
    out = np.repeat(ids, size)
    out[start[bare]] = pieces.byte_ids[np.where(more, np.array([0, 0xC0, 0xE0, 0xF0])[more], 0) | point >> 6 * more]
    for k in range(1, 4):
        has = more >= k
        out[start[bare[has]] + k] = pieces.byte_ids[0x80 | point[has] >> 6 * (more[has] - k) & 63]
    owner = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(owner, size, len(count)).astype(np.int64)


class Encoder:
    def __init__(self, model: str = MODEL, rate: float = RATE, seed: int = SEED):
        self.pieces, self.rate, self.seed, self.limit = Pieces(model), rate, seed, _limit(rate)

    def _cut(self, stretches: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches end to end, how many each has)."""
        points = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, stretches), np.int64, len(stretches))
        start = np.cumsum(length) - length
        count, parts, low = np.zeros(len(stretches), np.int64), [], 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            if len(rows):
                place = np.arange(width)[:, None]
                table = np.where(place < length[rows], points[np.minimum(start[rows] + place, len(points) - 1)], 0)
                ids, count[rows] = _work_off(table, length[rows], keys[rows], self.pieces, self.limit)
                parts.append((rows, ids))
        rows = np.flatnonzero(length > low)
        if len(rows):
            found = [segment(stretches[i], self.pieces, self.rate, int(keys[i])) for i in rows]
            count[rows] = [len(x) for x in found]
            parts.append((rows, np.concatenate(found).astype(np.int32)))
        end = np.cumsum(count)
        out = np.empty(end[-1], np.int32)
        for rows, ids in parts:
            stop = np.cumsum(count[rows])
            out[np.arange(len(ids)) + np.repeat(end[rows] - stop, count[rows])] = ids
        return out, count

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has); ``keys``: of the documents."""
        counts, parts = np.zeros(len(texts), np.int64), []
        held: list[str] = []
        owners: list[tuple[int, int, int]] = []  # text, number of its first stretch here, stretches

        def flush() -> None:
            if held:
                sizes = [n for _, _, n in owners]
                number = np.concatenate([np.arange(first, first + n, dtype=np.uint64) for _, first, n in owners])
                key = np.repeat(np.array([(keys[i] & MASK) ^ (self.seed << 16) for i, _, _ in owners], np.uint64), sizes)
                ids, count = self._cut(held, key + number)
                parts.append(ids)
                np.add.at(counts, [i for i, _, _ in owners], np.add.reduceat(count, np.cumsum([0, *sizes[:-1]])))
                held.clear()
                owners.clear()

        chars = 0
        for i, text in enumerate(texts):
            if text and len(text) > CHUNK:
                flush()
                chars, first = 0, 0
                found = (x.group() for x in STRETCH.finditer(" " + text))
                while part := list(islice(found, LONG_CHUNK)):
                    held.extend(part)
                    owners.append((i, first, len(part)))
                    first += len(part)
                    flush()
            elif text:
                part = STRETCH.findall(" " + text)
                held.extend(part)
                owners.append((i, 0, len(part)))
                chars += len(text)
                if chars > CHUNK:
                    flush()
                    chars = 0
        flush()
        return np.concatenate(parts) if parts else np.empty(0, np.int32), counts

    def encode(self, text: str | None, key: int = 0) -> list[int] | None:
        return None if text is None else self.encode_all([text], [key])[0].tolist()

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass") if len(ids) else ""


@lru_cache(maxsize=2)
def worker_encoder(model: str, rate: float, seed: int) -> Encoder:
    """A worker's encoder, kept from task to task: the model's tables."""
    return Encoder(model, rate, seed)


def with_tokens(df: DataFrame, text: str = "text", id_col: str = "doc_id", name: str = "token_ids", model: str = MODEL, rate: float = RATE, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """``df`` with each whole text's piece ids; the draw follows from seed, id and ``copy``, a column that tells copies of a document apart."""
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = worker_encoder(model, rate, seed)
        for texts, chosen in batches:
            values, counts = encoder.encode_all(texts.to_pylist(), chosen.to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(values), mask=texts.is_null())
        give_back()

    return df.withColumn(name, encode(F.col(text), F.xxhash64(F.lit(seed), F.col(id_col), *([F.col(copy)] if copy else []))))


def with_text(df: DataFrame, ids: str = "token_ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text that piece ids stand for."""
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(model, 0.0, 0)
        for lists in batches:
            yield pa.array([encoder.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists], pa.string())

    return df.withColumn(name, decode(F.col(ids)))
