"""AES in cipher block chaining. Plain Python; decryption handles all blocks at once."""

from __future__ import annotations

import numpy as np


def _field() -> tuple[list[int], list[int]]:
    """Powers of 3 and their logarithms in the cipher's field of 256 elements."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    return power, log


_POWER, _LOG = _field()


def _times(a: int, b: int) -> int:
    return _POWER[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


def _substitute(x: int) -> int:
    """The inverse in the field, its bits mixed."""
    y = _POWER[-_LOG[x] % 255] if x else 0
    return y ^ _turned(y, 1) ^ _turned(y, 2) ^ _turned(y, 3) ^ _turned(y, 4) ^ 0x63


def _turned(y: int, n: int) -> int:
    return (y << n | y >> 8 - n) & 255


BOX = [_substitute(x) for x in range(256)]
_UNBOX = np.zeros(256, np.uint8)
_UNBOX[BOX] = np.arange(256)
#: For a byte of each row of a column, its part of the column after substitution and mixing, high byte first.
_MIXED = [[int.from_bytes(bytes(_times(BOX[x], (2, 1, 1, 3)[(row - r) % 4]) for row in range(4)), "big") for x in range(256)] for r in range(4)]
_BACK = [np.array([_times(x, f) for x in range(256)], np.uint8) for f in (14, 11, 13, 9)]


def round_keys(key: bytes) -> list[int]:
    """The key's words of 32 bits, four to a round."""
    size = len(key) // 4
    words, turn = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(size)], 1
    replaced = lambda w: int.from_bytes(bytes(BOX[b] for b in w.to_bytes(4, "big")), "big")
    while len(words) < 4 * (size + 7):
        w, i = words[-1], len(words)
        if i % size == 0:
            w, turn = replaced((w << 8 | w >> 24) & 0xFFFFFFFF) ^ turn << 24, _times(turn, 2)
        elif size > 6 and i % size == 4:
            w = replaced(w)
        words.append(words[-size] ^ w)
    return words


def _block(words: list[int], block: int) -> int:
    """One block, as a number, encrypted."""
    a, b, c, d = ((block >> s & 0xFFFFFFFF) ^ k for s, k in zip((96, 64, 32, 0), words, strict=False))
    m0, m1, m2, m3 = _MIXED
    for i in range(4, len(words) - 4, 4):
        a, b, c, d = (
            m0[a >> 24] ^ m1[b >> 16 & 255] ^ m2[c >> 8 & 255] ^ m3[d & 255] ^ words[i], m0[b >> 24] ^ m1[c >> 16 & 255] ^ m2[d >> 8 & 255] ^ m3[a & 255] ^ words[i + 1],
            m0[c >> 24] ^ m1[d >> 16 & 255] ^ m2[a >> 8 & 255] ^ m3[b & 255] ^ words[i + 2], m0[d >> 24] ^ m1[a >> 16 & 255] ^ m2[b >> 8 & 255] ^ m3[c & 255] ^ words[i + 3],
        )
    out = 0
    for i, (p, q, r, s) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
        word = BOX[p >> 24] << 24 | BOX[q >> 16 & 255] << 16 | BOX[r >> 8 & 255] << 8 | BOX[s & 255]
        out = out << 32 | word ^ words[len(words) - 4 + i]
    return out


def encrypt(key: bytes, data: bytes, start: bytes = bytes(16)) -> bytes:
    """``data`` is a whole number of blocks."""
    words, before, out = round_keys(key), int.from_bytes(start, "big"), bytearray()
    for i in range(0, len(data), 16):
        before = _block(words, int.from_bytes(data[i : i + 16], "big") ^ before)
        out += before.to_bytes(16, "big")
    return bytes(out)


def decrypt(key: bytes, data: bytes, start: bytes = bytes(16)) -> bytes:
    """A last block that isn't whole is left out."""
    data = data[: len(data) // 16 * 16]
    if not data:
        return b""
    keys = np.frombuffer(b"".join(w.to_bytes(4, "big") for w in round_keys(key)), np.uint8).reshape(-1, 16)
    place = np.arange(16)
    back = (place - 4 * (place % 4)) % 16  # where the rows' turns came from
    sealed = np.frombuffer(data, np.uint8).reshape(-1, 16)
    state = sealed ^ keys[-1]
    for i in range(len(keys) - 2, -1, -1):
        state = _UNBOX[state[:, back]] ^ keys[i]
        if i:
            column = state.reshape(-1, 4, 4)
            state = np.zeros_like(column)
            for r in range(4):
                state ^= _BACK[r][np.roll(column, -r, axis=2)]
            state = state.reshape(-1, 16)
    return (state ^ np.concatenate([np.frombuffer(start, np.uint8)[None], sealed[:-1]])).tobytes()


def padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpadded(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 else data
