"""QR codes by ISO/IEC 18004, from text to modules. Plain Python."""

from __future__ import annotations

from functools import lru_cache

ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
LEVELS = {"L": 1, "M": 0, "Q": 3, "H": 2}
#: Fixed values of the standard, versions 1 to 40: error-correction bytes of a block, and blocks.
EC_BYTES = {
    "L": [7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28, 28, 28, 30, 30, 26, 28] + [30] * 14,
    "M": [10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26, 26] + [28] * 19,
    "Q": [13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30, 28, 30, 30, 30, 30, 28] + [30] * 14,
    "H": [17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28, 30, 24] + [30] * 18,
}
BLOCKS = {
    "L": [1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8, 8, 9, 9, 10, 12, 12, 12, 13, 14, 15, 16, 17, 18, 19, 19, 20, 21, 22, 24, 25],
    "M": [1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16, 17, 17, 18, 20, 21, 23, 25, 26, 28, 29, 31, 33, 35, 37, 38, 40, 43, 45, 47, 49],
    "Q": [1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20, 23, 23, 25, 27, 29, 34, 34, 35, 38, 40, 43, 45, 48, 51, 53, 56, 59, 62, 65, 68],
    "H": [1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25, 25, 34, 30, 32, 35, 37, 40, 42, 45, 48, 51, 54, 57, 60, 63, 66, 70, 74, 77, 81],
}
#: Mode: (indicator, bits of the count in versions to 9, to 26, to 40).
MODES = {"numeric": (1, 10, 12, 14), "alphanumeric": (2, 9, 11, 13), "byte": (4, 8, 16, 16)}
MASKS = (
    lambda r, c: (r + c) % 2, lambda r, c: r % 2, lambda r, c: c % 3, lambda r, c: (r + c) % 3, lambda r, c: (r // 2 + c // 3) % 2, lambda r, c: r * c % 2 + r * c % 3,
    lambda r, c: (r * c % 2 + r * c % 3) % 2, lambda r, c: ((r + c) % 2 + r * c % 3) % 2,
)

_EXP = [1]
for _ in range(254):
    _EXP.append(_EXP[-1] * 2 ^ (0x11D if _EXP[-1] & 0x80 else 0))
_LOG = {v: i for i, v in enumerate(_EXP)}


def times(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


@lru_cache(None)
def generator(n: int) -> tuple[int, ...]:
    """The product of (x - 2**i), highest power first, without the leading 1."""
    poly = [1]
    for i in range(n):
        poly = [a ^ times(b, _EXP[i]) for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    return tuple(poly[1:])


def parity(data: bytes, n: int) -> bytes:
    rest = [0] * n
    for b in data:
        lead = b ^ rest[0]
        rest = [r ^ times(lead, g) for r, g in zip([*rest[1:], 0], generator(n), strict=True)]
    return bytes(rest)


def centres(version: int) -> list[int]:
    """Rows and columns of alignment patterns."""
    if version == 1:
        return []
    n, size = version // 7 + 2, 17 + 4 * version
    step = 26 if version == 32 else (version * 8 + n * 3 + 5) // (n * 4 - 4) * 2
    return [6, *sorted(size - 7 - i * step for i in range(n - 1))]


def raw_bytes(version: int) -> int:
    n = len(centres(version))
    bits = (16 * version + 128) * version + 64
    if n:
        bits -= (25 * n - 10) * n - 55 + (36 if version >= 7 else 0)
    return bits // 8


def data_bytes(version: int, level: str) -> int:
    return raw_bytes(version) - EC_BYTES[level][version - 1] * BLOCKS[level][version - 1]


def encode_bits(text: str, version: int) -> str:
    """Mode, count and data as a string of bits; the densest mode that holds the whole text."""
    mode = "numeric" if text.isascii() and text.isdigit() else "alphanumeric" if all(c in ALPHANUMERIC for c in text) else "byte"
    raw = text.encode()
    width = MODES[mode][1 if version <= 9 else 2 if version <= 26 else 3]
    if mode == "numeric":
        body = "".join(f"{int(p):0{3 * len(p) + 1}b}" for p in (text[i : i + 3] for i in range(0, len(text), 3)))
    elif mode == "alphanumeric":
        codes = [ALPHANUMERIC.index(c) for c in text]
        body = "".join(f"{45 * p[0] + p[1]:011b}" if len(p) == 2 else f"{p[0]:06b}" for p in (codes[i : i + 2] for i in range(0, len(codes), 2)))
    else:
        body = "".join(f"{b:08b}" for b in raw)
    return f"{MODES[mode][0]:04b}{len(raw):0{width}b}{body}"


def codewords(text: str, level: str) -> tuple[int, bytes]:
    """(version, interleaved data and parity) of the smallest version that fits."""
    for version in range(1, 41):
        room, bits = 8 * data_bytes(version, level), encode_bits(text, version)
        if len(bits) <= room:
            break
    else:
        raise ValueError("the text is too long for a QR code")
    bits += "0" * min(4, room - len(bits))
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    data += (b"\xec\x11" * room)[: room // 8 - len(data)]
    n, ec, raw = BLOCKS[level][version - 1], EC_BYTES[level][version - 1], raw_bytes(version)
    short, blocks, at = raw // n - ec, [], 0
    for i in range(n):
        size = short + (i >= n - raw % n)
        blocks.append(data[at : at + size])
        at += size
    out = [b[i] for i in range(short + 1) for b in blocks if i < len(b)]
    checks = [parity(b, ec) for b in blocks]
    return version, bytes(out + [c[i] for i in range(ec) for c in checks])


def _bch(value: int, poly: int, bits: int) -> int:
    rest = value << bits
    while rest.bit_length() > bits:
        rest ^= poly << (rest.bit_length() - poly.bit_length())
    return value << bits | rest


def _frame(version: int) -> dict[tuple[int, int], int]:
    """Fixed modules: finders, timing, alignment, version; format bits are kept free."""
    size, fixed = 17 + 4 * version, {}
    for r0, c0 in ((3, 3), (3, size - 4), (size - 4, 3)):
        for r in range(r0 - 4, r0 + 5):
            for c in range(c0 - 4, c0 + 5):
                if 0 <= r < size and 0 <= c < size:
                    fixed[r, c] = int(max(abs(r - r0), abs(c - c0)) not in (2, 4))
    for i in range(8, size - 8):
        fixed[6, i] = fixed[i, 6] = 1 - i % 2
    spots = centres(version)
    for r0 in spots:
        for c0 in spots:
            if (r0, c0) not in ((6, 6), (6, size - 7), (size - 7, 6)):
                for r in range(r0 - 2, r0 + 3):
                    for c in range(c0 - 2, c0 + 3):
                        fixed[r, c] = int(max(abs(r - r0), abs(c - c0)) != 1)
    for place in _format_places(size):
        for spot in place:
            fixed[spot] = 0
    fixed[size - 8, 8] = 1
    if version >= 7:
        bits = _bch(version, 0x1F25, 12)
        for i in range(18):
            fixed[i // 3, size - 11 + i % 3] = fixed[size - 11 + i % 3, i // 3] = bits >> i & 1
    return fixed


def _format_places(size: int) -> list[tuple]:
    """The two places of each of the 15 format bits, lowest first."""
    first = [(i, 8) for i in range(6)] + [(7, 8), (8, 8), (8, 7)] + [(8, 14 - i) for i in range(9, 15)]
    second = [(8, size - 1 - i) for i in range(8)] + [(size - 15 + i, 8) for i in range(8, 15)]
    return list(zip(first, second, strict=True))


def _runs(line: list[int]) -> int:
    score, text = 0, "".join(map(str, line))
    start = 0
    for i in range(1, len(line) + 1):
        if i == len(line) or line[i] != line[start]:
            score += i - start - 2 if i - start >= 5 else 0
            start = i
    score += 40 * sum(text[i : i + 11] in ("10111010000", "00001011101") for i in range(len(text) - 10))
    return score


def penalty(rows: list[list[int]]) -> int:
    size, columns = len(rows), list(map(list, zip(*rows, strict=True)))
    score = sum(map(_runs, rows)) + sum(map(_runs, columns))
    score += 3 * sum(rows[r][c] == rows[r][c + 1] == rows[r + 1][c] == rows[r + 1][c + 1] for r in range(size - 1) for c in range(size - 1))
    dark = sum(map(sum, rows))
    return score + 10 * int(abs(20 * dark - 10 * size * size) / (size * size))


def build(text: str, level: str = "M") -> tuple[int, list[list[int]]]:
    """(version, rows of modules, 1 dark) under the mask of least penalty."""
    if not text:
        raise ValueError("nothing to encode")
    version, words = codewords(text, level)
    size, fixed = 17 + 4 * version, _frame(version)
    bits = "".join(f"{b:08b}" for b in words)
    free: list[tuple[int, int]] = []
    for k, right in enumerate([*range(size - 1, 6, -2), *range(5, 0, -2)]):
        for i in range(size):
            r = size - 1 - i if k % 2 == 0 else i
            free += [(r, c) for c in (right, right - 1) if (r, c) not in fixed]
    best = None
    for mask, flips in enumerate(MASKS):
        rows = [[0] * size for _ in range(size)]
        for (r, c), v in fixed.items():
            rows[r][c] = v
        for i, (r, c) in enumerate(free):
            rows[r][c] = (i < len(bits) and bits[i] == "1") ^ (flips(r, c) == 0)
        said = _bch(LEVELS[level] << 3 | mask, 0x537, 10) ^ 0x5412
        for i, place in enumerate(_format_places(size)):
            for r, c in place:
                rows[r][c] = said >> i & 1
        rows = [[int(v) for v in row] for row in rows]
        if best is None or (score := penalty(rows)) < best[0]:
            best = (penalty(rows), rows)
    return version, best[1]


def svg(rows: list[list[int]], scale: int = 8, margin: int = 4, dark: str = "#000000", light: str = "#ffffff") -> str:
    """One path of a square for each dark module; ``transparent`` leaves the ground out."""
    side = len(rows) + 2 * margin
    clean = lambda c: c.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
    ground = "" if light == "transparent" else f'<rect width="{side}" height="{side}" fill="{clean(light)}"/>'
    path = "".join(f"M{c + margin} {r + margin}h1v1h-1z" for r, row in enumerate(rows) for c, v in enumerate(row) if v)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{side * scale}" height="{side * scale}" viewBox="0 0 {side} {side}" shape-rendering="crispEdges">{ground}<path d="{path}" fill="{clean(dark)}"/></svg>'
