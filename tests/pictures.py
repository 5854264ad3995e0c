"""Writers of small image files that share no code with the reader."""

import struct
import zlib


def tiff(entries, order="<", gps=(), sub=(), thumb=b""):
    """IFD0 with (tag, type, count, value bytes) entries, Exif and GPS directories, and a thumbnail in IFD1."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)

    def directory(items, after):
        at = len(out)
        out.extend(struct.pack(order + "H", len(items)) + b"\0" * (12 * len(items)) + struct.pack(order + "I", 0))
        for i, (tag, kind, count, value) in enumerate(items):
            place = at + 2 + 12 * i
            out[place : place + 8] = struct.pack(order + "HHI", tag, kind, count)
            if len(value) <= 4:
                out[place + 8 : place + 12] = value.ljust(4, b"\0")
            else:
                out[place + 8 : place + 12] = struct.pack(order + "I", len(out))
                out.extend(value)
        return at

    def patch(at, i, value):
        out[at + 2 + 12 * i + 8 : at + 2 + 12 * i + 12] = struct.pack(order + "I", value)

    items = list(entries)
    for tag, there in ((0x8769, sub), (0x8825, gps)):
        if there:
            items.append((tag, 4, 1, b"\0\0\0\0"))
    main = directory(items, 0)
    for tag, there in ((0x8769, sub), (0x8825, gps)):
        if there:
            patch(main, [x[0] for x in items].index(tag), directory(list(there), 0))
    if thumb:
        second = directory([(0x0201, 4, 1, b"\0" * 4), (0x0202, 4, 1, struct.pack(order + "I", len(thumb)))], 0)
        patch(second, 0, len(out))
        out.extend(thumb)
        out[main + 2 + 12 * len(items) : main + 6 + 12 * len(items)] = struct.pack(order + "I", second)
    return bytes(out)


def rational(order, *pairs):
    return b"".join(struct.pack(order + "II", n, d) for n, d in pairs)


def rich(order="<", turn=6):
    short = lambda v: struct.pack(order + "H", v)
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, rational(order, (33, 1), (51, 1), (3120, 100))), (3, 2, 2, b"E\0"), (4, 5, 3, rational(order, (151, 1), (12, 1), (36, 1)))]
    sub = [(0x829A, 5, 1, rational(order, (1, 250))), (0x829D, 5, 1, rational(order, (28, 10))), (0xA431, 2, 8, b"SN12345\0")]
    return tiff([(0x010F, 2, 6, b"Maker\0"), (0x0112, 3, 1, short(turn)), (0x0131, 2, 8, b"Editor \0")], order, gps, sub, b"\xff\xd8thumb\xff\xd9")


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(exif=None, extra=b"", trailer=b""):
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    body = (segment(0xE1, b"Exif\0\0" + exif) if exif else b"") + extra
    scan = segment(0xDB, b"\0" * 65) + segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"
    return head + body + scan + trailer


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(exif=None, *texts):
    rows = zlib.compress(b"\0\xff\0\0" * 2)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 2, 0, 0, 0)) + b"".join(texts) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def webp(exif=None, xmp=None, flags=0):
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = part(b"VP8X", bytes([flags]) + b"\0" * 9) + part(b"VP8 ", b"pixels!") + (part(b"EXIF", exif) if exif else b"") + (part(b"XMP ", xmp) if xmp else b"")
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
