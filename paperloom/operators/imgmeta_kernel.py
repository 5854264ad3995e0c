"""Image files at byte level: segments of JPEG, PNG and WebP, Exif and other metadata, lossless removal. Plain Python.

One walk serves reading and removal. Segments tile the file: (kind, where, start, end, payload start, payload end, keyword).
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

#: Kinds of segments and the category that a user removes them by.
CATEGORY = {
    "exif": "exif", "xmp": "xmp", "iptc": "iptc", "icc": "icc", "comment": "comments", "text": "comments", "timestamp": "comments", "vendor": "other", "mpf": "other", "trailer": "other",
}
#: Chunks with metadata, and chunks that hold the picture.
PNG_KINDS = {"tEXt": "text", "zTXt": "text", "iTXt": "text", "eXIf": "exif", "tIME": "timestamp", "iCCP": "icc"}
WEBP_KINDS = {"EXIF": "exif", "XMP ": "xmp", "ICCP": "icc"}
PIXELS = {"png": {"signature", "IHDR", "PLTE", "tRNS", "IDAT", "IEND"}, "webp": {"VP8 ", "VP8L", "ALPH", "ANIM", "ANMF"}}
VP8X = {"icc": 0x20, "exif": 0x08, "xmp": 0x04}
HEIF = {"avif": "avif", "avis": "avif", **dict.fromkeys(("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1"), "heic")}
JPEG_NAMES = {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM"}
#: APP number, what its data start with, kind, and bytes before the payload; None means any data.
APPS = (
    (0, None, "structural", 0), (1, b"Exif\0", "exif", 6), (1, b"http://ns.adobe.com/xap/1.0/", "xmp", 29), (1, b"http://ns.adobe.com/xmp/extension/", "xmp", 35), (2, b"ICC_PROFILE\0", "icc", 14),
    (2, b"MPF\0", "mpf", 4), (13, b"Photoshop", "iptc", 0), (14, b"Adobe", "structural", 0),
)


class Segment(NamedTuple):
    kind: str
    where: str
    start: int
    end: int
    payload_start: int
    payload_end: int
    keyword: str | None = None


@dataclass
class Walk:
    container: str
    segments: list[Segment] = field(default_factory=list)
    rewritable: bool = True
    warnings: list[str] = field(default_factory=list)

    def add(self, kind: str, where: str, start: int, end: int, inner: tuple[int, int] | None = None, keyword: str | None = None) -> None:
        self.segments.append(Segment(kind, where, start, end, *(inner or (start, end)), keyword))


def detect(data: bytes) -> str | None:
    for magic, kind in ((b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png")):
        if data.startswith(magic):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data.startswith(b"GIF8"):
        return "gif"
    if len(data) > 12 and data[4:8] == b"ftyp" and (kind := HEIF.get(data[8:12].decode("latin-1"))):
        return kind
    return "tiff" if len(data) > 4 and data[:4] in (b"II*\0", b"MM\0*") else None


def walk(data: bytes) -> Walk | None:
    kind = detect(data)
    if kind in ("jpeg", "png", "webp"):
        return {"jpeg": _jpeg, "png": _png, "webp": _webp}[kind](data)
    return Walk(kind, rewritable=False) if kind else None


def _marker(code: int) -> str:
    if code in JPEG_NAMES:
        return JPEG_NAMES[code]
    for base, name in ((0xE0, "APP"), (0xC0, "SOF")):
        if base <= code <= base + 15:
            return f"{name}{code - base}"
    return f"RST{code - 0xD0}" if 0xD0 <= code <= 0xD7 else f"FF{code:X}"



def _scan_end(data: bytes, at: int) -> int:
    """The first marker after entropy-coded data; stuffed zeros, fill bytes and restarts belong to them."""
    while (i := data.find(b"\xff", at)) >= 0 and i + 1 < len(data):
        if data[i + 1] in (0x00, 0xFF) or 0xD0 <= data[i + 1] <= 0xD7:
            at = i + 2
        else:
            return i
    return len(data)


def _jpeg(data: bytes) -> Walk:
    out, size, at = Walk("jpeg"), len(data), 2
    out.add("structural", "SOI", 0, 2)
    while at < size:
        if data[at] != 0xFF:
            stop = data.find(b"\xff", at)
            stop = size if stop < 0 else stop
            out.warnings.append("Unexpected bytes between segments; the file may be damaged.")
            out.add("structural", "unknown", at, stop)
            at = stop
            continue
        m = at + 1
        while m < size and data[m] == 0xFF:
            m += 1
        if m == size:
            out.add("structural", "padding", at, size)
            break
        code, name = data[m], _marker(data[m])
        if code == 0xD9:
            out.add("structural", "EOI", at, m + 1)
            if m + 1 < size:
                out.add("trailer", "after EOI", m + 1, size)
            break
        if code == 0x01 or 0xD0 <= code <= 0xD7:
            out.add("structural", name, at, m + 1)
            at = m + 1
            continue
        length = int.from_bytes(data[m + 1 : m + 3]) if m + 3 <= size else None
        stop = m + 1 + (length or 0)
        for broken, said, where in (
            (length is None, "A segment header ran past the end of the file.", "truncated"), (length is not None and length < 2, f"A {name} segment declared an impossible length.", "malformed"),
            (stop > size, f"A {name} segment claimed more bytes than the file holds.", name),
        ):
            if broken:
                out.warnings.append(said)
                out.add("structural", where, at, size)
                return out
        kind, skip = ("comment", 0) if code == 0xFE else ("structural", 0)
        if 0xE0 <= code <= 0xEF:
            kind, skip = next(((k, n) for app, start, k, n in APPS if app == code - 0xE0 and (start is None or data.startswith(start, m + 3, stop))), ("vendor", 0))
        out.add(kind, name, at, stop, (min(m + 3 + skip, stop), stop))
        at = stop
        if code == 0xDA:
            stop = _scan_end(data, at)
            if stop > at:
                out.add("structural", "scan", at, stop)
            at = stop
    return out


def _chunks(data: bytes, at: int, order: str, out: Walk) -> Iterator[tuple[str, int, int]]:
    """(name, start, payload length); ends with a trailer where a chunk claims too much."""
    extra = 12 if order == ">" else 8
    while at + 8 <= len(data):
        size, name = (struct.unpack_from(">I4s", data, at) if order == ">" else struct.unpack_from("<4sI", data, at)[::-1])
        name = name.decode("latin-1")
        if size > 0x7FFFFFFF or at + extra + size > len(data):
            out.warnings.append(f"The {name or 'unnamed'} chunk claimed more bytes than the file holds.")
            out.add("trailer", "truncated", at, len(data))
            out.rewritable = False
            return
        yield name, at, size
        at += extra + size + (size % 2 if order == "<" else 0)


def _png(data: bytes) -> Walk:
    out = Walk("png")
    out.add("structural", "signature", 0, 8)
    at = 8
    for name, start, size in _chunks(data, 8, ">", out):
        at, inner = start + 12 + size, (start + 8, start + 8 + size)
        keyword = data[inner[0] : min(inner[1], inner[0] + 80)].split(b"\0")[0].decode("latin-1") if PNG_KINDS.get(name) == "text" else None
        kind = "xmp" if keyword == "XML:com.adobe.xmp" else PNG_KINDS.get(name, "structural")
        out.add(kind, name, start, at, inner, keyword)
        if name == "IEND":
            break
    if out.rewritable and at < len(data):
        out.add("trailer", "after IEND", at, len(data))
    return out


def _webp(data: bytes) -> Walk:
    out = Walk("webp")
    if struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        out.warnings.append("The container size disagrees with the file length.")
    out.add("structural", "RIFF", 0, 12)
    for name, start, size in _chunks(data, 12, "<", out):
        out.add(WEBP_KINDS.get(name, "structural"), name, start, min(start + 8 + size + size % 2, len(data)), (start + 8, start + 8 + size))
    return out


#: Tags of each directory: label, group, whether it may give someone away.
_T, _A, _D, _TIME, _L, _S = ("technical", False), ("authorship", True), ("device", True), ("time", True), ("location", True), ("software", True)
MAIN = {
    0x0100: ("Image width", *_T), 0x0101: ("Image height", *_T), 0x0102: ("Bits per sample", *_T), 0x0103: ("Compression", *_T), 0x0106: ("Colour interpretation", *_T),
    0x0111: ("Strip offsets", *_T), 0x0115: ("Samples per pixel", *_T), 0x0116: ("Rows per strip", *_T), 0x0117: ("Strip byte counts", *_T), 0x011C: ("Planar configuration", *_T),
    0x010E: ("Image description", *_A), 0x010F: ("Camera make", *_D), 0x0110: ("Camera model", *_D), 0x0112: ("Orientation", *_T), 0x011A: ("X resolution", *_T),
    0x011B: ("Y resolution", *_T), 0x0128: ("Resolution unit", *_T), 0x0131: ("Software", *_S), 0x0132: ("File changed", *_TIME), 0x013B: ("Artist", *_A),
    0x0213: ("YCbCr positioning", *_T), 0x8298: ("Copyright", "authorship", False), 0x9C9B: ("Title (Windows)", *_A), 0x9C9C: ("Comment (Windows)", *_A),
    0x9C9D: ("Author (Windows)", *_A), 0x9C9E: ("Keywords (Windows)", *_A), 0x9C9F: ("Subject (Windows)", *_A),
}
EXIF = {
    0x829A: ("Exposure time", *_T), 0x829D: ("F number", *_T), 0x8822: ("Exposure program", *_T), 0x8827: ("ISO", *_T), 0x9000: ("Exif version", *_T), 0x9003: ("Taken", *_TIME),
    0x9004: ("Digitised", *_TIME), 0x9010: ("Time zone", *_TIME), 0x9011: ("Time zone (taken)", *_TIME), 0x9012: ("Time zone (digitised)", *_TIME), 0x9201: ("Shutter speed", *_T),
    0x9202: ("Aperture", *_T), 0x9204: ("Exposure compensation", *_T), 0x9207: ("Metering mode", *_T), 0x9209: ("Flash", *_T), 0x920A: ("Focal length", *_T), 0x9286: ("User comment", *_A),
    0x927C: ("Maker note", *_D), 0xA002: ("Pixel width", *_T), 0xA003: ("Pixel height", *_T), 0xA405: ("Focal length (35mm)", *_T), 0xA420: ("Image unique ID", *_D),
    0xA430: ("Camera owner", *_A), 0xA431: ("Body serial number", *_D), 0xA432: ("Lens specification", *_T), 0xA433: ("Lens make", *_D), 0xA434: ("Lens model", *_D), 0xA435: ("Lens serial number", *_D),
}
GPS = {
    0x0000: ("GPS version", *_T), 0x0001: ("Latitude ref", *_L), 0x0002: ("Latitude", *_L), 0x0003: ("Longitude ref", *_L), 0x0004: ("Longitude", *_L), 0x0005: ("Altitude ref", *_L),
    0x0006: ("Altitude", *_L), 0x0007: ("GPS time", *_TIME), 0x0008: ("Satellites", *_T), 0x0010: ("Direction ref", *_L), 0x0011: ("Direction", *_L), 0x0012: ("Map datum", *_T),
    0x001B: ("Positioning method", *_L), 0x001D: ("GPS date", *_TIME),
}
TAGS = {"ifd0": MAIN, "exif": EXIF, "gps": GPS, "interop": {}, "ifd1": MAIN}
SOURCES = {"ifd0": "Exif", "exif": "Exif", "gps": "GPS", "interop": "Exif", "ifd1": "Thumbnail"}
POINTERS = {0x8769: ("ifd0", "exif"), 0x8825: ("ifd0", "gps"), 0xA005: ("exif", "interop")}
THUMBNAIL = (0x0201, 0x0202)
#: TIFF type: (bytes, struct code). Floats stay bytes.
TYPES = {1: (1, ""), 2: (1, ""), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, ""), 7: (1, ""), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, ""), 12: (8, "")}
MOST_DIRECTORIES, MOST_ENTRIES = 8, 4096
#: Fixed by the format and by what reports say: turns by orientation, fields of XMP.
TURNS = ("Normal", "Mirrored", "Rotated 180°", "Mirrored, rotated 180°", "Mirrored, rotated 90° CCW", "Rotated 90° CW", "Mirrored, rotated 90° CW", "Rotated 90° CCW")
XMP = (
    (r"xmp:CreatorTool>([^<]+)<", "Created with", "software"), (r'xmp:CreatorTool="([^"]+)"', "Created with", "software"), (r"dc:creator>[\s\S]*?<rdf:li[^>]*>([^<]+)<", "Creator", "authorship"),
    (r"photoshop:DateCreated>([^<]+)<", "Created", "time"), (r"photoshop:City>([^<]+)<", "City", "location"), (r"photoshop:Country>([^<]+)<", "Country", "location"),
    (r"tiff:Make>([^<]+)<", "Camera make", "device"), (r"tiff:Model>([^<]+)<", "Camera model", "device"), (r"exif:GPSLatitude>([^<]+)<", "Latitude (XMP)", "location"),
    (r"exif:GPSLongitude>([^<]+)<", "Longitude (XMP)", "location"),
)


class Entry(NamedTuple):
    ifd: str
    tag: int
    count: int
    kind: str | None  # ascii, ints, rationals or bytes
    value: object


@dataclass
class Tiff:
    entries: list[Entry] = field(default_factory=list)
    thumbnail: tuple[int, int] | None = None
    warnings: list[str] = field(default_factory=list)

    def get(self, ifd: str, tag: int, kind: str):
        found = next((e for e in self.entries if e.ifd == ifd and e.tag == tag), None)
        return found.value if found and found.kind == kind else None


def read_tiff(data: bytes, start: int = 0) -> Tiff | None:
    """Directories breadth first from the header at ``start``; none is read twice, and no offset is trusted."""
    body = memoryview(data)[start:]
    order = {b"II": "<", b"MM": ">"}.get(bytes(body[:2]))
    if len(body) < 8 or not order or struct.unpack_from(order + "H", body, 2)[0] != 42:
        return None
    out, seen, queue, read = Tiff(), set(), [("ifd0", struct.unpack_from(order + "I", body, 4)[0])], 0
    thumb: dict[int, int] = {}
    while queue and read < MOST_DIRECTORIES:
        ifd, at = queue.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        if at + 2 > len(body):
            out.warnings.append("An IFD pointer led outside the file, so some fields may be missing.")
            continue
        read += 1
        count = struct.unpack_from(order + "H", body, at)[0]
        if count > MOST_ENTRIES or at + 2 + 12 * count + 4 > len(body):
            out.warnings.append("An IFD claimed more entries than the file holds, so it was skipped.")
            continue
        for i in range(count):
            place = at + 2 + 12 * i
            tag, kind, n, where = struct.unpack_from(order + "HHII", body, place)
            out.entries.append(Entry(ifd, tag, n, *_value(body, order, kind, n, place + 8 if TYPES.get(kind, (9,))[0] * n <= 4 else where)))
            if tag in POINTERS and POINTERS[tag][0] == ifd:
                queue.append((POINTERS[tag][1], where))
            if ifd == "ifd1" and tag in THUMBNAIL:
                thumb[tag] = where
        if ifd == "ifd0" and (after := struct.unpack_from(order + "I", body, at + 2 + 12 * count)[0]):
            queue.append(("ifd1", after))
    if read >= MOST_DIRECTORIES and queue:
        out.warnings.append("The metadata nests deeper than this reader follows; the rest was ignored.")
    if THUMBNAIL[0] in thumb and thumb.get(THUMBNAIL[1]):
        where, size = thumb[THUMBNAIL[0]], thumb[THUMBNAIL[1]]
        if where + size <= len(body):
            out.thumbnail = (where, size)
        else:
            out.warnings.append("An embedded thumbnail was declared but points outside the file.")
    return out


def _value(body: memoryview, order: str, kind: int, n: int, at: int) -> tuple[str | None, object]:
    size, code = TYPES.get(kind, (0, ""))
    if not size or at + size * n > len(body):
        return None, None
    raw = bytes(body[at : at + size * n])
    if kind == 2:
        return "ascii", raw.rstrip(b"\0").decode("latin-1")
    if not code:
        return "bytes", raw
    numbers = struct.unpack(order + code * n, raw)
    return ("ints", list(numbers)) if len(code) == 1 else ("rationals", list(zip(numbers[::2], numbers[1::2], strict=True)))


def ratio(pair: tuple[int, int]) -> float:
    return pair[0] / pair[1] if pair[1] else 0.0


def degrees(pairs: list) -> float | None:
    return sum(ratio(p) / 60**i for i, p in enumerate(pairs[:3])) if pairs else None


def number(x: float, places: int = 4) -> str:
    """At most so many decimals, without zeros at the end."""
    if not math.isfinite(x):
        return "—"
    return str(int(x)) if x == int(x) else f"{x:.{places}f}".rstrip("0").rstrip(".")


def _utf16(raw: bytes) -> str:
    return raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0]


def _comment(raw: bytes) -> str:
    if raw[:8].rstrip(b"\0") == b"UNICODE":
        return _utf16(raw[8:])
    return raw[8:].split(b"\0")[0].decode("latin-1").strip()


def _seconds(v: list) -> str:
    s = ratio(v[0])
    return f"1/{math.floor(1 / s + 0.5)} s" if 0 < s < 1 else f"{number(s)} s"


#: (directory, tag, kind of value): how it is shown.
SHOWN = {
    **{("ifd0", t, "bytes"): _utf16 for t in range(0x9C9B, 0x9CA0)}, ("exif", 0x9286, "bytes"): _comment, ("exif", 0x829A, "rationals"): _seconds,
    ("ifd0", 0x0112, "ints"): lambda v: TURNS[v[0] - 1] if 1 <= v[0] <= 8 else f"Unknown ({v[0]})",
    ("exif", 0x829D, "rationals"): lambda v: f"f/{number(ratio(v[0]), 1)}", ("exif", 0x920A, "rationals"): lambda v: f"{number(ratio(v[0]), 1)} mm",
    **{("gps", t, "rationals"): lambda v: f"{number(degrees(v), 6)}°" for t in (2, 4)}, ("gps", 7, "rationals"): lambda v: ":".join(f"{math.floor(ratio(p) + 0.5):02d}" for p in v),
    ("gps", 5, "bytes"): lambda v: "Below sea level" if v[:1] == b"\1" else "Above sea level",
}


def shown(e: Entry) -> str:
    if e.kind is None:
        return "—"
    if (e.ifd, e.tag) == ("exif", 0x927C):
        return f"{len(e.value) if e.kind == 'bytes' else e.count} bytes of vendor data"
    if (show := SHOWN.get((e.ifd, e.tag, e.kind))) and e.value:
        return show(e.value)
    if e.kind == "ascii":
        return e.value.strip() or "—"
    if e.kind == "bytes":
        return f"{len(e.value)} bytes"
    return ", ".join(map(str, e.value) if e.kind == "ints" else (number(ratio(p)) for p in e.value))


def coordinates(tiff: Tiff) -> tuple[float, float] | None:
    """(latitude, longitude), or None if missing or out of range."""
    out = []
    for tag, ref, away, most in ((2, 1, "S", 90), (4, 3, "W", 180)):
        value = degrees(tiff.get("gps", tag, "rationals") or [])
        if value is None or abs(value) > most:
            return None
        out.append(-value if (tiff.get("gps", ref, "ascii") or "").upper().startswith(away) else value)
    return out[0], out[1]


def dms(latitude: float, longitude: float) -> str:
    def one(v: float, signs: str) -> str:
        whole, rest = divmod(abs(v), 1)
        minutes, rest = divmod(rest * 60, 1)
        return f"{int(whole)}°{int(minutes)}'{rest * 60:.1f}\"{signs[v < 0]}"

    return f"{one(latitude, 'NS')} {one(longitude, 'EW')}"


def orientation(tiff: Tiff) -> int | None:
    found = tiff.get("ifd0", 0x0112, "ints")
    return found[0] if found and 1 <= found[0] <= 8 else None


#: PNG keywords that are known.
KEYWORDS = {
    "Title": ("Title", *_A), "Author": ("Author", *_A), "Artist": ("Artist", *_A), "Description": ("Description", *_A), "Copyright": ("Copyright", "authorship", False), "Creation Time": ("Created", *_TIME),
    "Software": ("Software", *_S), "Source": ("Source device", *_D), "Comment": ("Comment", *_A),
}


def _png_text(where: str, raw: bytes) -> tuple[str, str] | None:
    keyword, found, rest = raw.partition(b"\0")
    if not found:
        return None
    packed = where == "zTXt" or (where == "iTXt" and rest[:1] == b"\1")
    body, code = rest[1:] if where == "zTXt" else rest, "latin-1"
    if where == "iTXt":
        parts = rest[2:].split(b"\0", 2)
        if len(parts) < 3:
            return keyword.decode("latin-1"), ""
        body, code = parts[2], "utf-8"
    if packed:
        try:
            body = zlib.decompress(body)
        except zlib.error:
            return keyword.decode("latin-1"), f"(compressed, {len(body)} bytes, unreadable)"
    return keyword.decode("latin-1"), body.decode(code, "replace")


def _fields(data: bytes, container: str, s: Segment, report: dict) -> Iterator[tuple]:
    """(source, label, value, group, sensitive) of one segment."""
    raw, size = data[s.payload_start : s.payload_end], s.end - s.start
    if s.kind == "exif":
        tiff = read_tiff(data, s.payload_start)
        if not tiff:
            report["warnings"].append("An Exif block was present but could not be read.")
            return
        report["warnings"] += tiff.warnings
        for e in tiff.entries:
            if e.tag not in POINTERS and e.tag not in THUMBNAIL and (value := shown(e)) not in ("—", ""):
                yield SOURCES[e.ifd], *(TAGS[e.ifd].get(e.tag) or (f"Tag 0x{e.tag:04x}", "technical", True))[:1], value, *(TAGS[e.ifd].get(e.tag) or ("", "technical", True))[1:]
        for key, value in (("coordinates", coordinates(tiff)), ("orientation", orientation(tiff)), ("thumbnail", tiff.thumbnail and (s.payload_start + tiff.thumbnail[0], tiff.thumbnail[1]))):
            report[key] = report[key] or value
    elif s.kind == "xmp":
        text, seen = raw.decode("utf-8", "replace"), set()
        for pattern, label, group in XMP:
            found = re.search(pattern, text)
            if found and found.group(1).strip() and label not in seen:
                seen.add(label)
                yield "XMP", label, found.group(1).strip(), group, True
    elif s.kind in ("text", "comment") and container == "png":
        keyword, value = _png_text(s.where, raw) or ("", "")
        if value.strip():
            label, group, sensitive = KEYWORDS.get(keyword, (keyword or "Text", *_A))
            yield s.where, label, value.strip()[:2000], group, sensitive
    elif s.kind in ("text", "comment"):
        if value := raw.rstrip(b"\0").decode("latin-1").strip():
            yield s.where, "Comment", value[:2000], *_A
    elif s.kind == "iptc":
        yield "IPTC", "IPTC record", f"{size} bytes — may name a photographer, caption, city or country", *_A
    elif s.kind == "mpf":
        yield "MPF", "Extra images", "This file indexes further whole images appended after the visible one", "technical", True
    elif s.kind == "timestamp":
        year, *rest = struct.unpack(">H5B", raw[:7]) if len(raw) >= 7 else (0,)
        yield s.where, "Last modified", "{}-{:02d}-{:02d} {:02d}:{:02d}:{:02d} UTC".format(year, *rest) if rest else f"{len(raw)} bytes", *_TIME


def read(data: bytes) -> dict:
    """The report of one file: container, blocks, fields, coordinates, orientation, thumbnail, metadata bytes, warnings."""
    found = walk(data)
    report = {
        "container": found and found.container, "rewritable": bool(found and found.rewritable), "blocks": [], "fields": [], "coordinates": None, "orientation": None, "thumbnail": None,
        "metadata_bytes": 0, "file_bytes": len(data), "warnings": list(found.warnings) if found else [],
    }
    for s in found.segments if found else ():
        if category := CATEGORY.get(s.kind):
            report["metadata_bytes"] += s.end - s.start
            report["blocks"].append({"kind": s.kind, "where": s.where, "bytes": s.end - s.start, "category": category, "keyword": s.keyword})
            report["fields"] += [dict(zip(("source", "label", "value", "group", "sensitive"), f, strict=True)) for f in _fields(data, found.container, s, report)]
    if found and not found.rewritable and not found.segments:
        report["warnings"].append(f"{found.container.upper()} files are recognised but not yet inspected in detail.")
    return report


def describe(report: dict) -> str:
    if not report["container"]:
        return "This file is not an image format the tool recognises."
    if not report["blocks"]:
        return "No metadata found. This file is already clean."
    groups = {f["group"] for f in report["fields"]}
    parts = [said for on, said in (
        (report["coordinates"], "where it was taken"), ("device" in groups, "the device that took it"), ("time" in groups, "when"), ("authorship" in groups, "who to credit"),
        (report["thumbnail"], "an embedded preview"),
    ) if on]
    if not parts:
        n = len(report["blocks"])
        return f"{n} metadata block{'s' * (n != 1)}, none of it identifying."
    return f"This file records {', '.join(parts[:-1])}{' and ' * (len(parts) > 1)}{parts[-1]}."


REMOVED = ("exif", "xmp", "iptc", "comments", "other")


def turn_tiff(turn: int) -> bytes:
    """The smallest TIFF that keeps a picture upright: one directory with one entry."""
    return struct.pack(">2sHIHHHIHHI", b"MM", 42, 8, 1, 0x0112, 3, 1, turn, 0, 0)


def strip(data: bytes, remove: tuple[str, ...] = REMOVED, keep_orientation: bool = True) -> dict:
    """The file without the categories ``remove``; pixels are copied byte by byte, and a rotation is kept if there is room."""
    found = walk(data)
    if not found:
        return {"ok": False, "reason": "This file is not an image format the tool recognises."}
    if not found.rewritable:
        boxed = "HEIC and AVIF keep metadata inside a box tree of absolute offsets, which this tool can read but not yet rewrite."
        return {"ok": False, "reason": boxed if found.container in ("heic", "avif") else f"Metadata cannot be removed from {found.container.upper()} files yet."}
    goes = lambda s: CATEGORY.get(s.kind) in remove
    kept, removed = [s for s in found.segments if not goes(s)], [s for s in found.segments if goes(s)]
    first = next((s for s in found.segments if s.kind == "exif"), None)
    tiff = read_tiff(data, first.payload_start) if first and "exif" in remove and keep_orientation else None
    turn = orientation(tiff) if tiff else None
    turn = None if turn == 1 else turn
    pieces, warnings, placed = [data[s.start : s.end] for s in kept], list(found.warnings), None
    names = [s.where for s in kept]
    if found.container == "webp":
        for i, s in enumerate(kept):
            if s.where == "VP8X":
                flags = data[s.payload_start]
                for category, bit in VP8X.items():
                    if category in remove and not (category == "exif" and turn):
                        flags &= ~bit
                pieces[i] = data[s.start : s.payload_start] + bytes([flags]) + data[s.payload_start + 1 : s.end]
    if turn:
        body = turn_tiff(turn)
        if found.container == "jpeg":
            at = next((i + 1 for i, n in enumerate(names) if n == "APP0" or (n == "SOI" and names[i + 1 : i + 2] != ["APP0"])), None)
            block = struct.pack(">HH", 0xFFE1, 8 + len(body)) + b"Exif\0\0" + body
        elif found.container == "png":
            at = next((names.index(n) for n in ("IDAT", "IEND") if n in names), None)
            block = struct.pack(">I", len(body)) + b"eXIf" + body + struct.pack(">I", zlib.crc32(b"eXIf" + body))
        else:
            at, block = len(pieces) if "VP8X" in names else None, b"EXIF" + struct.pack("<I", len(body)) + body
        if at is None:
            warnings.append("The image had no place to keep its rotation, so it may appear rotated.")
        else:
            pieces.insert(at, block)
            placed = turn
    out = b"".join(pieces)
    if found.container == "webp":
        out = out[:4] + struct.pack("<I", len(out) - 8) + out[8:]
    return {"ok": True, "content": out, "removed": [{"where": s.where, "kind": s.kind, "bytes": s.end - s.start} for s in removed], "bytes_removed": len(data) - len(out), "orientation": placed, "warnings": warnings}


def pixels(data: bytes) -> bytes | None:
    """What the picture is made of; the same before and after :func:`strip`."""
    found = walk(data)
    if not found or not found.rewritable:
        return None
    only = PIXELS.get(found.container)
    return b"".join(data[s.start : s.end] for s in found.segments if s.kind == "structural" and (only is None or s.where in only))
