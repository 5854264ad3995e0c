"""Plain PDF files from drawn items, and what a file's encryption asks for. Plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

#: Widths of Helvetica's printable ASCII, from space to tilde, in thousandths of the size (the standard's metrics).
_WIDTHS = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 "
    "611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
).split()
HELVETICA = {chr(32 + i): int(w) for i, w in enumerate(_WIDTHS)}


def helvetica(text: str, bold: bool = False, italic: bool = False, size: float = 11.0, script: str = "latin") -> float:
    """A measure by Helvetica's widths; characters without one count as a digit."""
    return sum(HELVETICA.get(c, 556) for c in text) * size / 1000


def _string(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", raw) + b")"


def draw(pages: list[list[dict]], width: float, height: float) -> bytes:
    """A file with selectable text in Helvetica; what WinAnsi lacks is drawn as a question mark."""
    objects: list[bytes] = [b"", b""]
    faces = {}
    for key, name in ((0, "Helvetica"), (1, "Helvetica-Bold"), (2, "Helvetica-Oblique"), (3, "Helvetica-BoldOblique")):
        objects.append(b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /BaseFont /%s >>" % name.encode())
        faces[key] = len(objects)
    fonts = b" ".join(b"/F%d %d 0 R" % kv for kv in faces.items())
    kids = []
    for items in pages:
        out = []
        for d in items:
            if d["kind"] == "line":
                for p in d["line"].pieces:
                    if p.text.strip():
                        face = int(bool(p.run.get("bold"))) + 2 * int(bool(p.run.get("italic")))
                        out.append(b"BT /F%d %.2f Tf %.2f %.2f Td %s Tj ET" % (face, p.size, d["x"] + p.x, d["y"] + p.rise, _string(p.text)))
            elif d["kind"] == "rule":
                out.append(b"%.2f %.2f m %.2f %.2f l S" % (d["x"], d["y"], d["x"] + d["width"], d["y"]))
            elif d["kind"] == "cell":
                out.append(b"0.5 w %.2f %.2f %.2f %.2f re S" % (d["x"], d["y"], d["width"], d["height"]))
        stream = zlib.compress(b"\n".join(out))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << %s >> >> /Contents %d 0 R >>" % (width, height, fonts, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[0], objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def _rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) % 256
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) % 256
        j = (j + box[i]) % 256
        box[i], box[j] = box[j], box[i]
        out.append(b ^ box[(box[i] + box[j]) % 256])
    return bytes(out)


def _bytes_of(body: bytes, name: bytes) -> bytes:
    if found := re.search(rb"/" + name + rb"\s*<([0-9A-Fa-f\s]*)>", body):
        return bytes.fromhex(re.sub(rb"\s", b"", found.group(1)).decode())
    if found := re.search(rb"/" + name + rb"\s*\(((?:\\.|[^\\)])*)\)", body, re.S):
        signs = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else signs.get(m[1], m[1]), found.group(1), flags=re.S)
    return b""


def encryption(data: bytes) -> str:
    """none, owner-only (opens with an empty password), user-password, or unknown for handlers of revision 6 and damaged files."""
    found = re.search(rb"/Encrypt\s+(\d+)\s+(\d+)\s+R", data)
    if not found:
        return "none"
    body = re.search(rb"(?<!\d)%s\s+%s\s+obj(.*?)endobj" % (found.group(1), found.group(2)), data, re.S)
    number = lambda name, default: int(m.group(1)) if (m := re.search(rb"/" + name + rb"\s+(-?\d+)", body.group(1))) else default
    if not body:
        return "unknown"
    revision, user, owner = number(b"R", 0), _bytes_of(body.group(1), b"U"), _bytes_of(body.group(1), b"O")
    if revision == 5 and len(user) >= 48:
        return "owner-only" if hashlib.sha256(user[32:40]).digest() == user[:32] else "user-password"
    first = re.search(rb"/ID\s*\[\s*<([0-9A-Fa-f\s]*)>", data)
    if revision not in (2, 3, 4) or len(user) < 32 or len(owner) < 32:
        return "unknown"
    file_id = bytes.fromhex(re.sub(rb"\s", b"", first.group(1)).decode()) if first else b""
    size = 5 if revision == 2 else number(b"Length", 128 if revision == 4 else 40) // 8
    meta = b"\xff\xff\xff\xff" if revision == 4 and re.search(rb"/EncryptMetadata\s+false", body.group(1)) else b""
    key = hashlib.md5(PADDING + owner[:32] + (number(b"P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + file_id + meta).digest()
    if revision == 2:
        return "owner-only" if _rc4(key[:size], PADDING) == user[:32] else "user-password"
    for _ in range(50):
        key = hashlib.md5(key[:size]).digest()
    check = hashlib.md5(PADDING + file_id).digest()
    for i in range(20):
        check = _rc4(bytes(b ^ i for b in key[:size]), check)
    return "owner-only" if check == user[:16] else "user-password"
