"""The PDF reader on files made by hand and by the writer."""

import hashlib
import zlib

import pytest

from paperloom.operators import markup_kernel as M
from paperloom.operators import paginate_kernel as K
from paperloom.operators import pdf_kernel as P
from paperloom.operators import pdf_text_kernel as R


def file_of(objects, trailer=b""):
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return body + b"trailer\n<< /Root 1 0 R " + trailer + b" >>\n%%EOF"


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def simple(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more=None, head=b"", resources=b""):
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"
    tree = b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 400 300] /Resources << /Font << /F1 5 0 R >> " + resources + b" >> >>"
    return {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: tree, 3: page, 4: stream(content, head), 5: font} | (more or {})


def items(data, **options):
    found = R.read(data, **options)
    assert found["error"] is None
    return [(i["text"], round(i["transform"][4], 2), round(i["transform"][5], 2), round(i["width"], 2)) for p in found["pages"] for i in p["items"]]


def test_written_files_are_read_back():
    blocks = M.parse_blocks("<h1>Title &amp; more</h1><p>some <b>bold</b> (text) \\ and é</p><table><tr><td>a</td><td>b</td></tr></table>" + "<p>" + "word " * 900 + "</p>")
    pages = K.paginate(blocks, K.A4, P.helvetica)
    found = R.read(P.draw(pages, *K.A4[:2]))
    expected = [(n, p.text, round(d["x"] + p.x, 2), round(d["y"] + p.rise, 2), p.width) for n, page in enumerate(pages) for d in page if d["kind"] == "line" for p in d["line"].pieces if p.text.strip()]
    got = [(page["page"], i["text"], i["transform"][4], i["transform"][5], i["width"]) for page in found["pages"] for i in page["items"]]
    assert len(found["pages"]) > 1 and len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=0.02)
    assert found["pages"][0]["fonts"] == ["Helvetica-Bold", "Helvetica"] or set(found["pages"][0]["fonts"]) == {"Helvetica", "Helvetica-Bold"}


def test_operators_move_the_text():
    content = b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 7 Td (ab) Tj 0 -12 TD (c\\)\\101) Tj T* [(x) -500 (y) 100 (z)] TJ (n) ' ET Q BT /F1 8 Tf 1 0 0 1 30 40 Tm <414243> Tj ET"
    assert [x[:3] for x in items(file_of(simple(content)))] == [("ab", 20.0, 34.0), ("c)A", 20.0, 10.0), ("x yz", 20.0, -14.0), ("n", 20.0, -38.0), ("ABC", 30.0, 40.0)]
    wide = items(file_of(simple(b"BT /F1 10 Tf 50 Tz 3 Tc 2 Tw (a b) Tj ET")))[0]
    assert wide[3] == pytest.approx(0.5 * (10 * (556 + 278 + 556) / 1000 + 9 + 2), abs=0.01)


def test_filters_fonts_and_pictures():
    content = b"BT /F1 10 Tf <00010002> Tj ET /Im Do /Fm Do BI /W 1 /H 1 ID \x00\xff EI"
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+Noto /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    more = {
        6: b"<< /Subtype /CIDFontType2 /DW 500 /W [1 [700] 2 3 250] >>", 7: stream(zlib.compress(cmap), b"/Filter /FlateDecode"), 8: stream(b"\x00", b"/Subtype /Image"),
        9: stream(b"BT /F1 5 Tf <0003> Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 100 0]"),
    }
    objects = simple(zlib.compress(content), font, more, b"/Filter [/FlateDecode]", b"/XObject << /Im 8 0 R /Fm 9 0 R >>")
    found = R.read(file_of(objects))["pages"][0]
    assert [(i["text"], i["width"], i["transform"][4]) for i in found["items"]] == [("Hia", pytest.approx(9.5), 0.0), ("b", pytest.approx(1.25), 100.0)]
    assert found["image_count"] == 2 and found["fonts"] == ["ABCDEF+Noto"] and (found["width"], found["height"]) == (400.0, 300.0)
    named = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 65 /Widths [100 200] /Encoding << /Differences [65 /uni00E9 /germandbls] >> >>"
    assert items(file_of(simple(b"BT /F1 10 Tf (ABC) Tj ET", named))) == [("éßC", 0.0, 0.0, pytest.approx(1 + 2 + 7.22))]
    assert items(file_of(simple(b"4254202f46312031302054662028686929 20546a204554>", head=b"/Filter /ASCIIHexDecode")))[0][0] == "hi"
    cut = zlib.compress(b"BT /F1 10 Tf (kept) Tj ET " + bytes(range(256)) * 40)
    assert items(file_of(simple(cut[: len(cut) - 40], head=b"/Filter /FlateDecode")))[0][0] == "kept"


def test_object_streams_and_predictors():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 100 100] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 5: b"<< /Type /Font /BaseFont /Helvetica >>"}
    body, heads = b"", []
    for n, o in inner.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    first = b" ".join(heads) + b" "
    plain = first + body
    width = 16
    plain += b" " * (-len(plain) % width)
    rows, above = b"", bytes(width)
    for i in range(0, len(plain), width):
        row = plain[i : i + width]
        rows += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    packed = stream(zlib.compress(rows), b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns %d >>" % (len(first), width))
    assert items(file_of({4: stream(b"BT /F1 10 Tf 1 2 Td (in) Tj ET"), 9: packed})) == [("in", 1.0, 2.0, 7.78)]


def locked(password):
    """A file by RC4 with 40 bits, whose user password is ``password``."""
    owner, first, allowed = bytes(range(32)), b"0123456789abcdef", -44
    key = hashlib.md5((password + P.PADDING)[:32] + owner + (allowed & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()[:5]
    content = b"BT /F1 10 Tf (secret) Tj ET"
    seal = lambda n, data: P._rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], data)
    objects = simple(seal(4, content)) | {8: b"<< /Filter /Standard /V 1 /R 2 /P %d /O <%s> /U <%s> >>" % (allowed, owner.hex().encode(), P._rc4(key, P.PADDING).hex().encode())}
    return file_of(objects, b"/Encrypt 8 0 R /ID [<%s> <00>]" % first.hex().encode())


def test_passwords_and_damage():
    assert items(locked(b""))[0][0] == "secret" and items(locked(b"open"), password="open")[0][0] == "secret"
    assert R.read(locked(b"open"))["error"] == "needs-password" and R.read(locked(b"open"), "no")["error"] == "wrong-password"
    sealed = file_of(simple(b"") | {8: b"<< /Filter /Standard /V 5 /R 6 >>"}, b"/Encrypt 8 0 R")
    assert R.read(sealed)["error"] == "unsupported encryption"
    for junk in (b"", b"junk", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 1 0 R >>\nendobj", file_of({1: b"<< /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 2 0 R] >>"})):
        assert R.read(junk)["error"] == "damaged"
    whole = file_of(simple(b"BT /F1 10 Tf (x) Tj ET"))
    for cut in range(0, len(whole), 7):  # no file makes the reader fail
        R.read(whole[:cut])
        R.read(whole[:cut] + b"<<[(" + whole[cut:])


def test_cipher_by_the_standard_s_examples():
    import os

    from paperloom.operators import aes_kernel as A

    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, sealed in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key, data, start = bytes(range(n)), os.urandom(16 * 40), os.urandom(16)
        assert A.encrypt(key, plain).hex() == sealed and A.decrypt(key, A.encrypt(key, data, start), start) == data
    assert A.unpadded(A.padded(b"x" * 16)) == b"x" * 16 and A.decrypt(bytes(16), b"short") == b""


@pytest.mark.parametrize("cipher", ["AES-256", "AES-128"])
def test_sealed_files_open_with_either_password(cipher):
    from paperloom.operators import pdf_seal_kernel as S

    blocks = M.parse_blocks("<h1>Title</h1><p>some <b>bold</b> text</p>" + "<p>" + "word " * 700 + "</p>")
    plain = P.draw(K.paginate(blocks, K.A4, P.helvetica), *K.A4[:2])
    expected = R.read(plain)
    allowed = S.permission_bits(printing="low", copying=False)
    sealed = S.protect(plain, "user", "owner", allowed, cipher)["content"]
    assert b"Title" not in sealed and P.encryption(sealed) == "user-password"
    assert R.read(sealed)["error"] == "needs-password" and R.read(sealed, "no")["error"] == "wrong-password"
    for word in ("user", "owner"):
        assert R.read(sealed, word) == expected
        opened = S.unlock(sealed, word)["content"]
        assert P.encryption(opened) == "none" and R.read(opened) == expected
    only = S.protect(plain, "", "owner", allowed, cipher)["content"]
    assert P.encryption(only) == "owner-only" and R.read(only) == expected and f"/P {allowed}".encode() in only
    again = S.protect(only, "new", None, None, cipher)["content"]
    assert R.read(again, "new") == expected and R.read(again)["error"] == "needs-password"
    assert S.protect(b"junk")["error"] == S.unlock(b"junk")["error"] == "damaged" and S.unlock(sealed)["error"] == "needs-password"
    assert R.read(S.unlock(locked(b"open"), "open")["content"])["pages"][0]["items"][0]["text"] == "secret"


def test_permission_bits():
    from paperloom.operators import pdf_seal_kernel as S

    assert S.permission_bits() == -4 and S.permission_bits("none", False, False, False, False) & 0xFFFFFFFF == 0xFFFFF2C0
    assert S.permission_bits("low") & (4 | 2048) == 4
