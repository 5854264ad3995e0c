import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pictures import chunk, jpeg, png, rich, segment, webp

from paperloom.operators import imgmeta_kernel as K

XMP = b"<x><xmp:CreatorTool>Tool</xmp:CreatorTool><photoshop:City>Town</photoshop:City></x>"
FILES = {
    "jpeg": jpeg(rich("<"), segment(0xFE, b"hello") + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP) + segment(0xED, b"Photoshop 3.0\0x"), b"trailing"),
    "jpeg_be": jpeg(rich(">")), "png": png(rich(">"), chunk(b"tEXt", b"Author\0Someone"), chunk(b"tIME", b"\x07\xe8\x01\x02\x03\x04\x05")), "webp": webp(rich("<"), XMP, 0x0C), "plain": jpeg(),
}


def tiles(data):
    found = K.walk(data)
    at = 0
    for s in found.segments:
        assert s.start == at and s.start <= s.payload_start <= s.payload_end <= s.end
        at = s.end
    return at == len(data)


@pytest.mark.parametrize("name", FILES)
def test_segments_tile_the_file_and_pixels_stay(name):
    data = FILES[name]
    assert tiles(data)
    out = K.strip(data)
    assert out["ok"] and K.pixels(out["content"]) == K.pixels(data)
    again = K.strip(out["content"])
    assert again["content"] == out["content"]  # idempotent
    assert K.strip(data, ())["content"] == data
    assert out["orientation"] == (None if name == "plain" else 6)


def test_report_of_a_rich_file():
    report = K.read(FILES["jpeg"])
    shown = {f["label"]: f["value"] for f in report["fields"]}
    assert shown["Camera make"] == "Maker" and shown["Orientation"] == "Rotated 90° CW" and shown["Exposure time"] == "1/250 s" and shown["F number"] == "f/2.8"
    assert shown["Body serial number"] == "SN12345" and shown["City"] == "Town" and shown["Comment"] == "hello"
    latitude, longitude = report["coordinates"]
    assert round(latitude, 6) == -33.858667 and round(longitude, 6) == 151.21
    assert K.dms(latitude, longitude) == "33°51'31.2\"S 151°12'36.0\"E"
    assert report["thumbnail"] and report["orientation"] == 6
    assert K.describe(report) == "This file records where it was taken, the device that took it, who to credit and an embedded preview."
    assert K.describe(K.read(K.strip(FILES["plain"])["content"])) == "No metadata found. This file is already clean."
    assert {f["label"]: f["value"] for f in K.read(FILES["png"])["fields"]}["Last modified"] == "2024-01-02 03:04:05 UTC"


def test_orientation_is_off_when_not_wanted_and_webp_flags_follow():
    assert K.read(K.strip(FILES["jpeg"], keep_orientation=False)["content"])["orientation"] is None
    out = K.strip(FILES["webp"])["content"]
    head = next(s for s in K.walk(out).segments if s.where == "VP8X")
    assert out[head.payload_start] == 0x08 and not K.walk(out).warnings


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_damage_never_raises(name, data):
    raw = bytearray(FILES[name])
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(3, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = bytes(raw[: data.draw(st.integers(4, len(raw)))])
    if K.walk(raw):
        K.read(raw)
        K.strip(raw)
        assert tiles(raw) or not K.walk(raw).segments or not K.walk(raw).rewritable or K.detect(raw) == "webp"
