from paperloom.operators import infer_kernel as I
from paperloom.operators import markup_kernel as M
from paperloom.operators import office_kernel as O
from paperloom.operators import paginate_kernel as P
from paperloom.operators import qr_kernel as Q


def item(text, x, y, size=11.0, font="Calibri", width=None):
    return (text, x, y, 0.5 * size * len(text) if width is None else width, size, font)


def kinds(items):
    return [b.kind for b in I.blocks_of(I.lines_of(items))]


def test_paragraph_heading_and_list():
    long = "x" * 80
    found = I.blocks_of(I.lines_of([item("Title", 64, 760, 20), item(long, 64, 700), item(long, 64, 684.8), item("•", 82, 660), item("first", 100, 660), item("•", 100, 640), item("inner", 118, 640)]))
    assert [(b.kind, b.level, b.marker, b.depth) for b in found] == [("heading", 1, None, None), ("paragraph", None, None, None), ("list", None, "bullet", 0), ("list", None, "bullet", 1)]
    assert I.as_text(found[1]) == f"{long} {long}" and I.as_text(found[2]) == "first"


def test_table_needs_three_rows_of_two_columns_or_two_of_three():
    row = lambda y, *cells: [item(c, x, y) for c, x in zip(cells, (72, 210, 400), strict=False)]
    assert kinds(row(700, "a", "b", "c") + row(680, "d", "e", "f")) == ["table"]
    assert "table" not in kinds(row(700, "a", "b") + row(680, "d", "e"))
    table = I.blocks_of(I.lines_of(row(700, "a", "b") + row(680, "d", "e") + row(660, "g", "h")))[0]
    assert I.as_text(table) == "a\tb\nd\te\ng\th"


def test_soft_hyphen_joins_and_bold_short_line_is_a_heading():
    lines = I.lines_of([item("y" * 79 + "­", 64, 700), item("end.", 64, 685)])
    assert I.as_text(I.blocks_of(lines)[0]) == "y" * 79 + "end."
    assert kinds([item("Part", 64, 700, font="Calibri-Bold"), item("text text.", 64, 680)]) == ["heading", "paragraph"]


def test_fonts():
    for font, family in (("ABCDEF+Calibri-Bold", "Calibri"), ("TimesNewRomanPSMT", "Times New Roman"), ("Helvetica-Oblique", "Arial"), ("CourierNewPS-BoldMT", "Courier New"), ("MT", "MT")):
        assert I.face(font)["family"] == family, font


def test_markup():
    blocks = M.parse_blocks("<h4>T &amp; U</h4><ul><li>one<ol><li><p>two</p></li></ol></li></ul>loose<table><tr><td colspan=\"2\"><p>a</p><p>b</p></td></tr></table><a href=\"#footnote-7\">x</a>")
    assert [(b["kind"], b.get("level"), b.get("marker"), M.block_text(b)) for b in blocks] == [
        ("heading", 3, None, "T & U"), ("listItem", 1, "•", "one"), ("listItem", 2, "a.", "two"), ("paragraph", None, None, "loose"), ("table", None, None, "a\nb"), ("paragraph", None, None, "x"),
    ]
    assert blocks[4]["rows"][0][0]["span"] == 2 and M.notes_in(blocks[5]) == ["7"] and M.decode("&amp;lt; &#x41; &nope;") == "&lt; A &nope;"
    body, notes = M.split_notes(M.parse_blocks('<p>t<a href="#footnote-1">1</a></p><ol><li><p>note <a href="#footnote-ref-1">up</a></p></li></ol>'))
    assert len(body) == 1 and M.block_text(notes["1"]) == "note "
    assert M.ordered_marker(3, 1994) == "mcmxciv." and M.letters(703) == "aaa" and M.parse_blocks("<") == [] and M.parse_blocks(None) == []


def test_office_round_trip_and_properties():
    blocks = [I.Block("heading", [I.Span("Head", 20, 0, 0, bold=True)], level=2), I.Block("paragraph", [I.Span("a & <b>\x01", 11, 0, 0)]), I.Block("list", [I.Span("i", 11, 0, 0)], marker="number", depth=1), I.Block("table", rows=[[[I.Span("c", 11, 0, 0)], []]])]
    parts = O.unzip(O.package(O.build(blocks)))
    read = O.read_blocks(parts["word/document.xml"], O.numbering(parts["word/numbering.xml"]))
    assert [(b["kind"], b.get("level"), M.block_text(b)) for b in read] == [("heading", 2, "Head"), ("paragraph", None, "a & <b>"), ("listItem", 2, "i"), ("table", None, "c\t")]
    props = O.paragraphs(parts["word/document.xml"], O.styles(parts["word/styles.xml"]))
    assert props[0]["space_before"] == 10 and props[0]["style_id"] == "Heading2"
    assert O.correlate(read, props) == ([0, 1, 2, None], 3, 0)
    xml = f'<w:styles xmlns:w="{O.W}"><w:style w:styleId="A"><w:basedOn w:val="B"/><w:pPr><w:jc w:val="both"/></w:pPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:pPr><w:spacing w:before="200"/></w:pPr></w:style></w:styles>'
    assert O.styles(xml)["A"] == {"space_before": 10.0, "align": "justify"} and O.styles("<broken") == {} and O.page_setup(None) is None


def test_page_fields_and_breaks():
    xml = f'<w:document xmlns:w="{O.W}"><w:body><w:p><w:r><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:t>next</w:t></w:r></w:p><w:p><w:fldSimple w:instr=" NUMPAGES "><w:r><w:t>?</w:t></w:r></w:fldSimple></w:p></w:body></w:document>'
    assert [p.get("page_break_before", False) for p in O.paragraphs(xml)] == [False, True, False]
    assert M.block_text(O.read_blocks(xml, page=2, pages=9)[-1]) == "9"


def para(text, **look):
    return {"kind": "paragraph", "runs": [{"text": text}], "look": look}


def test_wrapping_tabs_and_alignment():
    lines = P.wrap([{"text": "aaaa bbbb cccc"}], 10, 50)
    assert ["".join(p.text for p in n.pieces) for n in lines] == ["aaaa bbbb", "cccc"]
    assert P.wrap([{"text": "a\tb"}], 10, 200)[0].pieces[-1].x == 36 and P.wrap([{"text": "a\tbb"}], 10, 200, tabs=[{"pos": 100, "align": "right"}])[0].pieces[-1].x == 90
    line = P.wrap([{"text": "aa bb"}], 10, 30)[0]
    assert P.align_line(line, "right", 30, True).pieces[0].x == 5 and P.align_line(line, "justify", 30, False).width == 30 and P.align_line(line, "justify", 30, True) is line
    raised = P.wrap([{"text": "x", "script": "super"}], 10, 50)[0].pieces[0]
    assert (round(raised.size, 9), round(raised.rise, 9)) == (7.2, 3.3)


def test_every_paragraph_survives_pagination_and_headings_stay_with_text():
    blocks = [para(f"word{i} " * 40) for i in range(60)]
    pages = P.paginate(blocks)
    drawn = " ".join(p.text for page in pages for d in page for p in d["line"].pieces).split()
    assert len(pages) > 1 and sorted(set(drawn)) == sorted({f"word{i}" for i in range(60)})
    assert all(d["y"] >= 64 for page in pages for d in page)
    two = P.paginate(blocks, columns=2, column_gap=14)
    assert len({round(d["x"]) for d in two[0]}) == 2
    assert len(P.paginate([para("a"), para("b", page_break_before=True)])) == 2


def test_table_with_spans_keeps_joined_rows_together():
    cell = lambda t, span=1, deep=1: {"runs": [{"text": t}], "span": span, "row_span": deep}
    rows = [[cell("a", deep=2), cell("b")], [cell("c")], [cell("d", span=2)]]
    grid, columns = P.grid_of(rows)
    assert columns == 2 and [(g.row, g.column) for g in grid] == [(0, 0), (0, 1), (1, 1), (2, 0)]
    boxes = [d for d in P.paginate([{"kind": "table", "rows": rows}])[0] if d["kind"] == "cell"]
    assert len(boxes) == 4 and abs(boxes[0]["height"] - boxes[1]["height"] - boxes[2]["height"]) < 1e-9


def test_scripts_and_direction():
    assert P.script_segments("नमस्ते world") == [("नमस्ते ", "devanagari"), ("world", "latin")]
    assert P.visual_order(["שלום", " ", "עולם"]) == ([2, 1, 0], True) and P.visual_order(["a", " ", "b"]) == ([0, 1, 2], False)


def test_drawn_pages_are_inferred_back():
    blocks = [{"kind": "heading", "level": 1, "runs": [{"text": "A title"}]}, para("prose " * 60), para("more " * 50)]
    pages = P.text_items(P.paginate(blocks, scale=P.Scale(leading=1.38)))
    found = I.blocks_of(I.lines_of([(t, x, y, w, s, f) for _, t, x, y, w, s, f in pages]))
    assert [b.kind for b in found] == ["heading", "paragraph", "paragraph"] and I.as_text(found[1]) == ("prose " * 60).strip()


def test_qr_reads_back():
    for text, level in (("HELLO WORLD", "Q"), ("12345678901234567890", "L"), ("https://example.com/ä", "M"), ("x" * 500, "H")):
        version, rows = Q.build(text, level)
        size = len(rows)
        said = sum(rows[r][c] << i for i, ((r, c), _) in enumerate(Q._format_places(size))) ^ 0x5412
        mask, fixed = said >> 10 & 7, Q._frame(version)
        assert said >> 13 == Q.LEVELS[level] and Q._bch(said >> 10, 0x537, 10) == said
        bits = ""
        for k, right in enumerate([*range(size - 1, 6, -2), *range(5, 0, -2)]):
            for i in range(size):
                r = size - 1 - i if k % 2 == 0 else i
                bits += "".join(str(rows[r][c] ^ (Q.MASKS[mask](r, c) == 0)) for c in (right, right - 1) if (r, c) not in fixed)
        words = bytes(int(bits[i : i + 8], 2) for i in range(0, 8 * Q.raw_bytes(version), 8))
        assert words == Q.codewords(text, level)[1]
        n, ec = Q.BLOCKS[level][version - 1], Q.EC_BYTES[level][version - 1]
        data = words[: len(words) - n * ec]
        if n == 1:
            assert Q.parity(data, ec) == words[-ec:]
            assert "".join(f"{b:08b}" for b in data).startswith(Q.encode_bits(text, version))
    assert Q.svg([[1]], 2, 1).count("M1 1h1v1h-1z") == 1


def test_pdf_files_and_their_encryption():
    from paperloom.operators import pdf_kernel as F

    pages = P.paginate([para("Hello (world) \\ é 日")], measure=F.helvetica)
    data = F.draw(pages, 595.28, 841.89)
    import re
    import zlib

    streams = [zlib.decompress(m) for m in re.findall(rb"stream\n(.*?)\nendstream", data, re.S)]
    assert b"(\\(world\\))" in streams[0] and b"\xe9" in streams[0] and b"?" in streams[0]
    start = int(re.search(rb"startxref\n(\d+)", data).group(1))
    assert data[start : start + 4] == b"xref" and F.encryption(data) == "none"
    assert F.helvetica("AB", size=1000) == 667 + 667
    import hashlib

    def locked(user):
        """A revision 3 dictionary made from the published algorithm, with a user password."""
        size, perms, ident, owner = 16, -44, b"0123456789abcdef", bytes(range(32))
        key = hashlib.md5((user + F.PADDING)[:32] + owner + (perms & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
        mark = hashlib.md5(F.PADDING + ident).digest()
        for i in range(20):
            mark = F._rc4(bytes(b ^ i for b in key), mark)
        body = f"7 0 obj << /Filter /Standard /V 2 /R 3 /Length 128 /P {perms} /O <{owner.hex()}> /U <{(mark + bytes(16)).hex()}> >> endobj trailer << /Encrypt 7 0 R /ID [<{ident.hex()}> <00>] >>"
        return b"%PDF-1.4 " + body.encode()

    assert F.encryption(locked(b"")) == "owner-only" and F.encryption(locked(b"secret")) == "user-password" and F.encryption(b"%PDF /Encrypt 9 0 R") == "unknown"


def test_text_boxes_and_run_looks():
    xml = f'<w:document xmlns:w="{O.W}" xmlns:mc="{O.MC}"><w:body><w:p><w:r><w:t>before</w:t></w:r><w:r><mc:AlternateContent><mc:Choice><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p></w:body></w:document>'
    boxes = O.text_boxes(xml)
    assert len(boxes) == 1 and M.block_text(boxes[0]["blocks"][0]) == "boxed" and boxes[0]["after_text"] == "before"
    runs = [{"text": "red and "}, {"text": "plain", "bold": True}]
    spans = [{"start": 0, "end": 3, "color": "FF0000", "size": None}]
    assert O.apply_spans(runs, spans, "red  and plain") == [{"text": "red ", "color": "FF0000"}, {"text": "and "}, {"text": "plain", "bold": True}]
    assert O.apply_spans(runs, spans, "other") is runs
    notes = {"1": {"runs": [{"text": "a note"}]}}
    pages = P.with_notes([para("x"), {"kind": "paragraph", "runs": [{"text": "y", "anchor": "#footnote-1"}]}], notes, M.notes_in)
    assert len(pages) == 1
