"""Office Open XML: reading paragraphs, styles, page setup, furniture and blocks; writing packages. Plain Python."""

from __future__ import annotations

import base64
import io
import math
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E

from paperloom.operators.infer_kernel import Block
from paperloom.operators.markup_kernel import BULLETS, ordered_marker

W, R, WP, A = (
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "http://schemas.openxmlformats.org/drawingml/2006/main",
)
PIC = "http://schemas.openxmlformats.org/drawingml/2006/picture"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
for _prefix, _uri in (("w", W), ("r", R), ("wp", WP), ("a", A), ("pic", PIC)):
    E.register_namespace(_prefix, _uri)
EMU = 12700
ALIGN = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}
LOOK_AHEAD, MOST_COLUMNS, MARGIN, COLUMN_GAP, FURNITURE_DISTANCE = 12, 8, 64.0, 14.0, 36.0
PARTS = re.compile(r"^word/(?:document|styles|settings|numbering|header\d*|footer\d*)\.xml$|^word/_rels/document\.xml\.rels$")


def w(name: str) -> str:
    return f"{{{W}}}{name}"


def get(element, name: str, default=None):
    return default if element is None else element.get(w(name), default)


def twips(value: str | None) -> float:
    try:
        return float(value or 0) / 20
    except ValueError:
        return 0.0


def whole(value: float) -> str:
    return str(math.floor(value + 0.5))


def on(element) -> bool:
    """A toggle property: present and not switched off."""
    return element is not None and get(element, "val", "1") not in ("0", "false")


def parse(xml: str | bytes | None):
    """The root, or None for what isn't XML."""
    try:
        return E.fromstring(xml) if xml else None
    except E.ParseError:
        return None


def unzip(data: bytes) -> dict[str, str]:
    """The parts that the reader needs; no other is inflated."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        return {n: package.read(n).decode("utf-8", "replace") for n in package.namelist() if PARTS.match(n)}


def _body_paragraphs(root) -> Iterator:
    """Paragraphs in order, tables and text boxes left out."""
    for child in root:
        if child.tag == w("p"):
            yield child
        elif child.tag not in (w("tbl"), w("sectPr")):
            yield from _body_paragraphs(child)


def text_of(element) -> str:
    """Text of a paragraph or run, tabs and breaks included."""
    signs = {w("tab"): "\t", w("br"): "\n", w("cr"): "\n"}
    out = []
    for part in element:
        if part.tag == w("t"):
            out.append(part.text or "")
        elif part.tag in signs:
            out.append(signs[part.tag])
        elif part.tag not in (w("pPr"), w("rPr"), f"{{{MC}}}Fallback", w("txbxContent")):
            out.append(text_of(part))
    return "".join(out)


def _spacing(ppr) -> dict:
    """Alignment, indents, spacing and tab stops of paragraph properties; only what is given."""
    out: dict = {}
    if ppr is None:
        return out
    if align := ALIGN.get(get(ppr.find(w("jc")), "val", "")):
        out["align"] = align
    ind = ppr.find(w("ind"))
    if ind is not None:
        left = get(ind, "left") or get(ind, "start")
        if left is not None:
            out["indent"] = twips(left)
        if get(ind, "firstLine") is not None:
            out["first_line"] = twips(get(ind, "firstLine"))
        elif get(ind, "hanging") is not None:
            out["first_line"] = -twips(get(ind, "hanging"))
    space = ppr.find(w("spacing"))
    for name, key in (("before", "space_before"), ("after", "space_after")):
        if get(space, name) is not None:
            out[key] = max(0.0, twips(get(space, name)))
    if (line := get(space, "line")) is not None:
        if (rule := get(space, "lineRule", "auto")) in ("exact", "atLeast"):
            out |= {"line_exact": max(0.0, twips(line)), "line_at_least": rule == "atLeast"}
        elif 0 < (multiple := (twips(line) * 20 or 240) / 240) < 10:
            out["line_multiple"] = multiple
    if on(ppr.find(w("contextualSpacing"))):
        out["contextual_spacing"] = True
    stops = [
        {"pos": twips(get(t, "pos")), "align": a if (a := get(t, "val", "left")) in ("right", "center", "decimal") else "left"}
        for t in ppr.iterfind(f"{w('tabs')}/{w('tab')}") if get(t, "pos") is not None and get(t, "val") != "clear"
    ]
    if stops:
        out["tabs"] = sorted(stops, key=lambda t: t["pos"])
    return out


def _size(rpr) -> dict:
    points = twips(get(rpr.find(w("sz")) if rpr is not None else None, "val")) * 10
    return {"size": points} if 4 <= points <= 200 else {}


def styles(xml: str | None) -> dict[str, dict]:
    """Paragraph styles by id, with what they inherit; a cycle of styles inherits nothing further."""
    root = parse(xml)
    raw = {}
    for s in root.iterfind(w("style")) if root is not None else ():
        if get(s, "type", "paragraph") == "paragraph" and get(s, "styleId"):
            raw[get(s, "styleId")] = (_spacing(s.find(w("pPr"))) | _size(s.find(w("rPr"))), get(s.find(w("basedOn")), "val"))
    out = {}
    for name in raw:
        chain, at = [], name
        while at in raw and at not in chain:
            chain.append(at)
            at = raw[at][1]
        out[name] = {k: v for s in reversed(chain) for k, v in raw[s][0].items()}
    return out


def run_spans(paragraph) -> list[dict]:
    """Colour, highlight and size by character offsets, where a run sets one."""
    out, at = [], 0
    for run in paragraph.iter(w("r")):
        size, rpr = len(text_of(run)), run.find(w("rPr"))
        if rpr is not None and size:
            colour, mark = get(rpr.find(w("color")), "val"), get(rpr.find(w("highlight")), "val")
            look = {"color": colour.upper() if colour and colour != "auto" else None, "highlight": mark if mark != "none" else None, "size": _size(rpr).get("size")}
            if any(look.values()):
                out.append({"start": at, "end": at + size} | look)
        at += size
    return out


def paragraphs(document_xml: str | None, defined: dict[str, dict] | None = None) -> list[dict]:
    """Properties of each body paragraph: those of its style, then its own. A page break in an empty paragraph moves on to the
    next with text."""
    root = parse(document_xml)
    out, carried = [], False
    for p in _body_paragraphs(root) if root is not None else ():
        ppr, text = p.find(w("pPr")), text_of(p)
        style = get(ppr.find(w("pStyle")) if ppr is not None else None, "val")
        props = {"text": text, "style_id": style} | (defined or {}).get(style, {})
        own = _spacing(ppr)
        breaks = ppr is not None and on(ppr.find(w("pageBreakBefore")))
        order = [e.tag if e.tag == w("t") else get(e, "type") for e in p.iter() if e.tag == w("t") or (e.tag == w("br") and get(e, "type") == "page")]
        if "page" in order:
            if not text.strip():
                carried = True
            elif order[0] == "page":
                breaks = True
        if carried and text.strip():
            breaks, carried = True, False
        first = next(p.iter(w("r")), None)
        size = _size(ppr.find(w("rPr")) if ppr is not None else None) or _size(first.find(w("rPr")) if first is not None else None)
        if ppr is not None and on(ppr.find(w("bidi"))):
            own["rtl"] = True
        out.append(props | own | size | ({"page_break_before": True} if breaks else {}) | {"run_spans": run_spans(p)})
    return out


def page_setup(document_xml: str | None) -> dict | None:
    """Width, height, margin (the smallest of the four), columns and their gap of the first section; None if there is no usable size."""
    root = parse(document_xml)
    section = next(root.iter(w("sectPr")), None) if root is not None else None
    size = section.find(w("pgSz")) if section is not None else None
    a, b = sorted((twips(get(size, "w")), twips(get(size, "h"))))
    if a <= 72:
        return None
    width, height = (b, a) if get(size, "orient") == "landscape" else (a, b)
    sides = [x for n in ("left", "right", "top", "bottom") if (x := twips(get(section.find(w("pgMar")), n))) > 0]
    columns = section.find(w("cols"))
    n = min(MOST_COLUMNS, max(1, int(twips(get(columns, "num", "1")) * 20)))
    gap = twips(get(columns, "space"))
    return {"width": width, "height": height, "margin": min(min(sides, default=MARGIN), a / 3), "columns": n, "column_gap": gap if gap > 0 else COLUMN_GAP if n > 1 else 0.0}


def image_extents(document_xml: str | None) -> list[tuple[float, float]]:
    """Sizes in points of pictures in order; one without a size keeps its place as (0, 0)."""
    root = parse(document_xml)
    if root is None:
        return []
    for parent in list(root.iter()):
        for child in list(parent):
            if child.tag == f"{{{MC}}}Fallback":
                parent.remove(child)
    found = [(float(e.get("cx", 0)) / EMU, float(e.get("cy", 0)) / EMU) for e in root.iter(f"{{{WP}}}extent")]
    return [s if min(s) > 0 else (0.0, 0.0) for s in found]


def intrinsic_size(data_uri: str) -> tuple[float, float] | None:
    """Points of a PNG or JPEG at 96 dots an inch."""
    try:
        data = base64.b64decode(data_uri.partition(",")[2], validate=False)
    except ValueError:
        return None
    if data.startswith(b"\x89PNG") and len(data) > 24:
        width, height = struct.unpack_from(">II", data, 16)
        return width * 0.75, height * 0.75
    at = 2 if data.startswith(b"\xff\xd8") else len(data)
    while at + 9 < len(data):
        code = data[at + 1]
        if data[at] != 0xFF:
            at += 1
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width * 0.75, height * 0.75
        elif code in (0x01, 0xD8) or 0xD0 <= code <= 0xD9:
            at += 2
        else:
            length = struct.unpack_from(">H", data, at + 2)[0]
            if length < 2:
                return None
            at += 2 + length
    return None


def relationships(xml: str | None) -> dict[str, str]:
    root = parse(xml)
    return {r.get("Id"): r.get("Target") for r in root if r.get("Id")} if root is not None else {}


def furniture_refs(document_xml: str | None, rels: dict[str, str], settings_xml: str | None = None) -> dict:
    """Parts of headers and footers by kind (default, first, even) that are in force, and their distances."""
    root, settings = parse(document_xml), parse(settings_xml)
    section = next(root.iter(w("sectPr")), None) if root is not None else None
    out = {"header": {}, "footer": {}, "header_distance": FURNITURE_DISTANCE, "footer_distance": FURNITURE_DISTANCE}
    if section is None:
        return out
    allowed = {"default"} | ({"first"} if on(section.find(w("titlePg"))) else set()) | ({"even"} if settings is not None and on(settings.find(w("evenAndOddHeaders"))) else set())
    for where in ("header", "footer"):
        for ref in section.iterfind(w(f"{where}Reference")):
            kind, part = get(ref, "type", "default"), rels.get(ref.get(f"{{{R}}}id"))
            if kind in allowed and part:
                out[where][kind] = part
        if (distance := get(section.find(w("pgMar")), where)) is not None:
            out[f"{where}_distance"] = twips(distance)
    return out


def _run(run) -> dict:
    rpr = run.find(w("rPr"))
    flag = lambda name: rpr is not None and on(rpr.find(w(name)))
    raised = get(rpr.find(w("vertAlign")) if rpr is not None else None, "val")
    underline = get(rpr.find(w("u")) if rpr is not None else None, "val", "none") != "none"
    return {"text": text_of(run), "bold": flag("b"), "italic": flag("i"), "underline": underline, "strike": flag("strike"), "script": {"superscript": "super", "subscript": "sub"}.get(raised)}


def _fields(paragraph, page: int, pages: int) -> None:
    """Page fields become plain runs, in both forms."""
    value = lambda code: str(pages) if "NUMPAGES" in code else str(page) if "PAGE" in code else None
    for parent in list(paragraph.iter()):
        for i, child in enumerate(list(parent)):
            if child.tag == w("fldSimple") and (said := value(get(child, "instr", ""))):
                run = E.Element(w("r"))
                E.SubElement(run, w("t")).text = said
                parent[i] = run
    inside, code, shown = False, "", False
    for run in list(paragraph.iter(w("r"))):
        mark = get(run.find(w("fldChar")), "fldCharType")
        if mark == "begin":
            inside, code, shown = True, "", False
        elif inside and run.find(w("instrText")) is not None:
            code += run.find(w("instrText")).text or ""
        elif mark == "end":
            inside = False
        elif inside and run.find(w("t")) is not None and (said := value(code)):
            run.find(w("t")).text = "" if shown else said
            shown = True


def read_blocks(document_xml: str | None, numbering: dict[str, bool] | None = None, page: int | None = None, pages: int = 1) -> list[dict]:
    """Headings, paragraphs, list items and tables of a part, as the markup reader gives them. ``numbering``: whether a list
    id is ordered. With ``page``, page fields are filled in."""
    root = parse(document_xml)
    counts: dict[tuple[str, int], int] = {}
    out: list[dict] = []

    def runs(p) -> list[dict]:
        if page is not None:
            _fields(p, page, pages)
        return [r for r in map(_run, p.iter(w("r"))) if r["text"]]

    def visit(parent) -> None:
        for child in parent:
            if child.tag == w("tbl"):
                rows = [[{"runs": [r for p in c.iter(w("p")) for r in runs(p)], "span": int(twips(get(c.find(f"{w('tcPr')}/{w('gridSpan')}"), "val", "1")) * 20) or 1, "row_span": 1} for c in row.iterfind(w("tc"))] for row in child.iterfind(w("tr"))]
                out.append({"kind": "table", "rows": rows})
            elif child.tag == w("p"):
                found = runs(child)
                if not "".join(r["text"] for r in found).strip():
                    continue
                style = get(child.find(f"{w('pPr')}/{w('pStyle')}"), "val", "")
                heading = re.match(r"(?i)heading ?(\d)", style)
                number = child.find(f"{w('pPr')}/{w('numPr')}")
                if heading:
                    out.append({"kind": "heading", "level": min(3, int(heading.group(1))), "runs": found})
                elif number is not None:
                    depth, list_id = int(twips(get(number.find(w("ilvl")), "val", "0")) * 20) + 1, get(number.find(w("numId")), "val", "")
                    ordered = (numbering or {}).get(list_id, False)
                    n = counts[list_id, depth] = counts.get((list_id, depth), 0) + 1
                    for key in [k for k in counts if k[0] == list_id and k[1] > depth]:
                        del counts[key]
                    out.append({"kind": "listItem", "level": depth, "ordered": ordered, "marker": ordered_marker(depth, n) if ordered else BULLETS[(depth - 1) % 3], "runs": found})
                else:
                    out.append({"kind": "paragraph", "runs": found})
            elif child.tag != w("sectPr"):
                visit(child)

    if root is not None:
        visit(root)
    return out


def text_boxes(document_xml: str | None) -> list[dict]:
    """Blocks of text boxes and the text of the paragraph that each stands in; a fallback drawing isn't read twice."""
    root = parse(document_xml)
    out = []
    for p in _body_paragraphs(root) if root is not None else ():
        for box in p.iter(w("txbxContent")):
            if not any(box in list(f.iter()) for f in p.iter(f"{{{MC}}}Fallback")):
                out.append({"blocks": read_blocks(E.tostring(box, encoding="unicode")), "after_text": text_of(p)})
    return out


def apply_spans(runs: list[dict], spans: list[dict], text: str) -> list[dict]:
    """Runs split where spans begin and end, with their looks. Offsets count in ``text``; both are aligned by their characters
    other than white space, and if those differ the runs stay as they are."""
    joined = "".join(r["text"] for r in runs)
    if "".join(joined.split()) != "".join(text.split()):
        return runs
    places = [i for i, ch in enumerate(text) if not ch.isspace()]
    nth, out = 0, []
    for run in runs:
        for ch in run["text"]:
            place = places[nth] if nth < len(places) else len(text)
            look = next(({k: v for k, v in s.items() if k not in ("start", "end") and v is not None} for s in spans if s["start"] <= place < s["end"]), {}) if not ch.isspace() else (out[-1][0] if out and out[-1][1] is run else {})
            if out and out[-1][0] == look and out[-1][1] is run:
                out[-1][2].append(ch)
            else:
                out.append((look, run, [ch]))
            nth += not ch.isspace()
    return [run | look | {"text": "".join(chars)} for look, run, chars in out]


def numbering(xml: str | None) -> dict[str, bool]:
    """List id: whether its first level counts."""
    root = parse(xml)
    if root is None:
        return {}
    formats = {get(a, "abstractNumId"): get(a.find(f"{w('lvl')}/{w('numFmt')}"), "val", "bullet") for a in root.iterfind(w("abstractNum"))}
    return {get(n, "numId"): formats.get(get(n.find(w("abstractNumId")), "val"), "bullet") != "bullet" for n in root.iterfind(w("num"))}


def plain(text: str) -> str:
    return " ".join(text.split())


def correlate(blocks: list[dict], props: list[dict]) -> tuple[list[int | None], int, int]:
    """(paragraph of each block, matched, missed): texts are matched in order, looking 12 paragraphs ahead; a miss moves nothing."""
    out, at, missed = [], 0, 0
    for b in blocks:
        want = plain("".join(r["text"] for r in b.get("runs", ()))) if b["kind"] in ("paragraph", "heading", "listItem") else ""
        found = next((i for i in range(at, min(len(props), at + LOOK_AHEAD)) if plain(props[i]["text"]) == want), None) if want else None
        missed += bool(want) and found is None
        out.append(found)
        at = at if found is None else found + 1
    return out, sum(i is not None for i in out), missed


# Writing


def clean(text: str) -> str:
    """Without what XML 1.0 forbids."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)


def element(name: str, *children, **values):
    out = E.Element(w(name), {w(k): clean(str(v)) for k, v in values.items()})
    out.extend(c for c in children if c is not None)
    return out


def _text_run(s):
    points = str(max(2, math.floor(2 * s.size + 0.5)))
    family = s.family or ("Courier New" if s.mono else None)
    text = element("t")
    text.text = clean(s.text)
    text.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return element("r", element("rPr", element("rFonts", ascii=family, hAnsi=family, cs=family) if family else None, element("b") if s.bold else None, element("i") if s.italic else None, element("sz", val=points), element("szCs", val=points)), text)


def _paragraph(b: Block):
    props = element("pPr")
    if b.kind == "heading":
        props.append(element("pStyle", val=f"Heading{min(3, max(1, b.level or 3))}"))
    if b.kind == "list":
        props.append(element("numPr", element("ilvl", val=min(2, max(0, b.depth or 0))), element("numId", val=2 if b.marker == "number" else 1)))
    elif (b.indent or 0) > 2:
        props.append(element("ind", left=whole(b.indent * 20)))
    return element("p", props if len(props) else None, *map(_text_run, b.spans))


def _table(b: Block, usable: float) -> list:
    columns = max((len(r) for r in b.rows or ()), default=0)
    if not columns:
        return []
    width = math.floor(math.floor(usable * 20 + 0.5) / columns)
    borders = element("tblBorders", *[element(side, val="single", sz=4, space=0, color="BFBFBF") for side in ("top", "left", "bottom", "right", "insideH", "insideV")])
    cell = lambda spans: element("tc", element("tcPr", element("tcW", w=width, type="dxa")), element("p", *map(_text_run, spans)))
    rows = [element("tr", *[cell(r[i] if i < len(r) else []) for i in range(columns)]) for r in b.rows]
    grid = element("tblGrid", *[element("gridCol", w=width) for _ in range(columns)])
    return [element("tbl", element("tblPr", element("tblW", w=0, type="auto"), element("tblLayout", type="fixed"), borders), grid, *rows), element("p")]


def _styles(font: str, body: float):
    size = lambda pt: (element("sz", val=max(2, math.floor(2 * pt + 0.5))), element("szCs", val=max(2, math.floor(2 * pt + 0.5))))
    defaults = element("docDefaults", element("rPrDefault", element("rPr", element("rFonts", ascii=font, hAnsi=font), *size(body))), element("pPrDefault", element("pPr", element("spacing", after=120, line=259, lineRule="auto"))))
    normal = element("style", element("name", val="Normal"), type="paragraph", default=1, styleId="Normal")
    heads = [
        element("style", element("name", val=f"heading {i}"), element("basedOn", val="Normal"), element("pPr", element("keepNext"), element("spacing", before=20 * gap, after=10 * gap), element("outlineLvl", val=i - 1)),
                element("rPr", element("b"), *size(body * scale)), type="paragraph", styleId=f"Heading{i}")
        for i, scale, gap in ((1, 1.8, 12), (2, 1.45, 10), (3, 1.2, 8))
    ]
    return element("styles", defaults, normal, *heads)


def _numbering():
    def level(i: int, kind: str, text: str, font: str | None = None):
        look = element("rPr", element("rFonts", ascii=font, hAnsi=font, hint="default")) if font else None
        return element("lvl", element("start", val=1), element("numFmt", val=kind), element("lvlText", val=text), element("lvlJc", val="left"), element("pPr", element("ind", left=720 * (i + 1), hanging=360)), look, ilvl=i)

    bullets = [level(i, "bullet", sign, font) for i, (sign, font) in enumerate((("•", "Symbol"), ("o", "Courier New"), ("▪", "Symbol")))]
    numbers = [level(i, kind, f"%{i + 1}.") for i, kind in enumerate(("decimal", "lowerLetter", "lowerRoman"))]
    return element("numbering", element("abstractNum", *bullets, abstractNumId=0), element("abstractNum", *numbers, abstractNumId=1), *[element("num", element("abstractNumId", val=i), numId=i + 1) for i in (0, 1)])


def build(blocks: list[Block], width: float = 595.28, height: float = 841.89, margin: float = 56.7, font: str = "Calibri", body: float = 11.0) -> dict[str, bytes]:
    """Parts of a package; a block of kind pagebreak starts a page."""
    content: list = []
    for b in blocks:
        if b.kind == "pagebreak":
            content.append(element("p", element("r", element("br", type="page"))))
        else:
            content += _table(b, width - 2 * margin) if b.kind == "table" else [_paragraph(b)]
    edge = whole(margin * 20)
    content.append(element("sectPr", element("pgSz", w=whole(width * 20), h=whole(height * 20)), element("pgMar", top=edge, right=edge, bottom=edge, left=edge, header=0, footer=0, gutter=0)))
    xml = lambda root: E.tostring(root, encoding="UTF-8", xml_declaration=True)
    office = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    kinds = E.Element("Types", xmlns="http://schemas.openxmlformats.org/package/2006/content-types")
    for extension, kind in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml")):
        E.SubElement(kinds, "Default", Extension=extension, ContentType=kind)
    for part, kind in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering")):
        E.SubElement(kinds, "Override", PartName=f"/word/{part}.xml", ContentType=f"{office}.{kind}+xml")

    def rels(*targets: tuple[str, str]):
        root = E.Element("Relationships", xmlns="http://schemas.openxmlformats.org/package/2006/relationships")
        for i, (kind, target) in enumerate(targets):
            E.SubElement(root, "Relationship", Id=f"rId{i + 1}", Type=f"{R}/{kind}", Target=target)
        return root

    return {
        "[Content_Types].xml": xml(kinds), "_rels/.rels": xml(rels(("officeDocument", "word/document.xml"))), "word/document.xml": xml(element("document", element("body", *content))),
        "word/_rels/document.xml.rels": xml(rels(("styles", "styles.xml"), ("numbering", "numbering.xml"))), "word/styles.xml": xml(_styles(font, body)), "word/numbering.xml": xml(_numbering()),
    }


def package(parts: dict[str, bytes], stored: bool = False) -> bytes:
    """A ZIP of the parts, the same for the same parts; ``stored`` leaves them uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED, compresslevel=6) as target:
        for name, data in parts.items():
            target.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, compress_type=zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()
