"""Markup to blocks of styled runs. Plain Python; one pass over the tags, unknown ones are transparent."""

from __future__ import annotations

import re
from itertools import groupby

from paperloom.functions.text import ENTITIES, PY_WS, ROMAN

_TOKEN, _ENTITY = re.compile("<[^>]+>|[^<]+"), re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);")
_SPACE = re.compile("(?![\t\n])" + PY_WS)
_TAG = re.compile(rf"^</?(.*?)(?:{PY_WS}(.*?))?/?>$", re.S)
LINK = re.compile("^(?:https?:|mailto:|tel:)", re.I)
#: Tag: the counter that it raises.
EMPHASIS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "ins": "underline", "s": "strike", "strike": "strike", "del": "strike"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 3, "h5": 3, "h6": 3}
BULLETS = "•o-"
RUN = ("text", "bold", "italic", "underline", "strike", "script", "href", "anchor")


def decode(text: str) -> str:
    def one(m: re.Match) -> str:
        body = m.group(1)
        if body[0] != "#":
            return ENTITIES.get(body.lower(), m.group())
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m.group()

    return _ENTITY.sub(one, text)


def attribute(attributes: str, name: str) -> str | None:
    for quote in "\"'":
        if found := re.search(f"{name}{PY_WS}*={PY_WS}*{quote}([^{quote}]*){quote}", attributes, re.I):
            return found.group(1)
    return None


def letters(n: int) -> str:
    out, n = "", max(1, n)
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


def roman(n: int) -> str:
    out, n = "", max(1, n)
    for sign, value in ROMAN:
        out, n = out + sign * (n // value), n % value
    return out


def ordered_marker(depth: int, n: int) -> str:
    return (str, letters, roman)[(depth - 1) % 3](n) + "."


def tidy(runs: list[dict]) -> list[dict]:
    """Equal styles joined, white space but tabs and line feeds collapsed, ends trimmed of spaces."""
    style = lambda r: tuple(r.get(k) for k in RUN[1:])
    out = [dict(zip(RUN, ("".join(r["text"] for r in same), *key), strict=True)) for key, same in groupby((r for r in runs if r["text"]), style)]
    for r in out:
        r["text"] = re.sub(f"(?:{_SPACE.pattern})+", " ", r["text"])
    if out:
        out[0]["text"] = out[0]["text"].lstrip(" ")
        out[-1]["text"] = out[-1]["text"].rstrip(" ")
    return [r for r in out if r["text"]]


def _span(value: str | None) -> int:
    try:
        return max(1, int(float(value or 1)))
    except (ValueError, OverflowError):
        return 1


class Reader:
    """Reads one document; ``blocks`` has the result after :meth:`read`."""

    def __init__(self):
        self.blocks: list[dict] = []
        self.on = dict.fromkeys(("bold", "italic", "underline", "strike"), 0)
        self.scripts: list[str] = []
        self.links: list[tuple[str | None, str | None]] = []
        self.lists: list[list] = []  # [ordered, items so far]
        self.runs: list[dict] = []
        self.inside: tuple[str, int] | None = None
        self.table: list | None = None
        self.row: list | None = None
        self.cell: list | None = None
        self.spans = (1, 1)

    def read(self, html: str) -> list[dict]:
        for token in _TOKEN.findall(html):
            if token[0] != "<":
                self.text(token)
                continue
            name, attributes = _TAG.match(token).groups()
            name = name.lower()
            kind = "emphasis" if name in EMPHASIS else "heading" if name in HEADINGS else GROUPS.get(name)
            if kind:
                getattr(self, kind)(name, token.startswith("</"), attributes or "")
        self.flush()
        return self.blocks

    def text(self, raw: str) -> None:
        href, anchor = self.links[-1] if self.links else (None, None)
        run = {"text": decode(raw), "script": self.scripts[-1] if self.scripts else None, "href": href, "anchor": anchor}
        (self.runs if self.cell is None else self.cell).append(run | {k: n > 0 for k, n in self.on.items()})

    def flush(self) -> None:
        runs, self.runs = tidy(self.runs), []
        kind, level = self.inside or ("paragraph", 0)
        self.inside = None
        if not runs:
            return
        block = {"kind": kind, "runs": runs}
        if kind == "heading":
            block["level"] = level
        elif kind == "listItem":
            depth = max(1, len(self.lists))
            ordered, n = self.lists[-1] if self.lists else (False, 0)
            block |= {"level": depth, "ordered": ordered, "marker": ordered_marker(depth, n) if ordered else BULLETS[(depth - 1) % 3]}
        self.blocks.append(block)

    def emphasis(self, name: str, closing: bool, _: str) -> None:
        key = EMPHASIS[name]
        self.on[key] = max(0, self.on[key] + (-1 if closing else 1))

    def raised(self, name: str, closing: bool, _: str) -> None:
        if not closing:
            self.scripts.append("super" if name == "sup" else "sub")
        elif self.scripts:
            self.scripts.pop()

    def link(self, _: str, closing: bool, attributes: str) -> None:
        if closing:
            self.links[-1:] = []
            return
        href = attribute(attributes, "href") or ""
        self.links.append((href if LINK.match(href) else None, href if href.startswith("#") else None))

    def lone(self, name: str, _: bool, attributes: str) -> None:
        if name == "br":
            self.text("\n")
        elif name == "hr":
            self.flush()
            self.blocks.append({"kind": "rule"})
        elif (source := attribute(attributes, "src") or "").startswith("data:image/"):
            self.blocks.append({"kind": "image", "data_uri": source})

    def listing(self, name: str, closing: bool, _: str) -> None:
        self.flush()
        if closing:
            self.lists[-1:] = []
        else:
            self.lists.append([name == "ol", 0])

    def item(self, _: str, closing: bool, __: str) -> None:
        self.flush()
        if not closing:
            if self.lists:
                self.lists[-1][1] += 1
            self.inside = ("listItem", 0)

    def grid(self, name: str, closing: bool, attributes: str) -> None:
        if name == "table":
            self.flush()
            if closing and self.table:
                self.blocks.append({"kind": "table", "rows": self.table})
            self.table = None if closing else []
        elif name == "tr":
            if closing and self.table is not None and self.row is not None:
                self.table.append(self.row)
            self.row = None if closing else []
        elif closing:
            if self.row is not None and self.cell is not None:
                self.row.append({"runs": tidy(self.cell), "span": self.spans[0], "row_span": self.spans[1]})
            self.cell, self.spans = None, (1, 1)
        else:
            self.cell = []
            self.spans = _span(attribute(attributes, "colspan")), _span(attribute(attributes, "rowspan"))

    def heading(self, name: str, closing: bool, _: str) -> None:
        self.flush()
        if not closing:
            self.inside = ("heading", HEADINGS[name])

    def paragraph(self, _: str, closing: bool, __: str) -> None:
        if self.cell is not None:
            if not closing and self.cell:
                self.text("\n")
        elif closing:
            self.flush()
        elif not (self.inside and self.inside[0] == "listItem" and not self.runs):
            self.flush()
            self.inside = ("paragraph", 0)


#: Tag: what handles it.
GROUPS = {
    "sup": "raised", "sub": "raised", "a": "link", "br": "lone", "hr": "lone", "img": "lone", "ul": "listing", "ol": "listing", "li": "item", "table": "grid", "tr": "grid", "td": "grid", "th": "grid",
    "p": "paragraph",
}


def parse_blocks(html: str | None) -> list[dict]:
    return Reader().read(html or "")


def block_text(block: dict) -> str:
    if block["kind"] == "table":
        return "\n".join("\t".join("".join(r["text"] for r in c["runs"]) for c in row) for row in block["rows"])
    return "".join(r["text"] for r in block.get("runs", ()))


def note_id(anchor: str | None, back: bool = False) -> str | None:
    """The note that an anchor points to, or with ``back`` comes back from."""
    found = re.fullmatch(rf"#footnote-{'ref-' if back else ''}([A-Za-z0-9_]+)", anchor or "")
    return found.group(1) if found else None


def notes_in(block: dict) -> list[str]:
    """Distinct notes that a block refers to, in order."""
    return list(dict.fromkeys(i for r in block.get("runs", ()) if (i := note_id(r.get("anchor")))))


def split_notes(blocks: list[dict]) -> tuple[list[dict], dict[str, dict]]:
    """(body, notes by id): blocks with a way back to their mark are notes, and lose it."""
    body, notes = [], {}
    for b in blocks:
        back = next((i for r in b.get("runs", ()) if (i := note_id(r.get("anchor"), True))), None)
        if back is None:
            body.append(b)
        else:
            notes[back] = b | {"runs": [r for r in b["runs"] if note_id(r.get("anchor"), True) is None]}
    return body, notes
