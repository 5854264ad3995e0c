"""Line breaking and pagination of blocks. Plain Python; units are points, y grows upwards from the page's foot.

``measure(text, bold, italic, size, script)`` gives a width, from a table of glyph widths or a rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from paperloom.functions.text import PY_WS, SCRIPTS

A4, LETTER = (595.28, 841.89, 64.0), (612.0, 792.0, 64.0)
TAB, RAISED, GAP, PAD, LIST_STEP, MOST_COLUMNS = 36.0, 0.72, 8.0, 4.0, 18.0, 8
RIGHT_TO_LEFT = {"arabic", "hebrew"}
_TOKEN = re.compile(rf"\t|\n|(?:(?![\t\n]){PY_WS})+|(?:(?!{PY_WS}).)+", re.S)
_BLANK = re.compile(rf"(?:(?![\t\n]){PY_WS})+")
Measure = Callable[..., float]


@dataclass
class Scale:
    body: float = 11.0
    headings: tuple = (20.0, 15.5, 12.5)
    leading: float = 1.38
    single: float = 1.2207


@dataclass
class Piece:
    text: str
    run: dict
    script: str
    size: float
    x: float
    width: float
    rise: float = 0.0


@dataclass
class Line:
    pieces: list[Piece]
    size: float
    height: float

    @property
    def width(self) -> float:
        return self.pieces[-1].x + self.pieces[-1].width if self.pieces else 0.0


@dataclass
class Grid:
    cell: dict
    row: int
    column: int
    span: int
    rows: int
    lines: list[Line] = field(default_factory=list)


def half_em(text: str, bold: bool = False, italic: bool = False, size: float = 11.0, script: str = "latin") -> float:
    """The simplest measure: half the size for each character."""
    return 0.5 * size * len(text)


def script_of(ch: str) -> str:
    code = ord(ch)
    return next((name for name, spans in SCRIPTS.items() if any(lo <= code <= hi for lo, hi in spans)), "latin")


#: Spaces, tab, joiners, soft hyphen and variation selectors have no script of their own.
NEUTRAL = {0x20, 0x09, 0x200C, 0x200D, 0xA0, 0xAD, *range(0xFE00, 0xFE10)}


def script_segments(text: str) -> list[tuple[str, str]]:
    """(text, script): maximal stretches; a neutral goes with what stands before it, at the start with what follows."""
    out: list[list[str]] = []
    waiting = ""
    for ch in text:
        if ord(ch) in NEUTRAL:
            if out:
                out[-1][0] += ch
            else:
                waiting += ch
            continue
        script = script_of(ch)
        if out and out[-1][1] == script:
            out[-1][0] += ch
        else:
            out.append([waiting + ch, script])
            waiting = ""
    return [(t, s) for t, s in out] or ([(waiting, "latin")] if waiting else [])


def visual_order(texts: list[str], right_to_left: bool | None = None) -> tuple[list[int], bool]:
    """Order in which tokens stand on a line, and whether its base runs right to left (by its first strong letter if not given).

    Token levels follow the first strong character; neutral tokens take the level of both neighbours if they agree, else
    the base. Levels are then reversed from the highest to the lowest odd one (UAX #9, L2).
    """
    strong = lambda t: next((d for c in t if (d := unicodedata.bidirectional(c)) in ("L", "R", "AL", "EN", "AN")), None)
    kinds = [strong(t) for t in texts]
    base = right_to_left if right_to_left is not None else next((k != "L" for k in kinds if k in ("L", "R", "AL")), False)
    levels: list[int | None] = [None if k is None else 1 if k in ("R", "AL") else 2 if base or k == "AN" else 0 for k in kinds]
    if not base:
        for i, k in enumerate(kinds):  # numbers after right-to-left letters stay with them
            if k == "EN" and next((levels[j] for j in range(i - 1, -1, -1) if kinds[j] in ("L", "R", "AL")), 0) == 1:
                levels[i] = 2
    for i, level in enumerate(levels):
        if level is None:
            before = next((levels[j] for j in range(i - 1, -1, -1) if kinds[j] is not None), int(base))
            after = next((levels[j] for j in range(i + 1, len(levels)) if kinds[j] is not None), int(base))
            levels[i] = 1 if (before > 0 and after > 0) else int(base)
    order = list(range(len(texts)))
    for level in range(max(levels, default=0), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return order, base


class Wrapper:
    """Breaks runs into lines of a width; the first word of a line stays whatever its width."""

    def __init__(self, size: float, width: float, measure: Measure, tabs: list[dict], bidi: bool, rtl: bool):
        self.size, self.width, self.measure, self.tabs, self.bidi, self.rtl = size, width, measure, tabs, bidi, rtl
        self.lines: list[Line] = []
        self.pieces: list[Piece] = []
        self.x = 0.0

    def tokens(self, runs: list[dict]) -> list[Piece]:
        out = []
        for run in runs:
            base = run.get("size") or self.size
            raised = run.get("script")
            size, rise = (base * RAISED, base * (0.33 if raised == "super" else -0.16)) if raised else (base, 0.0)
            for text, script in script_segments(run["text"]):
                for t in _TOKEN.findall(text):
                    width = 0.0 if t in "\t\n" else self.measure(t, bool(run.get("bold")), bool(run.get("italic")), size, script)
                    out.append(Piece(t, run, script, size, 0.0, width, rise))
        return out

    def run(self, runs: list[dict]) -> list[Line]:
        tokens = self.tokens(runs)
        for i, t in enumerate(tokens):
            if t.text == "\n":
                self.end_line()
            elif t.text == "\t":
                self.jump(t, tokens[i + 1 :])
            elif _BLANK.fullmatch(t.text):
                if self.x > 0:
                    self.place(t)
            else:
                if self.x + t.width > self.width and self.x > 0:
                    self.end_line()
                self.place(t)
        if self.pieces:
            self.end_line()
        last = len(self.lines) - 1
        return [line for i, line in enumerate(self.lines) if line.pieces or 0 < i < last]

    def place(self, t: Piece) -> None:
        self.pieces.append(replace(t, x=self.x))
        self.x += t.width

    def jump(self, t: Piece, following: list[Piece]) -> None:
        """To the next stop: given ones, a right one leaving room for what follows, else a grid of half an inch."""
        stop = next((s for s in self.tabs if s["pos"] > self.x + 0.01), None)
        target = stop["pos"] if stop else (self.x // TAB + 1) * TAB
        if stop and stop["align"] == "right":
            ahead = 0.0
            for n in following:
                if n.text in ("\t", "\n"):
                    break
                ahead += n.width
            target = max(self.x, min(stop["pos"], self.width) - ahead)
        if target >= self.width:
            self.end_line()
        else:
            self.place(replace(t, text="", width=max(0.0, target - self.x)))

    def end_line(self) -> None:
        while self.pieces and self.pieces[-1].text and not self.pieces[-1].text.strip(" "):
            self.pieces.pop()
        if self.bidi and (self.rtl or any(p.script in RIGHT_TO_LEFT for p in self.pieces)):
            order, _ = visual_order([p.text for p in self.pieces], True if self.rtl else None)
            self.pieces, x = [self.pieces[i] for i in order], 0.0
            for p in self.pieces:
                p.x, x = x, x + p.width
        self.lines.append(Line(self.pieces, self.size, max([self.size, *(p.size for p in self.pieces)])))
        self.pieces, self.x = [], 0.0


def wrap(runs: list[dict], size: float, width: float, measure: Measure = half_em, tabs: list[dict] | None = None, bidi: bool = False, rtl: bool = False) -> list[Line]:
    return Wrapper(size, width, measure, tabs or [], bidi, rtl).run(runs)


def align_line(line: Line, align: str, width: float, last: bool) -> Line:
    """Shifted for centre and right; justified unless it is the last or more than a quarter is empty."""
    slack = width - line.width
    if slack <= 0 or line.width <= 0:
        return line
    if align in ("center", "right"):
        shift = slack / 2 if align == "center" else slack
        return replace(line, pieces=[replace(p, x=p.x + shift) for p in line.pieces])
    blanks = sum(bool(p.text) and not p.text.strip(" ") for p in line.pieces)
    if align != "justify" or last or not blanks or slack > 0.25 * width:
        return line
    extra, shift, out = slack / blanks, 0.0, []
    for p in line.pieces:
        grows = bool(p.text) and not p.text.strip(" ")
        out.append(replace(p, x=p.x + shift, width=p.width + extra * grows))
        shift += extra * grows
    return replace(line, pieces=out)


def column_widths(n: int, available: float, gap: float = GAP) -> list[float]:
    return [max(24.0, (available - gap * (n - 1)) / n)] * n if n > 0 else []


def span_width(widths: list[float], start: int, span: int, gap: float = GAP) -> float:
    taken = widths[start : start + max(1, span)]
    return sum(taken) + gap * max(0, len(taken) - 1)


def column_offset(widths: list[float], start: int, gap: float = GAP) -> float:
    start = max(0, start)
    return sum(widths[:start]) + gap * start


def table_columns(rows: list[list[dict]]) -> int:
    return max([1, *(sum(max(1, c.get("span") or 1) for c in row) for row in rows)])


def grid_of(rows: list[list[dict]]) -> tuple[list[Grid], int]:
    """Cells in the places that spans leave free, and the number of columns."""
    taken: set[tuple[int, int]] = set()
    out, columns = [], 1
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            span, deep = max(1, cell.get("span") or 1), min(max(1, cell.get("row_span") or 1), len(rows) - r)
            out.append(Grid(cell, r, c, span, deep))
            taken |= {(i, j) for i in range(r, r + deep) for j in range(c, c + span)}
            c += span
            columns = max(columns, c)
    return out, columns


class Flow:
    """Places blocks on pages, column by column."""

    def __init__(self, width: float, height: float, margin: float, measure: Measure, scale: Scale, columns: int, gap: float, top: float, bottom, bidi: bool):
        self.margin, self.measure, self.scale, self.bidi = margin, measure, scale, bidi
        self.columns, self.gap, self.bottom = max(1, min(int(columns), MOST_COLUMNS)), max(0.0, gap), bottom
        self.text = (width - 2 * margin - self.gap * (self.columns - 1)) / self.columns
        self.head = height - margin - max(0.0, top)
        self.pages: list[list[dict]] = [[]]
        self.column, self.left, self.y = 0, margin, self.head

    def fits(self, needed: float) -> bool:
        foot = self.bottom(len(self.pages) - 1) if callable(self.bottom) else self.bottom
        return self.y - needed >= self.margin + max(0.0, foot or 0.0)

    def advance(self) -> None:
        """To the next column, or the next page after the last."""
        self.column += 1
        if self.column == self.columns:
            self.column = 0
            self.pages.append([])
        self.left, self.y = self.margin + self.column * (self.text + self.gap), self.head

    def draw(self, kind: str, x: float, y: float, **rest) -> None:
        self.pages[-1].append({"kind": kind, "x": x, "y": y, **rest})

    def rule(self, _: dict, *__) -> None:
        if not self.fits(14):
            self.advance()
        self.y -= 8
        self.draw("rule", self.left, self.y, width=self.text)
        self.y -= 6

    def image(self, block: dict, *_) -> None:
        width, height = block.get("width") or 0, block.get("height") or 0
        fit = min(1.0, self.text / width) if width > 0 and height > 0 else None
        width, height = (width * fit, height * fit) if fit else (self.text, self.text * 0.75)
        pad = min(6.0, max(1.0, height / 4))
        if not self.fits(height + 2 * pad):
            self.advance()
        self.draw("image", self.left, self.y - pad - height, width=width, height=height)
        self.y -= height + 2 * pad

    def table(self, block: dict, *_) -> None:
        rows, cells = block["rows"], grid_of(block["rows"])
        placed, columns = cells
        widths = column_widths(columns, self.text)
        step = self.scale.body * self.scale.leading
        line_step = lambda line: max(step, line.height * self.scale.leading)
        heights = [step + 2 * PAD] * len(rows)
        for g in sorted(placed, key=lambda g: g.rows > 1):  # cells of one row first: the others need what those leave
            inner = max(24.0, span_width(widths, g.column, g.span) - 2 * PAD)
            lines = wrap(g.cell["runs"], self.scale.body, inner, self.measure, bidi=self.bidi)
            g.lines = [align_line(n, g.cell.get("align") or "left", inner, i == len(lines) - 1) for i, n in enumerate(lines)]
            need = sum(map(line_step, g.lines)) + 2 * PAD
            have = sum(heights[g.row : g.row + g.rows])
            heights[g.row + g.rows - 1] += max(0.0, need - have)
        at = 0
        while at < len(rows):  # rows that a cell joins are kept on one page
            end = at + 1
            while grown := max([end, *(g.row + g.rows for g in placed if at <= g.row < end)]) - end:
                end += grown
            if not self.fits(sum(heights[at:end])):
                self.advance()
            for g in (g for g in placed if at <= g.row < end):
                x, top = self.left + column_offset(widths, g.column), self.y - sum(heights[at : g.row])
                tall = sum(heights[g.row : g.row + g.rows])
                self.draw("cell", x, top - tall, width=span_width(widths, g.column, g.span), height=tall)
                y = top - PAD - max(self.scale.body, g.lines[0].height if g.lines else 0.0)
                for line in g.lines:
                    self.draw("line", x + PAD, y, line=line)
                    y -= line_step(line)
            self.y -= sum(heights[at:end])
            at = end
        self.y -= 8

    def prose(self, block: dict, before: dict | None, after: dict | None) -> None:
        look, scale, kind = block.get("look") or {}, self.scale, block["kind"]
        if look.get("page_break_before") and self.pages[-1]:
            self.advance()
        size = look.get("size") or (scale.headings[min(3, block["level"]) - 1] if kind == "heading" else scale.body)
        single = size * scale.single
        step = size * scale.leading
        if look.get("line_exact") is not None:
            step = max(look["line_exact"], single) if look.get("line_at_least") else look["line_exact"]
        elif look.get("line_multiple") is not None:
            step = single * look["line_multiple"]
        item = kind == "listItem"
        indent = (LIST_STEP * block["level"] if item else 0.0) + max(0.0, look.get("indent") or 0.0)
        marker, first = LIST_STEP * item, look.get("first_line") or 0.0
        room = self.text - indent - marker - max(0.0, first)
        stops = [t | {"pos": t["pos"] - indent} for t in look.get("tabs") or () if t["pos"] > indent]
        lines = wrap(block["runs"], size, room, self.measure, stops, self.bidi, bool(look.get("rtl")))
        if not lines:
            return
        align = look.get("align") or ("right" if look.get("rtl") else "left")
        lines = [align_line(n, align, room, i == len(lines) - 1) for i, n in enumerate(lines)]
        close = lambda other: look.get("contextual_spacing") and other is not None and other["kind"] == kind
        given = lambda key, default: default if look.get(key) is None else look[key]
        above = 0.0 if close(before) else given("space_before", size * 0.85 if kind == "heading" else scale.body * 0.5)
        below = 0.0 if close(after) else given("space_after", size * 0.25 if kind == "heading" else 0.0)
        needed = above + (len(lines) * step + scale.body * scale.leading if kind == "heading" else step)
        if self.fits(needed) or not self.pages[-1]:
            self.y -= above
        else:
            self.advance()
        for i, line in enumerate(lines):
            tall = max(size, line.height)
            if not self.fits(step * tall / size) and self.pages[-1]:
                self.advance()
            self.y -= tall
            if item and i == 0:
                sign = Piece(block["marker"], {}, "latin", size, 0.0, self.measure(block["marker"], False, False, size, "latin"))
                self.draw("line", self.left + indent, self.y, line=Line([sign], size, size))
            self.draw("line", self.left + indent + marker + max(0.0, first) + (first if i == 0 else 0.0), self.y, line=line)
            self.y -= step * tall / size - tall
        if after is not None:
            self.y -= below


def paginate(blocks: list[dict], geometry: tuple = A4, measure: Measure = half_em, scale: Scale | None = None, columns: int = 1, column_gap: float = 0.0, inset_top: float = 0.0, inset_bottom=0.0, bidi: bool = False) -> list[list[dict]]:
    """Pages of drawn items. ``inset_bottom`` may be a function of the page's number, for notes at its foot."""
    flow = Flow(*geometry, measure, scale or Scale(), columns, column_gap, inset_top, inset_bottom, bidi)
    for before, block, after in zip([None, *blocks[:-1]], blocks, [*blocks[1:], None], strict=True):
        getattr(flow, {"rule": "rule", "image": "image", "table": "table"}.get(block["kind"], "prose"))(block, before, after)
    return [p for p in flow.pages if p]


def with_notes(blocks: list[dict], notes: dict[str, dict], refers: Callable[[dict], list[str]], rounds: int = 4, **options) -> list[list[dict]]:
    """Pages laid out again until the room at each foot fits the notes of its page, four times at most."""
    reserved: dict[int, float] = {}
    pages: list[list[dict]] = []
    for _ in range(rounds):
        pages = paginate(blocks, inset_bottom=lambda n: reserved.get(n, 0.0), **options)
        need = {}
        for n, items in enumerate(pages):
            ids = dict.fromkeys(i for d in items if d["kind"] == "line" for p in d["line"].pieces for i in refers({"runs": [p.run]}) if i in notes)
            need[n] = sum(len(wrap(notes[i]["runs"], 9.0, 400.0, options.get("measure", half_em))) * 12.0 for i in ids) + 10.0 * bool(ids)
        if all(abs(need.get(n, 0.0) - reserved.get(n, 0.0)) < 0.5 for n in {*need, *reserved}):
            break
        reserved = need
    return pages


def text_items(pages: list[list[dict]]) -> list[tuple]:
    """(page, text, x, y, width, size, font) of drawn lines: what layout inference takes."""
    out = []
    for n, items in enumerate(pages):
        for d in items:
            for p in d["line"].pieces if d["kind"] == "line" else ():
                if p.text:
                    font = "Calibri" + "-Bold" * bool(p.run.get("bold")) + "-Italic" * bool(p.run.get("italic"))
                    out.append((n, p.text, d["x"] + p.x, d["y"] + p.rise, p.width, p.size, font))
    return out
