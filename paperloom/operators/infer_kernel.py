"""Structure of a page from its positioned text: lines, headings, paragraphs, lists and tables. Plain Python.

Units are points, y grows upwards. An item is (text, x, y, width, size, font).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

from paperloom.functions.text import BULLETS, NUMBERED, PY_WS

#: Share of the text size: height that one baseline may vary, gap that is a space, gap that is a jump, gap between cells.
BASELINE, SPACE, JUMP, CELL = 0.35, 0.22, 0.8, 2.5
#: Points that a column may move; leading within a paragraph; width of a full line; sizes of headings over the body's.
COLUMN, LEADING, FULL = 3.0, 1.6, 0.82
HEADINGS = ((1.6, 1), (1.3, 2), (1.12, 3))
TIER, DEEPEST = 6.0, 2
#: Font families that go by another name, and words of a name that tell its face.
ALIASES = {
    "helvetica": "Arial", "arial": "Arial", "times": "Times New Roman", "timesnewroman": "Times New Roman", "courier": "Courier New", "couriernew": "Courier New",
    "symbol": "Symbol", "zapfdingbats": "Wingdings",
}
FACES = (
    "regular book roman italic oblique bold black heavy semibold demibold demi light thin extralight ultralight medium condensed narrow expanded mt ps psmt it ital bd bi blk rg obl"
).split()
#: Fixed: faces that are recognised without a separator before them, tried in turn, longer ones first.
GLUED = ("BoldItalic", "BoldOblique", "Regular", "Italic", "Oblique", "SemiBold", "DemiBold", "Bold", "Black", "Heavy", "Light", "Thin", "Medium", "PSMT", "MT", "PS")

_LEAD, _TRAIL, _RUNS, _ENDS_WS = re.compile(f"^{PY_WS}+"), re.compile(f"{PY_WS}+$"), re.compile(f"{PY_WS}{{2,}}"), re.compile(f"{PY_WS}$")
_STARTS_WS, _BULLET, _NUMBER = re.compile(f"^{PY_WS}"), re.compile(BULLETS), re.compile(NUMBERED)


@dataclass
class Span:
    text: str
    size: float
    x: float
    width: float
    bold: bool = False
    italic: bool = False
    mono: bool = False
    family: str | None = None

    @property
    def gap(self) -> bool:
        return bool(self.text) and not strip(self.text) and self.width > JUMP * self.size

    def like(self, other: Span) -> bool:
        return (self.bold, self.italic, self.mono, self.family) == (other.bold, other.italic, other.mono, other.family) and abs(self.size - other.size) < 0.6


@dataclass
class Line:
    spans: list[Span]
    x: float
    right: float
    y: float
    size: float


@dataclass
class Block:
    kind: str
    spans: list[Span] = field(default_factory=list)
    level: int | None = None
    marker: str | None = None
    indent: int | None = None
    depth: int | None = None
    rows: list[list[list[Span]]] | None = None


def strip(text: str) -> str:
    return _TRAIL.sub("", _LEAD.sub("", text))


def js_round(x: float) -> int:
    return math.floor(x + 0.5)


def face(font: str) -> dict:
    """Style and family by a font's name."""
    name = re.sub(r"-\d+$", "", re.sub(r"^[A-Z]{6}\+", "", font or ""))
    low = name.lower()
    return {
        "bold": bool(re.search("bold|black|heavy|semibold|demi", low)), "italic": bool(re.search("italic|oblique", low)), "mono": bool(re.search("mono|courier|consol|menlo", low)),
        "family": family_of(name) or font,
    }


def family_of(name: str) -> str:
    """A font's family: its name without the words for its face at the end, up to eight of them."""
    name = name.split(",")[0]
    for _ in range(8):
        name = name.rstrip("-_ ")
        cut = max(name.rfind(c) for c in "-_ ")
        if cut >= 0 and name[cut + 1 :].lower() in FACES:
            name = name[:cut]
            continue
        end = next((g for g in GLUED if name.endswith(g) and len(name) - len(g) >= 3), None)
        if end is None:
            break
        name = name[: -len(end)]
    return ALIASES.get(re.sub("[-_ ]", "", name).lower()) or re.sub("[-_]+", " ", name).strip()


def lines_of(items: list[tuple]) -> list[Line]:
    """Items of one baseline become a line of styled spans; jumps stay as spans of a single space."""
    groups: list[list[tuple]] = []
    for item in sorted((i for i in items if i[0]), key=lambda i: (-i[2], i[1])):
        last = groups[-1][-1] if groups else None
        if last is not None and abs(last[2] - item[2]) <= max(1.0, BASELINE * last[4]):
            groups[-1].append(item)
        else:
            groups.append([item])
    found = (_line(sorted(g, key=lambda i: i[1])) for g in groups)
    return [line for line in found if line]


def _line(group: list[tuple]) -> Line | None:
    spans: list[Span] = []
    cursor = group[0][1]
    for text, x, _, width, size, font in group:
        if spans and x - cursor > SPACE * size:
            if x - cursor > JUMP * size:
                spans.append(Span(" ", size, cursor, x - cursor))
            elif not _ENDS_WS.search(spans[-1].text):
                spans[-1].text += " "
        new = Span(text, size, x, width, **face(font))
        if spans and not spans[-1].gap and not new.gap and spans[-1].like(new):
            spans[-1].text += text
            spans[-1].width = x + width - spans[-1].x
        else:
            spans.append(new)
        cursor = x + width
    for s in spans:
        if not s.gap:
            s.text = _RUNS.sub(" ", s.text)
    inked = [i for i, s in enumerate(spans) if strip(s.text)]
    if not inked:
        return None
    spans = spans[inked[0] : inked[-1] + 1]
    spans[0].text = _LEAD.sub("", spans[0].text)
    spans[-1].text = _TRAIL.sub("", spans[-1].text)
    spans = [s for s in spans if s.text]
    return Line(spans, group[0][1], max(i[1] + i[3] for i in group), group[0][2], main_size(spans))


def _heaviest(weights: Counter, default: float) -> float:
    """The key of most weight, the first of equals."""
    return max(weights, key=weights.__getitem__) if weights else default


def main_size(spans: list[Span]) -> float:
    weights: Counter = Counter()
    for s in spans:
        weights[js_round(s.size * 2) / 2] += max(1, len(strip(s.text)))
    return _heaviest(weights, 11.0)


def prose(spans: list[Span]) -> list[Span]:
    """Spans as running text: jumps are spaces, ends are trimmed, spaces stand outside of bold and italic."""
    out: list[Span] = []
    for s in spans:
        if s.gap:
            if out and not _ENDS_WS.search(out[-1].text):
                out[-1].text += " "
        elif out and out[-1].like(s):
            out[-1].text += s.text
        else:
            out.append(replace(s))
    if out:
        out[0].text = _LEAD.sub("", out[0].text)
        out[-1].text = _TRAIL.sub("", out[-1].text)
    out = [s for s in out if s.text]
    for before, s, after in zip([None, *out[:-1]], out, [*out[1:], None], strict=True):
        if not (s.bold or s.italic) or not strip(s.text):
            continue
        if lead := _LEAD.match(s.text):
            s.text = s.text[lead.end() :]
            if before and not _ENDS_WS.search(before.text):
                before.text += lead.group()
        if after and (trail := _TRAIL.search(s.text)):
            s.text = s.text[: trail.start()]
            if not _STARTS_WS.search(after.text):
                after.text = trail.group() + after.text
    return [s for s in out if s.text]


def text_of(line: Line) -> str:
    return "".join(s.text for s in prose(line.spans))


def body_size(lines: list[Line]) -> float:
    weights: Counter = Counter()
    for line in lines:
        weights[js_round(line.size * 2) / 2] += len(strip(text_of(line)))
    return _heaviest(weights, 11.0)


def body_margin(lines: list[Line]) -> float:
    counts = Counter(js_round(line.x) for line in lines)
    return min(counts, key=lambda x: (-counts[x], x)) if counts else 0.0


def marker_of(text: str) -> str | None:
    text = strip(text)
    return "bullet" if _BULLET.match(text) else "number" if _NUMBER.match(text) else None


def _item(line: Line) -> tuple[str, list[Span]] | None:
    """(marker, text) of a list line: a marker of its own, then a jump."""
    first = line.spans[0]
    marker = marker_of(first.text)
    rest = prose(line.spans[1:]) if marker else []
    if not rest or not strip("".join(s.text for s in rest)) or rest[0].x - (first.x + first.width) <= SPACE * first.size:
        return None
    return marker, rest


def _is_item(line: Line) -> bool:
    first = line.spans[0]
    after = next((s for s in line.spans[1:] if not s.gap), None)
    return marker_of(first.text) is not None and after is not None and after.x - (first.x + first.width) > SPACE * first.size


def cell_starts(line: Line) -> list[float]:
    return [line.x] + [b.x for a, b in zip(line.spans, line.spans[1:], strict=False) if a.gap and a.width >= CELL * a.size and not b.gap]


def _near(x: float, columns: list[float]) -> bool:
    return any(abs(x - c) <= COLUMN for c in columns)


def table_runs(lines: list[Line]) -> list[tuple[range, list[float], set[int]]]:
    """(lines, columns, continuation lines) of each table: 2 rows of 3 columns or 3 rows of 2 that keep their starts."""
    starts = [[] if _is_item(line) else cell_starts(line) for line in lines]
    runs, i = [], 0
    while i < len(lines):
        columns, wraps, j = starts[i], set(), i + 1
        while len(columns) > 1 and j < len(lines):
            if len(starts[j]) > 1:
                kept = [c for c in columns if _near(c, starts[j])]
                if len(kept) < 2:
                    break
                columns = kept
            elif not _is_item(lines[j]) and 0 < lines[j - 1].y - lines[j].y <= LEADING * lines[j].size and _near(lines[j].x, columns):
                wraps.add(j)
            else:
                break
            j += 1
        if len(columns) > 1 and j - i - len(wraps) >= (2 if len(columns) > 2 else 3):
            runs.append((range(i, j), columns, wraps))
            i = j
        else:
            i += 1
    return runs


def _cells(line: Line, columns: list[float]) -> list[list[Span]]:
    cells: list[list[Span]] = [[] for _ in columns]
    for s in line.spans:
        if not s.gap:
            cells[max((k for k, c in enumerate(columns) if s.x + COLUMN >= c), default=0)].append(replace(s))
    return [prose(c) for c in cells]


def _table(lines: list[Line], run: range, columns: list[float], wraps: set[int]) -> Block:
    rows: list[list[list[Span]]] = []
    for i in run:
        cells = _cells(lines[i], columns)
        if i not in wraps or not rows:
            rows.append(cells)
            continue
        for k, more in enumerate(cells):
            if more:
                if rows[-1][k] and not _ENDS_WS.search(rows[-1][k][-1].text):
                    rows[-1][k][-1].text += " "
                rows[-1][k] = prose(rows[-1][k] + more)
    return Block("table", rows=rows)


def heading_level(line: Line, body: float) -> int | None:
    text = strip(text_of(line))
    for least, level in HEADINGS:
        if text and line.size / body >= least:
            return level
    bold = all(s.bold or not strip(s.text) for s in line.spans)
    return 3 if text and bold and len(text) <= 60 and text[-1] not in ".;:" else None


def _goes_on(before: Line, line: Line, body: float, edge: float) -> bool:
    gap, column = before.y - line.y, edge - before.x
    full = column <= 0 or (before.right - before.x) / column >= FULL
    return abs(before.size - line.size) <= 0.6 and 0 < gap <= LEADING * line.size and abs(before.x - line.x) <= 0.75 * body and full


def _append(block: Block, line: Line) -> None:
    tail = block.spans[-1] if block.spans else None
    if tail and tail.text.endswith("­"):
        tail.text = tail.text[:-1]
    elif tail and not _ENDS_WS.search(tail.text):
        tail.text += " "
    for s in prose(line.spans):
        if block.spans and block.spans[-1].like(s):
            block.spans[-1].text += s.text
        else:
            block.spans.append(s)


def blocks_of(lines: list[Line], body: float | None = None, margin: float | None = None) -> list[Block]:
    if not lines:
        return []
    body = body_size(lines) if body is None else body
    margin = body_margin(lines) if margin is None else margin
    edge = max(line.right for line in lines)
    tables = {run.start: (run, columns, wraps) for run, columns, wraps in table_runs(lines)}
    blocks: list[Block] = []
    last: Line | None = None  # of the block that may go on
    i = 0
    while i < len(lines):
        line = lines[i]
        if i in tables:
            blocks.append(_table(lines, *tables[i]))
            last, i = None, tables[i][0].stop
            continue
        i += 1
        indent = max(0, js_round(line.x - margin))
        if not strip(text_of(line)):
            last = None
        elif level := heading_level(line, body):
            blocks.append(Block("heading", prose(line.spans), level=level))
            last = None
        elif item := _item(line):
            blocks.append(Block("list", item[1], marker=item[0], indent=indent))
            last = line
        elif last is not None and _goes_on(last, line, body, edge):
            _append(blocks[-1], line)
            last = line
        else:
            blocks.append(Block("paragraph", prose(line.spans), indent=indent))
            last = line
    tiers: list[int] = []
    for indent in sorted(b.indent for b in blocks if b.kind == "list"):
        if not tiers or indent - tiers[-1] > TIER:
            tiers.append(indent)
    for b in blocks:
        if b.kind == "list":
            b.depth = min(DEEPEST, sum(b.indent >= t - TIER for t in tiers) - 1)
    return blocks


def as_text(block: Block) -> str:
    if block.rows is None:
        return "".join(s.text for s in block.spans)
    return "\n".join("\t".join("".join(s.text for s in cell) for cell in row) for row in block.rows)
