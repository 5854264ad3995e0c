"""Line and word comparison in plain Python; no Spark here, so it can be tested alone."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

from paperloom.functions.text import PY_NOT_WS as NOT_WS
from paperloom.functions.text import PY_WS as WS

#: Most edits looked for, and the share of common lines under which two long texts count as unrelated.
BUDGET, OVERLAP, LONG = 3000, 0.15, 400
_ENDS = re.compile("\r\n?")
_RUN, _EDGE, _WORDS, _BLANK = re.compile(f"{WS}+"), re.compile(f"^{WS}+|{WS}+$"), re.compile(f"{WS}+|{NOT_WS}+"), re.compile(f"{WS}*")

Edit = tuple[str, int | None, int | None]


def lines_of(text: str) -> list[str]:
    if not text:
        return []
    found = _ENDS.sub("\n", text).split("\n")
    return found[:-1] if len(found) > 1 and not found[-1] else found


def key_of(line: str, case: bool, space: bool) -> str:
    if space:
        line = _EDGE.sub("", _RUN.sub(" ", line))
    return line.lower() if case else line


def shortest_edits(a: list, b: list, budget: int = BUDGET) -> list[Edit] | None:
    """A shortest edit script by Myers' greedy search, or None beyond ``budget`` edits.

    ``reach[d][i]`` is how far d edits get in ``a`` on diagonal 2i - d. Of two ways to a diagonal the one that is
    further along comes first, an insertion only if strictly further; that rule fixes which shortest script is found.
    """
    n, m = len(a), len(b)
    reach: list[list[int]] = []
    before: list[int] = []
    for d in range(min(n + m, budget) + 1):
        row = []
        for i in range(d + 1):
            if not d:
                x = 0
            elif i == 0 or (i < d and before[i - 1] < before[i]):
                x = before[i]
            else:
                x = before[i - 1] + 1
            y = x - 2 * i + d
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            row.append(x)
            if x >= n and y >= m:
                reach.append(row)
                return _script(reach, n, m)
        reach.append(row)
        before = row
    return None


def _inserts(before: list[int], i: int, d: int) -> bool:
    """Whether diagonal i of row d is entered by an insertion, as decided above."""
    return i == 0 or (i < d and before[i - 1] < before[i])


def _script(reach: list[list[int]], x: int, y: int) -> list[Edit]:
    """Walk back from the end; ``reach`` ends with the row that got there."""
    out: list[Edit] = []
    for d in range(len(reach) - 1, 0, -1):
        before, i = reach[d - 1], (x - y + d) // 2
        down = _inserts(before, i, d)
        fx = before[i] if down else before[i - 1]
        fy = fx - (2 * (i if down else i - 1) - (d - 1))
        while x > fx and y > fy:
            x, y = x - 1, y - 1
            out.append(("equal", x, y))
        out.append(("insert", None, fy) if down else ("delete", fx, None))
        x, y = fx, fy
    out += [("equal", k, k) for k in range(x - 1, -1, -1)]
    return out[::-1]


def shared_share(a: list, b: list) -> float:
    """Multiset intersection over the longer list; 1 if both are empty."""
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b)) if a or b else 1.0


def line_edits(left: list[str], right: list[str], case: bool = False, space: bool = False, blank: bool = False, budget: int = BUDGET, overlap: float = OVERLAP) -> tuple[list[Edit], bool]:
    """(edits over the lines' own positions, whether the search was given up)."""
    at_l = [i for i, x in enumerate(left) if not (blank and _BLANK.fullmatch(x))]
    at_r = [i for i, x in enumerate(right) if not (blank and _BLANK.fullmatch(x))]
    a, b = [key_of(left[i], case, space) for i in at_l], [key_of(right[i], case, space) for i in at_r]
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    unrelated = len(mid_a) + len(mid_b) > LONG and overlap > 0 and shared_share(mid_a, mid_b) < overlap
    middle = None if unrelated else shortest_edits(mid_a, mid_b, budget)
    gave_up = middle is None
    if middle is None:
        middle = [("delete", i, None) for i in range(len(mid_a))] + [("insert", None, i) for i in range(len(mid_b))]
    placed = [("equal", i, i) for i in range(head)]
    placed += [(op, None if x is None else head + x, None if y is None else head + y) for op, x, y in middle]
    placed += [("equal", len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    return [(op, None if x is None else at_l[x], None if y is None else at_r[y]) for op, x, y in placed], gave_up


def rebuilt(edits: list[Edit], right: list[str]) -> list[str]:
    """The right side from the edits; it holds unless blank lines were ignored."""
    return [right[y] for _, _, y in edits if y is not None]


def word_segments(left: str, right: str, case: bool = False, space: bool = False, budget: int = BUDGET) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, op) runs of either side."""
    a, b = _WORDS.findall(left), _WORDS.findall(right)
    known: dict[str, int] = {}
    numbered = lambda side: [known.setdefault(key_of(w, case, space), len(known)) for w in side]
    edits = shortest_edits(numbered(a), numbered(b), budget)
    if edits is None:
        return [(left, "delete")] if a else [], [(right, "insert")] if b else []
    sides = [(a[x], op) for op, x, _ in edits if x is not None], [(b[y], op) for op, _, y in edits if y is not None]
    return tuple([("".join(w for w, _ in run), op) for op, run in groupby(side, lambda p: p[1])] for side in sides)


def compare(left_text: str, right_text: str, **options) -> dict:
    """Rows as shown side by side, counts, similarity in characters, and whether the search was given up.

    Deletions followed by insertions pair off in order as replacements; insertions before deletions stay as they are.
    """
    left, right = lines_of(left_text), lines_of(right_text)
    edits, gave_up = line_edits(left, right, **options)
    words = {k: v for k, v in options.items() if k in ("case", "space", "budget")}
    rows, matched = [], 0
    runs = [(op, list(run)) for op, run in groupby(edits, lambda e: e[0])]
    skip = False
    for k, (op, run) in enumerate(runs):
        if skip:
            skip = False
            continue
        if op == "equal":
            for _, x, y in run:
                rows.append(("equal", x, y))
                matched += min(len(left[x]), len(right[y]))
            continue
        added = runs[k + 1][1] if op == "delete" and k + 1 < len(runs) and runs[k + 1][0] == "insert" else []
        skip = bool(added)
        for (_, x, _), (_, _, y) in zip(run, added, strict=False):
            rows.append(("replace", x, y))
            sides = word_segments(left[x], right[y], **words)
            matched += min(sum(len(t) for t, o in side if o == "equal") for side in sides)
        rows += run[len(added) :] if op == "delete" else run
        rows += added[len(run) :]
    total = sum(len(left[x]) for _, x, _ in rows if x is not None) + sum(len(right[y]) for _, _, y in rows if y is not None)
    count = Counter(r[0] for r in rows)
    return {
        "rows": rows, "added": count["insert"], "removed": count["delete"], "changed": count["replace"], "unchanged": count["equal"],
        "similarity": 2 * matched / total if total else 1.0, "identical": count["equal"] == len(rows), "truncated": gave_up,
    }


def unified(left_text: str, right_text: str, context: int = 3, names: tuple[str, str] = ("left", "right"), **options) -> str:
    """A unified patch; empty without changes. An empty side of a hunk is written as line 0."""
    left, right = lines_of(left_text), lines_of(right_text)
    edits, _ = line_edits(left, right, **options)
    context = max(0, context)
    hunks: list[list[int]] = []
    for i, (op, _, _) in enumerate(edits):
        if op != "equal":
            if hunks and i - hunks[-1][1] <= 2 * context + 1:
                hunks[-1][1] = i
            else:
                hunks.append([i, i])
    out = [f"--- {names[0]}", f"+++ {names[1]}"] if hunks else []
    for first, last in hunks:
        part = edits[max(0, first - context) : last + context + 1]
        spans = []
        for side in (1, 2):
            at = [e[side] for e in part if e[side] is not None]
            spans.append(f"{at[0] + 1 if at else 0}" + ("" if len(at) == 1 else f",{len(at)}"))
        out.append(f"@@ -{spans[0]} +{spans[1]} @@")
        out += [f"+{right[y]}" if x is None else f"-{left[x]}" if y is None else f" {left[x]}" for _, x, y in part]
    return "\n".join(out) + "\n" if out else ""
