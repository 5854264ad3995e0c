"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

Texts are read whole as UTF-8: A-Z is lower-cased and words are runs of a-z, 0-9 and characters beyond ASCII. One
automaton over the words, joined by single spaces, finds every place of every notice phrase and of the identifier tags.
What follows a tag is parsed as a licence expression: ``and``, ``or``, ``with`` and parentheses, in any case; ``with``
binds tightest and joins an exception to one licence, then ``and``, then ``or``. An expression gives its licences as
labels; a broken one gives those read before the break. A complete one is evaluated: whether someone who accepts a given
set of licences can meet it, by one side of each ``or`` and both of each ``and``; a text is usable if all of its tags are.

Score: 1 for a well-formed identifier tag, else 1 - 0.5 ** (0.5 * places of base phrases + places of other notices), 0
without either. Defined results: null, empty and wordless texts have no words, places or labels (empty strings), null
positions and score 0; ``usable`` is null without a tag, and false if a tag's expression is broken; texts and expressions of
any length are read whole; of phrases that start at one place all count; repeated rows are scanned alike; an empty table
gives an empty result; extra columns pass, except that one of the name of the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.workspace import ship

#: Fixed by the contract: phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of common licences, in words as above.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "gnu library general public license": "lgpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl", "boost software license": "bsl",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0", "cc0 1 0 universal": "cc0", "free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl", "all rights reserved": "all-rights-reserved", "academic free license": "afl", "artistic license": "artistic",
}
#: Labels, or identifiers, of licences that are accepted unless others are named.
ACCEPTED = ("mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "zlib", "bsl-1.0", "0bsd", "python-2.0", "gpl-2.0-only with classpath-exception-2.0")
TAGS = ("spdx license identifier",)
#: What a tag looks like in a text; its expression ends where the parser stops.
TAG = re.compile(rb"spdx-license-identifier\s*:")
TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+:-]*")
#: Other bytes than a-z, 0-9 and 128 up become a space.
WORD_BYTES = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RANK = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str:
    """An identifier's label: its licence family where one is known, else itself."""
    for start, label in (("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("isc", "isc"), ("cc0", "cc0"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by")):
        if name == start or name.startswith((start + "-", start + "+")):
            return label
    return name


def parse_expression(text: bytes) -> tuple[tuple | None, list[str]]:
    """Shunting-yard over lower-case bytes: (tree or None where the expression is broken, licences in order).

    A tree is a licence or (operator, left, right). Reading stops at the first token that can't go on an expression, so
    a comment's end or a sentence after it does no harm, and at the line's end; what was read must be complete.
    """
    return read_expression(text, 0)[:2]


def read_expression(text: bytes, at: int) -> tuple[tuple | None, list[str], int]:
    """The same from a place on, with the place where reading stopped."""
    out: list = []
    ops: list[str] = []
    names: list[str] = []
    wants, exception = True, False

    def reduce() -> None:
        right, left = out.pop(), out.pop()
        out.append((ops.pop(), left, right))

    while at < len(text):
        if text[at] in b"\r\n":
            break
        if text[at : at + 1].isspace():
            at += 1
            continue
        found = TOKEN.match(text, at)
        if not found or TAG.match(text, at):
            break
        token = found.group().decode()
        if token == "(":
            if not wants or exception:
                break
            ops.append(token)
        elif token == ")":
            if wants or "(" not in ops:
                break
            while ops[-1] != "(":
                reduce()
            ops.pop()
        elif token in RANK:
            if wants or (token == "with" and not isinstance(out[-1], str)):
                break
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[token]:
                reduce()
            ops.append(token)
            wants, exception = True, token == "with"
        else:
            if not wants:
                break
            out.append(token)
            if not exception:
                names.append(token)
            wants = exception = False
        at = found.end()
    if wants or "(" in ops:
        return None, names, at
    while ops:
        reduce()
    return out[0], names, at


def allows(tree, accepted) -> bool:
    """Whether someone who accepts these licences, by identifier, by label or as ``licence with exception``, can meet the expression.

    Works a stack, as expressions may nest deeper than calls can.
    """
    todo, values = [(tree, False)], []
    while todo:
        node, done = todo.pop()
        if isinstance(node, str):
            values.append(node in accepted or family(node) in accepted)
        elif node[0] == "with":
            values.append(node[1] in accepted or family(node[1]) in accepted or f"{node[1]} with {node[2]}" in accepted)
        elif done:
            right, left = values.pop(), values.pop()
            values.append(left and right if node[0] == "and" else left or right)
        else:
            todo += [(node, True), (node[2], False), (node[1], False)]
    return values[0]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan(text: str | None, matcher, accepted=frozenset(ACCEPTED)) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, usable, score)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_BYTES).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1") if words else ""
    starts, base, labels, notices, tagged = [], set(), set(), 0, False
    for end, (kind, label, size) in matcher.iter(line):
        if kind == "base":
            starts.append(end - size + 1)
            base.add(label)
        elif kind == "notice":
            notices += 1
            labels.add(label)
        else:
            tagged = True
    expressions, whole, usable = [], False, None
    if tagged:
        lowered = raw.lower()
        for found in TAG.finditer(lowered):
            tree, names, stop = read_expression(lowered, found.end())
            labels.update(family(n) for n in names if n not in ("none", "noassertion"))
            whole |= tree is not None
            usable = (usable is not False) and tree is not None and allows(tree, accepted)
            expressions.append(lowered[found.end() : stop].decode("utf-8", "replace").strip())
    first, last = (line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))) if starts else (None, None)
    score = 1.0 if whole else 1 - 0.5 ** (0.5 * len(starts) + notices)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), expressions, usable, score


FOUND = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, expressions: array<string>, usable: boolean, score: double>"


def with_licenses(df: DataFrame, text: str = "text", name: str = "__pl_licenses", accepted: tuple = ACCEPTED) -> DataFrame:
    """``df`` with a struct of what each whole text says about its licence; ``accepted``: lower-case licences or labels."""
    ship(df.sparkSession)
    known = frozenset(accepted)

    @F.arrow_udf(FOUND)
    def licenses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = automaton()
        kinds = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())), ("usable", pa.bool_()), ("score", pa.float64())])
        names = [kinds.field(i).name for i in range(kinds.num_fields)]
        for texts in batches:
            yield pa.array([dict(zip(names, scan(t.as_py(), matcher, known), strict=True)) for t in texts], kinds)

    return df.withColumn(name, licenses(F.col(text)))
