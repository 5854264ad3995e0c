"""Operators of paperloom.llm against brute force, exact round trips and edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import embedding_dedup, exact_dedup, license_scan, minhash_dedup, mixing, pieces, sharding, toxicity, warc
from paperloom.llm import queries as llm

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, ties, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 100)
    for i in range(30):  # a group around one text, with strays between
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [base.upper(), "  " + base.replace(" ", "\n"), None, "", " \t\n", "one two", "one two", "One  TWO", "x" * 200_000, prose(rng, 20_000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, "en", "s0", 1), (500, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With columns whose names clash with what operators might use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, DOCS).withColumns({"id": F.lit(1), "uid": F.lit("u"), "text_hash": F.lit(2), "score": F.lit(3), "size": F.lit(4), "key": F.lit(5)}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# 1 MinHash


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_minhash_equals_brute_force(docs, corpus):
    found = minhash_dedup.near_duplicates(docs).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found], components(corpus))
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_minhash_tiles_equal_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    found = minhash_dedup.near_duplicates(docs).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found], components(corpus))


def test_minhash_with_many_repeated_rows_and_a_hub(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 120).split()
    rows = [(7, " ".join(base))] * 300 + [(9, " ".join(["new", *base[1:]]))] * 300 + [(None, " ".join(base[:-1]))] * 5
    for i in range(60):
        words = list(base)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    search = minhash_dedup._Search(df, "text", "doc_id", 5, 75)
    sets = search.sets_of(search.classes.select("node").toDF("uid"))
    assert sets.count() == search.classes.count() == 63
    monkeypatch.setattr(minhash_dedup, "HUB_PAIRS", 4)
    for heavy in (2048, 2):
        monkeypatch.setattr(minhash_dedup, "HEAVY", heavy)
        found = minhash_dedup.near_duplicates(df).collect()
        same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found], components(rows))
        assert sum(r["row_kept"] for r in found) == 1 and minhash_dedup.drop_near_duplicates(df).count() == 1


def test_minhash_keeps_one_row_of_each_component(docs, corpus, nothing):
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    empty = sum(not shingles(r[1]) for r in corpus)
    groups = {c for _, n, c in components(corpus) if n}
    assert len(rows) == len(groups) + empty and len({shingles(r["text"]) for r in rows if shingles(r["text"])}) == len(groups)
    assert minhash_dedup.near_duplicates(nothing).count() == 0 and minhash_dedup.drop_near_duplicates(nothing).count() == 0


# 2 Embeddings


def vectors():
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((6, 64))
    rows = [centre[i % 6] + 0.03 * (1 + i % 5) * rng.standard_normal(64) for i in range(240)] + list(rng.standard_normal((100, 64)))
    out = [(i, [float(x) for x in np.float32(v)], i % 3) for i, v in enumerate(rows)]
    out += [(900, out[0][1], 0), (901, [2 * x for x in out[0][1]], 0), (902, None, 1), (903, [0.0] * 64, 1), (904, [float("nan")] + [1.0] * 63, 1), (905, [None] + [1.0] * 63, 1), (906, [1.0, 2.0], 1), (907, [], 1), (908, [math.inf] * 64, 1)]
    out += [(910 + i, out[i][1][:20], 0) for i in range(60)] + [(980, [2.0, 4.0], 1), (981, [-1.0, 2.0], 1), (982, [1.0] * 700, 1), (983, [1.0] * 699 + [1.1], 1), (990, out[0][1][:63], 0)]
    return [*out, out[5], out[347]]


def brute_vectors(rows):
    """(id, links, least id reachable) of each row; vectors of different lengths never link."""
    usable = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.linalg.norm(v) if usable(v) else None for _, v, _ in rows]
    links = np.array([[i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(links), strict=True):
        parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], int(links[i].sum()), least[find(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("hot", [32, 4, 1000])
def test_embeddings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "HOT", hot)
    rows = vectors()
    expected = brute_vectors(rows)
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()
    same([(r["vec_id"], r["n_links"], r["component_id"]) for r in found], expected)
    assert dict((i, n) for i, n, _ in expected)[982] == 1 and sum(n > 0 for i, n, _ in expected if 910 <= i < 970) > 20
    if hot == 32:
        assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bands_leave_few_pairs_apart():
    """The share of pairs at the threshold that no band holds together, by drawing differing bits."""
    rng = np.random.default_rng(2)
    bands = embedding_dedup.band_plan(1 << 14, 0.95, 512)
    differ = rng.random((20_000, 512)) < math.acos(0.95) / math.pi
    missed = np.ones(len(differ), bool)
    for at in bands:
        missed &= differ[:, at].any(1)
    assert missed.mean() <= 5 * embedding_dedup.MISS


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    turn = embedding_dedup.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = a + 0.1 * rng.standard_normal(a.shape)
    b /= np.linalg.norm(b, axis=1)[:, None]
    turned = a @ turn
    factor = np.abs(turned).sum(1) / math.sqrt(turn.shape[1])
    error = (np.sign(turned) * (b @ turn)).sum(1) / math.sqrt(turn.shape[1]) / factor - (a * b).sum(1)
    bound = embedding_dedup.SIGMAS * np.sqrt((1 - factor**2) / factor**2 / (turn.shape[1] - 1))
    assert abs(error.mean()) < 0.01 and (np.abs(error) < bound).all()


# 3 Licences


def brute_licences(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENCES = [
    "Released under the MIT License. MIT-license; mit_license!", "GNU General Public License, Apache License", "ccby cc by CC-BY-SA", "", None, "é GNU general public license", "gnu general public license " * 3,
    "mit license mit license", "ＭＩＴ license", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "x" * 100_000, "the license of mit",
]


def test_licences_equal_brute_force(spark, docs, nothing):
    rows = spark.createDataFrame(list(enumerate(LICENCES)), "doc_id long, text string")
    for r in license_scan.with_licenses(rows).collect():
        got = r["__pl_licenses"]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_licences(r["text"]), r["text"]
        assert 0 <= got["score"] <= 1 and set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
    assert license_scan.with_licenses(docs).count() == docs.count() and license_scan.with_licenses(nothing).count() == 0


def test_expressions():
    tree, names = license_scan.parse_expression(b"mit or apache-2.0 and gpl-2.0-only with classpath-exception-2.0")
    assert tree == ("or", "mit", ("and", "apache-2.0", ("with", "gpl-2.0-only", "classpath-exception-2.0"))) and names == ["mit", "apache-2.0", "gpl-2.0-only"]
    assert license_scan.parse_expression(b"(mit or isc) and zlib")[0] == ("and", ("or", "mit", "isc"), "zlib")
    for broken in (b"", b"mit or", b"(mit", b"or mit", b"mit and (isc or"):
        assert license_scan.parse_expression(broken)[0] is None
    assert license_scan.parse_expression(b"mit */")[0] == "mit" and license_scan.allows(tree, {"mit"}) and not license_scan.allows(tree, {"apache-2.0"})
    found = license_scan.scan(LICENCES[9], license_scan.automaton())
    assert found[5] == "apache,gpl,mit" and found[7:] == (True, 1.0)


def test_expressions_equal_brute_force():
    """Random trees, written with as few parentheses as precedence allows, and what one who accepts some of them can use."""
    rng, names = random.Random(12), ["mit", "apache-2.0", "gpl-3.0-or-later", "zlib", "epl-2.0", "bsd-3-clause", "agpl-3.0-only"]

    def tree(depth):
        if not depth or rng.random() < 0.25:
            return rng.choice(names) if rng.random() < 0.8 else ("with", rng.choice(names), "some-exception")
        return (rng.choice(["and", "or"]), tree(depth - 1), tree(depth - 1))

    def write(t):
        if isinstance(t, str):
            return t
        if t[0] == "with":
            return f"{t[1]} WITH {t[2]}"
        left, right = (f"({write(x)})" if x[0] in ("and", "or") and (x[0] != t[0] or side) else write(x) for side, x in enumerate(t[1:]))
        return f"{left} {t[0].upper()} {right}"

    def can(t, accepted):
        if isinstance(t, str):
            return t in accepted
        return {"with": lambda: can(t[1], accepted), "and": lambda: can(t[1], accepted) and can(t[2], accepted), "or": lambda: can(t[1], accepted) or can(t[2], accepted)}[t[0]]()

    outcomes, matcher = Counter(), license_scan.automaton()
    for _ in range(300):
        t, accepted = tree(5), frozenset(rng.sample(names, 3))
        found = license_scan.scan(f"x SPDX-License-Identifier: {write(t)}\n", matcher, accepted)
        assert license_scan.parse_expression(write(t).lower().encode())[0] == t
        assert found[7] == can(t, accepted) and found[8] == 1.0
        outcomes[found[7]] += 1
    assert min(outcomes[True], outcomes[False]) > 50
    deep = "(" * 20_000 + "mit" + ")" * 20_000 + " and zlib" * 5000
    assert license_scan.scan(f"SPDX-License-Identifier: {deep}", matcher)[7:] == (True, 1.0)
    assert license_scan.scan("the MIT License", matcher)[7] is None


# 5 WARC


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (9, "u", "WARC/1.1\r\n\r\nfake"), (5, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (None, "u", "lone"), (None, "u", ""), (7, "u", "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        warc.write_archive(df, path, compression=compression)
        found = warc.read_whole(spark, path).collect()
        got = sorted((repr(warc_id(r["record_id"])), bytes(r["payload"]).decode()) for r in found)
        assert got == sorted((repr(r[0]), r[2] or "") for r in rows)
        for r in found:
            assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() and r["payload_length"] == len(r["payload"])
        kinds = Counter((warc_id(r["record_id"]), r["warc_type"], warc_id(r["refers_to"])) for r in found)
        assert kinds == Counter({(1, "revisit", 5): 1, (2, "revisit", 5): 1, (5, "response", None): 2, (3, "revisit", 4): 1, (4, "response", None): 1, (None, "revisit", 4): 1, (9, "response", None): 1, (None, "response", None): 1, (7, "response", None): 1})
        assert warc.read_archive(spark, path, payload=False, verify=True).where("warc_type = 'revisit' and target_uri is not null").count() == 3
        assert warc.read_archive(spark, path, payload=False).select("payload").where("payload is not null").count() == 0
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "HEAVY", 2)  # one digest is frequent, the others are shuffled
    warc.write_archive(df, f"file://{tmp_path}/shuffled")
    assert sorted(repr((warc_id(r["record_id"]), r["warc_type"], warc_id(r["refers_to"]), r["payload_digest"])) for r in warc.read_archive(spark, f"file://{tmp_path}/shuffled").collect()) == sorted(repr((warc_id(r["record_id"]), r["warc_type"], warc_id(r["refers_to"]), r["payload_digest"])) for r in found)
    warc.write_archive(df, f"file://{tmp_path}/least", min_bytes=5)
    assert warc.read_archive(spark, f"file://{tmp_path}/least").where("warc_type = 'revisit'").count() == 2
    warc.write_archive(df.limit(0), f"file://{tmp_path}/empty")
    assert warc.read_archive(spark, f"file://{tmp_path}/empty").count() == 0


def warc_id(record):
    found = re.match(r"<urn:page:(-?\d+)>", record or "")
    return int(found.group(1)) if found else None


# 6 Pieces

def test_every_tag_of_a_line_and_long_expressions():
    scan = lambda text: license_scan.scan(text, license_scan.automaton())
    assert scan("SPDX-License-Identifier: MIT ... SPDX-License-Identifier: Apache-2.0")[5] == "apache,mit"
    assert scan("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0")[5] == "apache,mit"
    assert scan("SPDX-License-Identifier: MIT AND SPDX-License-Identifier: Apache-2.0")[5:] == ("apache,mit", ["mit and", "apache-2.0"], False, 1.0)
    assert scan("SPDX-License-Identifier: or -- SPDX-License-Identifier: ISC")[7:] == (False, 1.0)
    assert scan("SPDX-License-Identifier: MIT AND\nApache-2.0")[5] == "mit"
    assert scan(f"SPDX-License-Identifier: {'MIT OR ' * 2000}Zlib")[5] == "mit,zlib"


TEXTS = ["  hi  there\n\nx", "", "a\tb", "é\x00 z", " lead", "trail  ", "▁x a ▁ b", "日本語 😀", "   ", "\n", "x" * 50_000, "The quick brown fox, jumps!", None]


def test_pieces_without_dropout_are_the_library_s_own():
    import sentencepiece

    library, encoder = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Encoder(rate=0.0)
    rng = random.Random(2)
    texts = [t for t in TEXTS if t is not None and "▁" not in t] + ["".join(rng.choice("abcdeé ,.\n") for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert encoder.encode(t) == library.encode(t)


def test_pieces_decode_losslessly_and_vary(spark, docs, nothing):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string")
    found = pieces.with_text(pieces.with_tokens(rows)).collect()
    assert all(r["decoded"] == r["text"] for r in found) and all((r["token_ids"] is None) == (r["text"] is None) for r in found)
    assert len({tuple(r["token_ids"]) for r in found if r["text"] == "The quick brown fox, jumps!"}) > 1
    again = pieces.with_tokens(rows.repartition(5)).collect()
    assert sorted((r["doc_id"], r["token_ids"] or []) for r in again) == sorted((r["doc_id"], r["token_ids"] or []) for r in found)
    assert pieces.with_text(pieces.with_tokens(docs)).where("not decoded <=> text").count() == 0 and pieces.with_tokens(nothing).count() == 0


def test_every_document_copy_and_occurrence_has_its_own_draw(spark):
    encoder, text = pieces.Encoder(), " interoperability"
    cuts = {tuple(encoder.encode(text, key)) for key in range(200)}
    assert len(cuts) > 8
    words = encoder.encode(text * 200, 7)
    assert encoder.decode(words) == text * 200 and len(words) % 200  # one cut for all would give a multiple
    for key in range(50):  # what is remembered changes no draw
        own = (key & pieces.MASK) ^ (pieces.SEED << 16)
        assert encoder.encode(text[1:], key) == list(pieces.segment(text, encoder.pieces, pieces.RATE, own))
    rows = spark.createDataFrame([(1, c, text * 20) for c in (1, 2)], "doc_id long, copy int, text string")
    assert len({tuple(r["token_ids"]) for r in pieces.with_tokens(rows, copy="copy").collect()}) == 2


def naive_pieces(library, text, key, rate):
    """Merge-dropout by looking through all adjacent pairs again for each candidate, from the library's pieces and scores."""
    sizes = range(library.get_piece_size())
    plain = {library.id_to_piece(i).replace("\u2581", " "): i for i in sizes if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
    order = {p: n for n, p in enumerate(sorted((p for p in plain if len(p) > 1), key=lambda p: (-library.get_score(plain[p]), plain[p])))}
    raw = {library.id_to_piece(i): i for i in sizes if library.is_byte(i)}
    top, out = 2**64, []

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ x >> 27) * 0x94D049BB133111EB % top
        return x ^ x >> 31

    for number, stretch in enumerate(re.findall(r" *[^ \n]+| +|\n", " " + text) if text else ()):
        h = 0xCBF29CE484222325
        for c in stretch:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % top
        salt = mixed(h ^ mixed(((key % top) ^ pieces.SEED << 16) + number)) | 1
        symbols, skipped = [(i, c) for i, c in enumerate(stretch)], set()
        while True:
            pairs = [(order[a + b], i, n, a + b) for n, ((i, a), (j, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in order and a in plain and b in plain and (i, a, b) not in skipped]
            if not pairs:
                break
            rank, i, n, joined = min(pairs)
            if salt * (rank << 20 | i + 1) % top < int(rate * top):
                skipped.add((i, symbols[n][1], symbols[n + 1][1]))
            else:
                symbols[n : n + 2] = [(i, joined)]
        for _, p in symbols:
            out += [plain[p]] if p in plain else [raw[f"<0x{b:02X}>"] for b in p.encode()]
    return out


def test_dropout_equals_a_naive_agenda():
    import sentencepiece

    library, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Encoder(rate=0.3), random.Random(4)
    words = ["international", "the", "Zusammenhang,", "développement", "日本語", "😀😀", "x" * 37, "_-_", "antidisestablishmentarianism", "12345", "a", "▁b"]
    texts = [t for t in TEXTS if t is not None and len(t) < 100] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n"]) for _ in range(12)) for _ in range(12)]
    different = 0
    for key, text in enumerate(texts):
        got = encoder.encode(text, key - 5)
        assert got == naive_pieces(library, text, key - 5, 0.3), text
        different += got != encoder.encode(text, key + 99)
    assert different > 10
    ids, counts = encoder.encode_all(texts, list(range(-5, len(texts) - 5)))
    assert ids.tolist() == [i for key, text in enumerate(texts) for i in encoder.encode(text, key - 5)] and len(counts) == len(texts)


def test_long_texts_are_cut_alike_in_any_chunks(monkeypatch):
    text = "some words of a longer text\nand  more " * 300
    whole = pieces.Encoder().encode(text, 3)
    monkeypatch.setattr(pieces, "CHUNK", 1000)
    monkeypatch.setattr(pieces, "LONG_CHUNK", 17)
    assert pieces.Encoder().encode(text, 3) == whole


# 7 Exact copies


def test_exact_equals_brute_force(docs, corpus, nothing):
    for tracked in (2048, 4):
        found = exact_dedup.group_duplicates(docs, tracked=tracked).collect()
        groups = {}
        for r in corpus:
            groups.setdefault(r[1] or "", []).append(-1 if r[0] is None else r[0])
        expect = [(r[0], None if max(groups[r[1] or ""]) < 0 else max(groups[r[1] or ""]), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus]
        same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], expect)
        assert sum(r["kept"] for r in found) == len(groups)
        left = exact_dedup.drop_duplicates(docs, tracked=tracked)
        assert left.columns == docs.columns and sorted(r["text"] or "" for r in left.collect()) == sorted(groups)
    assert exact_dedup.group_duplicates(nothing).count() == 0 and exact_dedup.drop_duplicates(nothing).count() == 0


def test_heavy_digests_are_broadcast_winners(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    keyed = exact_dedup.with_digest(rows, "text", "digest").select("id", "digest", F.col("id").alias("uid")).repartition(20)
    found = exact_dedup.heavy_digests(keyed).collect()
    assert [(r["best"]["id"], r["n"]) for r in found] == [(2997, 1000)]
    plan = exact_dedup.group_duplicates(rows, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 8 Toxicity


def toxic_corpus(rng, n):
    bad = ["idiot", "moronic", "stupidity", "worthless"]
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 200)).split()
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_toxicity_on_held_out_rows_and_misspellings(spark, docs, nothing):
    rows = toxic_corpus(random.Random(8), 800)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.where("doc_id < 600").select("doc_id", "toxic"))
    scored = toxicity.with_score(df, model).where("doc_id >= 600").collect()
    right = sum((r["__pl_score"] >= 0.5) == r["toxic"] for r in scored)
    assert right >= 0.97 * len(scored)
    score = model.scorer()
    assert score("w1 w2 idioot w3") > 3 * score("w1 w2 w9 w3") and 0 <= score(None) == score("") == score("!!") < 0.5
    assert all(0 <= r["__pl_score"] <= 1 for r in toxicity.with_score(docs, model).collect()) and toxicity.with_score(nothing, model).count() == 0
    bare = toxicity.train(df.drop("toxic"), df.where("toxic = 0").select("doc_id", "toxic"))
    assert bare.scorer()("idiot") == 0.0 and toxicity.train(nothing, df.select("doc_id", "toxic")).scorer()("x") == 0.0


def test_scores_equal_brute_force_and_long_words_are_seen():
    rng = random.Random(11)
    rows = toxic_corpus(rng, 300)
    model = toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows])
    score = model.scorer()

    def brute(text):
        words = re.findall(r"[^\W_]+(?:['@$!*][^\W_]+)*", text.lower())
        value = []
        for w in words:
            edged = f"<{w}>"
            bag = [edged] + [edged[i : i + n] for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
            value.append(sum(float(model.weights[zlib.crc32(g.encode()) % toxicity.BUCKETS]) for g in bag) / len(bag))
        n = min(4, len(value))
        best = max(sum(value[i : i + n]) / n for i in range(len(value) - n + 1)) if value else 0.0
        return 1 / (1 + math.exp(-(best + model.bias)))

    for text in ["", "one", "You IDIOT!", "stup!dity and wörthless", *[t for _, t, _ in rows[:40]]]:
        assert score(text) == pytest.approx(brute(text), rel=1e-4)
    clean, dirty = "漢字仮名交文" * 30, "漢字仮名交文" * 15 + "idiot" + "漢字仮名交文" * 15
    assert score(dirty) > 1.5 * score(clean)
    pieces_ = toxicity.words_of("x" * 30 + "worthless" + "y" * 30)
    assert any("worthl" in p for p in pieces_) and "".join(p[:8] for p in pieces_[:-1]) + pieces_[-1] == "x" * 30 + "worthless" + "y" * 30
    assert toxicity.words_of("a" * 40) == ["a" * 40]


def test_an_oversized_labelled_text_shuts_out_no_other(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "FIT_BYTES", 200_000)
    df = spark.createDataFrame(toxic_corpus(random.Random(8), 400), "doc_id long, text string, toxic int")
    first = df.where("toxic = 1").orderBy(F.xxhash64(F.lit(toxicity.SEED), "doc_id")).first()["doc_id"]
    df = df.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("w1 "), 100_000)).otherwise(F.col("text")))
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert model.weights is not None and model.scorer()("w1 w2 idiot w3") > 0.5 > model.scorer()("w1 w2 w9 w3")



# 9 Shards


def test_shards_are_even_gapless_and_keep_small_groups_together(spark, docs, corpus, nothing):
    rng = random.Random(9)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else prose(rng, rng.randint(1, 60))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sharding.shard(df).collect()
    total = Counter()
    for r in found:
        total[r["shard"]] += r["size"]
    assert max(total.values()) <= 1.03 * min(total.values()) and set(total) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    again = sharding.shard(df.repartition(3)).collect()
    assert len(again) == len(found)
    small = sharding.shard(docs)
    rows = small.collect()
    body = lambda t: (t or "").encode()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], [(r[0], len(body(r[1])) + 1, zlib.crc32(body(r[1]))) for r in corpus])
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(nothing).count() == 0


# 10 Mixing


def brute_targets(sizes, weights, share, limit):
    named = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [x for x in sizes if x is None]
    weight, left, out, rest = {s: weights[i % len(weights)] for i, s in enumerate(named)}, share * sum(sizes.values()), {}, dict(sizes)
    while rest:
        full = [s for s, n in rest.items() if left * weight[s] / sum(weight[x] for x in rest) > limit * n]
        if not full:
            return out | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        left -= sum(limit * rest[s] for s in full)
        out |= {s: limit * rest.pop(s) for s in full}
    return out


def brute_mix(rows, share=1.5, limit=2.0, weight=None):
    """Copies of (id, text, source): every source put in order whole. The hash, shared with the operator, comes as a function."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    w = [2 ** (math.floor(6 * math.log2(weight or math.log2(2 + n)) + 0.5) / 6) for n in size]
    totals = Counter()
    for (_, _, s, _), n in zip(rows, size):
        totals[s] += n
    goal, copies = brute_targets(totals, (3, 1, 2), share, limit), [0] * len(rows)
    for s in totals:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        expected, full = dict.fromkeys(mine, 0.0), set()
        while totals[s]:
            rest = [i for i in mine if i not in full]
            c = (goal[s] - limit * sum(size[i] for i in full)) / (sum(w[i] * size[i] for i in rest) or 1)
            expected = {i: limit if i in full else c * w[i] for i in mine}
            more = {i for i in rest if expected[i] > limit}
            if not more:
                break
            full |= more
        need = goal[s] - sum(int(expected[i]) * size[i] for i in mine)
        u = {i: ((rows[i][3] % 2**64 >> 12) + 0.5) / 2**52 for i in mine}
        for i in mine:
            copies[i] = int(expected[i])
        odds = {i: u[i] / (1 - u[i]) * (1 - p) / p for i in mine if (p := expected[i] - int(expected[i])) > 1e-12}
        for i in sorted(odds, key=lambda i: (odds[i], rows[i][3])):
            if abs(need - size[i]) < abs(need) or not size[i] and need > 0:
                copies[i] += 1
            need -= size[i]
            if need <= 0:
                break
    return size, goal, copies


def mixed(df):
    from pyspark.sql import functions as F

    keyed = df.withColumn("hash", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"))
    return [((r["doc_id"], r["text"], r["source"], r["hash"]), r) for r in mixing.mix(keyed).collect()]


def test_mix_equals_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(1, 400) if i % 5 else rng.randint(1, 12)) if i % 50 else rng.choice([None, "", " \t"]), rng.choice([None, "a", "B", "é", "😀"]) if i % 3 else "hot") for i in range(1500)]
    found = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    size, goal, copies = brute_mix([x for x, _ in found])
    taken, words = Counter(), Counter()
    for (x, r), n, c in zip(found, size, copies, strict=True):
        assert r["__pl_size"] == n and r["__pl_target"] == pytest.approx(goal[x[2]]) and (not n or r["__pl_copies"] == c), x
        taken[x[2]] += c * n
        words[x[2]] += n
    assert all(abs(taken[s] - goal[s]) <= 200 and goal[s] <= 2 * words[s] + 1e-6 for s in goal)
    assert len({(n, c) for n, c in zip(size, copies) if 100 < n < 110}) > 2  # chances differ, draws too
    even = brute_targets(dict(words), (3, 1, 2), 1.5, 2.0)
    assert even == goal and sum(goal.values()) == pytest.approx(1.5 * sum(size))


def test_a_document_s_chance_follows_its_weight(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "one two three", "s", 1.0 + i % 3) for i in range(6000)], "doc_id long, text string, source string, w double")
    got = {r["w"]: r["m"] for r in mixing.mix(df, share=0.5, weight=F.col("w")).groupBy("w").agg(F.avg("__pl_copies").alias("m")).collect()}
    c = 0.5 * 3 / sum(2 ** (round(6 * math.log2(w)) / 6) for w in (1, 2, 3))
    for w, m in got.items():
        assert m == pytest.approx(c * 2 ** (round(6 * math.log2(w)) / 6), abs=0.03)
    odd = df.withColumn("w", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, float("nan")).when(F.col("doc_id") % 4 == 2, -5.0).otherwise(F.col("w")))
    assert {r["doc_id"] % 4 for r in mixing.mix(odd, share=0.2, weight=F.col("w")).where("__pl_copies > 0").collect()} == {3}
    high = mixing.mix(df, share=1.5, weight=F.col("w")).groupBy("w").agg(F.min("__pl_copies").alias("lo"), F.max("__pl_copies").alias("hi")).collect()
    assert {r["w"]: (r["lo"], r["hi"]) for r in high}[3.0] == (2, 2)  # stopped at the limit: certain


def test_the_cut_falls_within_repeated_rows(spark, docs, corpus, nothing):
    rows = [(1, "same text of five words", "a")] * 700 + [(2, None, "b")] * 30 + [(None, None, None)] * 10 + [(3, "x y", "b")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    taken, target = Counter(), {}
    for _, r in mixed(df):
        taken[r["source"]] += r["__pl_copies"] * r["__pl_size"]
        target[r["source"]] = r["__pl_target"]
    assert all(abs(taken[s] - t) <= 2.5 for s, t in target.items()) and target[None] == 0
    from pyspark.sql import functions as F

    clash = docs.drop("key").withColumns({c: F.lit(1) for c in ("last", "cs", "s", "bin", "rank", "need", "total", "target", "h", "tie", "step")})
    out = mixing.mix(clash)
    assert out.count() == len(corpus) and mixing.mixed_rows(clash).columns == clash.columns and mixing.mix(nothing).count() == 0
    assert sorted(map(repr, mixing.mixed_rows(clash).select("doc_id", "text").collect())) == sorted(map(repr, mixing.mixed_rows(clash.repartition(2)).select("doc_id", "text").collect()))


# Queries and pipeline


@pytest.mark.parametrize("name", [n for n in llm.queries() if n in llm.oracle_sql()])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    found = con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in found.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    same([tuple(r[c] for c in order) for r in df.collect()], [tuple(r[names.index(c)] for c in order) for r in found.fetchall()])


def test_line_query_has_a_row_for_each_line(spark):
    found = llm.queries()["op4_line_dedup"](spark, SF).select("doc_id", "line_no").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    lines = [(d["doc_id"], n) for d in docs for n in range(len(re.sub("\r\n?", "\n", d["text"] or "").removesuffix("\n").split("\n")) if d["text"] else 0)]
    assert sorted((r["doc_id"], r["line_no"]) for r in found) == sorted(lines)


@pytest.mark.parametrize("name", [n for n in llm.queries() if n not in llm.oracle_sql() and n != "op4_line_dedup"])
def test_query_has_a_row_for_each_row(spark, name):
    df = llm.queries()[name](spark, SF)
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.reject_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["__pl_score"] for r in toxicity.with_score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] < P.TOXIC}
    assert {r["doc_id"] for r in kept.collect()} == set(rows)
    best = {}
    for i, t in rows.items():
        best[t] = max(best.get(t, i), i)
    rows = {i: t for t, i in best.items()}
    least = {c for _, _, c in components([(i, t) for i, t in rows.items()])}
    near = P.near(spark, P.exact(spark, kept, SF), SF)
    assert {r["doc_id"] for r in near.collect()} == least
    copies = Counter()
    for r in mixing.mix(near).collect():
        copies[r["doc_id"]] += r["__pl_copies"]
    out = P.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == +copies
    encoder = pieces.Encoder()
    assert all(encoder.decode(r["token_ids"]) == rows[r["doc_id"]] for r in out)
