import random

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import diff_kernel as K

LINE = st.sampled_from(["a", "b", "c", "", " a", "A"])
TEXT = st.lists(LINE, max_size=14).map("\n".join)


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_edits_rebuild_the_right_side_and_are_shortest(left, right):
    a, b = K.lines_of(left), K.lines_of(right)
    edits, gave_up = K.line_edits(a, b)
    assert not gave_up and K.rebuilt(edits, b) == b
    assert [a[x] for _, x, _ in edits if x is not None] == a
    assert sum(op == "equal" for op, _, _ in edits) == longest_common(a, b)
    back, _ = K.line_edits(b, a)
    assert sum(op == "insert" for op, _, _ in edits) == sum(op == "delete" for op, _, _ in back)


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT, st.booleans(), st.booleans(), st.booleans())
def test_compare_counts_add_up(left, right, case, space, blank):
    found = K.compare(left, right, case=case, space=space, blank=blank)
    assert 0 <= found["similarity"] <= 1 and found["identical"] == (found["added"] + found["removed"] + found["changed"] == 0)
    if not blank:
        assert found["removed"] + found["changed"] + found["unchanged"] == len(K.lines_of(left))
        assert found["added"] + found["changed"] + found["unchanged"] == len(K.lines_of(right))


def test_lines_and_words():
    assert K.lines_of("") == [] and K.lines_of("\n") == [""] and K.lines_of("a\r\nb\rc\n") == ["a", "b", "c"]
    left, right = K.word_segments("the quick fox", "the slow fox")
    assert left == [("the ", "equal"), ("quick", "delete"), (" fox", "equal")] and right[1] == ("slow", "insert")


def test_budget_and_overlap_gate():
    rng = random.Random(1)
    a, b = [f"l{rng.random()}" for _ in range(300)], [f"r{rng.random()}" for _ in range(300)]
    assert K.line_edits(a, b)[1]  # over 400 lines that share nothing
    assert not K.line_edits(a[:200], b[:200])[1] and K.line_edits(["a"], ["b"], budget=1)[1] and not K.line_edits(["a"], ["b"], budget=2)[1]


def test_replacements_pair_only_after_deletions():
    rows = K.compare("a\nb\nc", "a\nx\nc")["rows"]
    assert rows == [("equal", 0, 0), ("replace", 1, 1), ("equal", 2, 2)]


def test_patch():
    left, right = "\n".join("abcdefghijklmnop"), "\n".join("abcXefghijklmnoP")
    patch = K.unified(left, right, context=1, names=("old", "new"))
    assert patch.startswith("--- old\n+++ new\n@@ -3,3 +3,3 @@\n c\n-d\n+X\n e\n@@ -15,2 +15,2 @@\n") and K.unified(left, left) == ""
    assert K.unified("", "a") == "--- left\n+++ right\n@@ -0,0 +1 @@\n+a\n"
