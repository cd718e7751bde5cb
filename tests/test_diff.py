import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchweave.operators import diff

def hunk(old_at, new_at, marks, short=False, end="\n"):
    """A hunk of lines with the marks given, and what its lines should be read as; counts of one are left out if ``short``."""
    olds, news = sum(m != "+" for m in marks), sum(m != "-" for m in marks)
    count = lambda n: "" if short and n == 1 else f",{n}"
    lines, read, old, new = [f"@@ -{old_at}{count(olds)} +{new_at}{count(news)} @@"], [], old_at, new_at
    for k, mark in enumerate(marks):
        lines.append(f"{mark}w{k}")
        read.append(({" ": "CONTEXT", "+": "ADDED", "-": "REMOVED"}[mark], old if mark != "+" else None, new if mark != "-" else None))
        old, new = old + (mark != "+"), new + (mark != "-")
    return end.join(lines), read


def sound(*hunks):
    return "\n".join(text for text, _ in hunks), [line for _, read in hunks for line in read], None


NOTE = "\\ No newline at end of file"
CASES = {
    "mixed": sound(hunk(4, 9, " -+ -++ ")),
    "absent counts": sound(hunk(3, 3, "-+", short=True), hunk(40, 40, "+-", short=True)),
    "only added": sound(hunk(0, 1, "++++")),
    "only removed": sound(hunk(1, 0, "---")),
    "markers": (hunk(6, 6, "-")[0].replace("+6,0", "+6,1") + f"\n{NOTE}\n+z\n{NOTE}", [("REMOVED", 6, None), ("ADDED", None, 6)], None),
    "returns": sound(hunk(8, 8, "-+ ", end="\r\n")),
    "preamble": ("index 1..2\n--- a/q\n+++ b/q\n" + hunk(5, 5, " +")[0], hunk(5, 5, " +")[1], None),
    "bad count": (hunk(5, 5, "-+ ")[0].replace("-5,2", "-5,3"), [], "count mismatch"),
    "bad line": (hunk(5, 5, " ")[0].replace("\n w0", "\n*w0"), [], "bad line"),
    "bad header": ("@@ -x +y @@\n a", [], "bad header"),
    "overflow": (hunk(5, 5, "-+")[0].replace("-5,1", "-50000000000,1"), [], "bad header"),
    "empty": ("", [], None),
    "null": (None, [], None),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("p", name, patch) for name, (patch, _, _) in CASES.items()]
    return diff.parse_patches(spark.createDataFrame(rows, "pr_key string, path string, patch string")).cache()


def test_lines_and_errors(parsed):
    got = {}
    for r in sorted(diff.hunk_lines(parsed).collect(), key=lambda r: (r.path, r.hunk_idx, r.line_idx)):
        got.setdefault(r.path, []).append((r.line_type, r.old_no, r.new_no))
    errors = {r.path: r.error for r in diff.file_checks(parsed).collect()}
    for name, (_, lines, error) in CASES.items():
        assert got.get(name, []) == lines, name
        assert errors.get(name) == error, name


def test_carriage_return_is_stripped(parsed):
    assert [r.content for r in diff.hunk_lines(parsed).where("path = 'returns'").orderBy("line_idx").collect()] == ["w0", "w1", "w2"]


def test_render_has_both_counts(parsed):
    rows = {(r.path, r.hunk_idx): r.rendered for r in diff.render_hunks(parsed).collect()}
    assert rows["absent counts", 1] == "@@ -40,1 +40,1 @@\n+w0\n-w1"


def test_annotate(spark):
    text = "@@ -1,3 +3,4 @@\n public class A {\n-    int a = 1;\n+    int b = 2;\n\\ No newline"
    plain = "no header\n+x"
    rows = spark.createDataFrame([(1, text), (2, plain)], "k int, rendered string")
    got = {r.k: r.annotated for r in diff.annotate(rows, ["k"]).collect()}
    assert got[1] == "@@ -1,3 +3,4 @@\n     3 | public class A {\n-      |     int a = 1;\n+    4 |     int b = 2;\n\\ No newline"
    assert got[2] == plain


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12)), min_size=1, max_size=20))
def test_lines_anchor_and_rebuild(spark, pairs):
    rows = []
    for k, (old, new) in enumerate(pairs):
        text = "\n".join(list(difflib.unified_diff(old, new, lineterm="", n=1))[2:])
        rows.append(("p", str(k), text))
    lines = diff.hunk_lines(diff.parse_patches(spark.createDataFrame(rows, "pr_key string, path string, patch string"))).collect()
    for k, (old, new) in enumerate(pairs):
        own = sorted((r for r in lines if r.path == str(k)), key=lambda r: (r.hunk_idx, r.line_idx))
        assert all(old[r.old_no - 1] == r.content for r in own if r.old_no)
        assert all(new[r.new_no - 1] == r.content for r in own if r.new_no)
        gone = {r.old_no for r in own if r.line_type == "REMOVED"}
        added = {r.new_no for r in own if r.line_type == "ADDED"}
        assert [x for i, x in enumerate(old, 1) if i not in gone] == [x for i, x in enumerate(new, 1) if i not in added]
