from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusgauge.functions.membership import key_bitmap, maybe_among
from corpusgauge.operators import diffs as D
from corpusgauge.operators import reviews as RV

MODIFIED = """diff --git a/src/one.py b/src/one.py
index 1..2 100644
--- a/src/one.py
+++ b/src/one.py
@@ -1,3 +1,4 @@ def head():
 same
-old
+new
+newer
@@ -10 +12 @@
  +indented first line counts once stripped
+++ plus plus
--- minus minus
-gone
"""
ADDED = """diff --git a/n w.txt b/n w.txt
new file mode 100644
--- /dev/null
+++ b/n w.txt
@@ -0,0 +1,2 @@
+a
+b
\\ No newline at end of file
"""
DELETED = """diff --git a/d.py b/d.py
deleted file mode 100644
--- a/d.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
"""
RENAMED = """diff --git a/old b/x.py b/new b/y.py
similarity index 90%
rename from old b/x.py
rename to new b/y.py
@@ -3,1 +3,1 @@
-p
+q
"""
COPIED = "diff --git a/c b/d\nsimilarity index 99%\ncopy from c\ncopy to d\n"
BINARY = "diff --git a/i.png b/i.png\nindex 1..2\nBinary files a/i.png and b/i.png differ\n@@ -1 +1 @@\n+x\n"
EMPTY_CHANGE = "diff --git a/mode.sh b/mode.sh\nold mode 100644\nnew mode 100755\n"


@pytest.fixture
def make_diffs(spark):
    def build(*raws: str):
        return spark.createDataFrame(
            [("r", i, raw) for i, raw in enumerate(raws)], "repo_id STRING, diff_id BIGINT, raw STRING"
        )

    return build


def test_files_of_a_mixed_diff(make_diffs):
    raw = "commit 1\n\n" + MODIFIED + ADDED + DELETED + RENAMED + COPIED + BINARY + EMPTY_CHANGE
    rows = D.file_diffs(make_diffs(raw)).orderBy("file_idx").collect()
    assert [(r.path, r.change_type, r.old_path, r.additions, r.deletions, len(r.hunks)) for r in rows] == [
        ("src/one.py", "modified", None, 3, 2, 2),
        ("n w.txt", "added", None, 2, 0, 1),
        ("d.py", "deleted", None, 0, 2, 1),
        ("new b/y.py", "renamed", "old b/x.py", 1, 1, 1),
        ("d", "renamed", None, 0, 0, 0),
        ("i.png", "modified", None, 0, 0, 0),
        ("mode.sh", "modified", None, 0, 0, 0),
    ]
    assert [r.is_binary for r in rows] == [False] * 5 + [True, False]
    assert {r.parse_error for r in rows} == {None}


def test_hunks(make_diffs):
    rows = D.hunks(make_diffs(MODIFIED)).orderBy("hunk_idx").collect()
    assert [(r.old_start, r.old_count, r.new_start, r.new_count) for r in rows] == [(1, 3, 1, 4), (10, 1, 12, 1)]
    assert rows[0].content == "same\n-old\n+new\n+newer"
    assert rows[1].content.startswith("+indented first line")


def test_stats_keep_blank_diffs(make_diffs):
    rows = D.diff_stats(make_diffs(MODIFIED + ADDED, "", " \n\t")).orderBy("diff_id").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 5, 2), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_signs_inside_lines_do_not_count(make_diffs):
    raw = "diff --git a/a b/a\n@@ -1,2 +1,2 @@\n x = a + b - c\n-x - 1\n+x + 1\n+\n-\n"
    rows = D.file_diffs(make_diffs(raw)).collect()
    assert (rows[0].additions, rows[0].deletions) == (2, 2)


def test_section_without_a_proper_header_is_flagged(make_diffs):
    rows = D.file_diffs(make_diffs("diff --git nonsense\n+x\n" + ADDED)).orderBy("file_idx").collect()
    assert [(r.path, r.parse_error is None) for r in rows] == [(None, False), ("n w.txt", True)]


def test_carriage_returns_stay_in_the_lines(make_diffs):
    raw = "diff --git a/a b/a\r\n@@ -1 +1 @@ f\r\n-x\r\n+y\r\n"
    row = D.file_diffs(make_diffs(raw)).collect()[0]
    assert (row.path, row.additions, row.deletions) == ("a\r", 1, 1)
    assert row.hunks[0].content == "-x\r\n+y"


def test_rebuilt_text(make_diffs):
    row = RV.rebuilt_diffs(make_diffs(ADDED + BINARY)).collect()[0]
    assert row.diff_text == (
        "--- a/n w.txt\n+++ b/n w.txt\n@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline at end of file\n"
        "--- a/i.png\n+++ b/i.png"
    )


def test_counts_agree_with_the_hunks(make_diffs):
    """Lines that only look like a header, stripped first lines and signs outside of hunks."""
    head = "diff --git a/a b/a\n"
    raws = [
        head + "+outside\n@@ -1 +1 @@\n+in\n-in",
        head + "@@ -bad @@\n+no\n@@ -1 +1 @@\n+yes",
        head + "@@ -1 +1 @@\n+a\n@@ -x @@\n+b\n@@ -2 +2 @@\n\n \t -c\n+d",
        head + "@@ -1 +1 @@\n   +++ three\n+++ more\n--- minus\n-",
        head + "@@ -1 +1 @@",
        head + "@@ -1,99999999999 +1 @@\n+x",
        "\n " + head + "@@ -1 +1 @@ +x\n+y",
    ]
    rows = D.file_diffs(make_diffs(*raws)).orderBy("diff_id").collect()
    wanted = [by_hand(raw)[0] for raw in raws[:6]]
    assert [(r.additions, r.deletions, [h.content for h in r.hunks]) for r in rows[:6]] == [w[3:] for w in wanted]
    stats = D.diff_stats(make_diffs(*raws)).orderBy("diff_id").collect()
    assert [(s.total_additions, s.total_deletions) for s in stats] == [(r.additions, r.deletions) for r in rows]
    narrow = D.file_diffs(make_diffs(*raws), with_hunks=False)
    assert "hunks" not in narrow.columns
    assert [(r.additions, r.deletions) for r in narrow.orderBy("diff_id").collect()] == [(r.additions, r.deletions) for r in rows]


def test_a_diff_with_very_many_files(make_diffs):
    raw = "".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +1 @@\n-a\n+b\n" for i in range(3000))
    row = D.diff_stats(make_diffs(raw)).collect()[0]
    assert tuple(row) == (0, 3000, 3000, 3000)


def test_file_contexts(spark, make_diffs, make_files):
    raw = "".join(f"diff --git a/{p} b/{p}\n" for p in ("b.py", "missing.py", "a.py"))
    files = make_files({"a.py": "A", "b.py": "B", "c.py": "C"})
    row = RV.file_contexts(make_diffs(raw), files).collect()[0]
    assert row.file_context == "### b.py\n```\nB\n```\n\n### a.py\n```\nA\n```\n"


def test_contents_that_no_diff_touches_stay_in_their_scan(spark, make_files):
    files = make_files({f"f{i}.py": "x" for i in range(2000)})
    wanted = spark.createDataFrame([("r", f"f{i}.py") for i in range(0, 2000, 9)] + [("s", "f1.py"), (None, "f2.py")],
                                   "repo_id STRING, path STRING")
    kept = maybe_among(files, key_bitmap(wanted, "repo_id", "path"), "repo_id", "path")
    assert kept.columns == files.columns
    assert {r.path for r in kept.collect()} == {f"f{i}.py" for i in range(0, 2000, 9)}
    nothing = maybe_among(files, key_bitmap(wanted.limit(0), "repo_id", "path"), "repo_id", "path")
    assert nothing.count() == 0
    # of the files only what the broadcast bitmap lets through is shuffled
    plan = kept.groupBy("path").count()._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


LINES = [
    "diff --git a/x b/y", "diff --git a/p q/r.py b/p q/r.py", "diff --git broken", " diff --git a/i b/i",
    "new file mode 100644", "deleted file mode 100644", "similarity index 90%", "similarity index x%",
    "rename from old name", "rename to new b/name", "rename from ", "Binary files a/i and b/i differ",
    "Binary files differ", "--- a/x", "+++ b/y", "@@ -1,2 +3,4 @@ def f():", "@@ -1 +1 @@", "@@ -7 +8,0 @@x",
    "@@ bad @@", "+added", "-removed", "+", "-", "+++ plus", "--- minus", " context", "  +indented", "", "\t", "x",
]


def by_hand(raw: str) -> list[tuple]:
    """File rows of a diff, line by line."""
    sections: list[list[str]] = [[]]
    for line in raw.split("\n"):
        if line.startswith("diff --git "):
            sections.append([])
        sections[-1].append(line)
    rows = []
    for lines in sections:
        if not "\n".join(lines).strip().startswith("diff --git"):
            continue
        header = [m for m in (re.match(r"diff --git a/(.*) b/(.*)$", line) for line in lines) if m]
        starts = lambda prefix: [line for line in lines if line.startswith(prefix)]
        moved_from, moved_to = starts("rename from "), starts("rename to ")
        if starts("new file mode"):
            kind = "added"
        elif starts("deleted file mode"):
            kind = "deleted"
        elif moved_from or [x for x in lines if re.fullmatch(r"similarity index \d+%", x)]:
            kind = "renamed"
        else:
            kind = "modified"
        path, old = (header[0].group(2) if header else None), None
        if kind == "renamed" and moved_from and moved_to:
            old = moved_from[0].removeprefix("rename from ")
            path = moved_to[0].removeprefix("rename to ") if header else None
        bodies: list[list[str]] = []
        for line in lines:
            if re.match(r"@@ -\d+(,\d+)? \+\d+(,\d+)? @@", line):
                bodies.append([])
            elif bodies:
                bodies[-1].append(line)
        if [x for x in lines if re.fullmatch(r"Binary files .* differ", x)]:
            bodies = []
        contents = ["\n".join(body).strip() for body in bodies]
        changed = [line for content in contents for line in content.split("\n")]
        added = sum(x.startswith("+") and not x.startswith("+++") for x in changed)
        removed = sum(x.startswith("-") and not x.startswith("---") for x in changed)
        rows.append((path, kind, old, added, removed, contents))
    return rows


def test_fuzzed_diffs_follow_the_line_by_line_reading(make_diffs):
    rng = random.Random(3)
    raws = ["\n".join(rng.choices(LINES, k=rng.randint(1, 25))) for _ in range(1500)]
    raws += ["\n".join([LINES[0], *rng.choices(LINES[4:], k=12), LINES[1], *rng.choices(LINES[13:], k=9)]) for _ in range(500)]
    df = make_diffs(*raws)
    got: dict[int, list[tuple]] = {i: [] for i in range(len(raws))}
    for r in D.file_diffs(df).orderBy("diff_id", "file_idx").collect():
        contents = [h.content for h in r.hunks]
        got[r.diff_id].append((r.path, r.change_type, r.old_path, r.additions, r.deletions, contents))
    wrong = [(raw, got[i], by_hand(raw)) for i, raw in enumerate(raws) if got[i] != by_hand(raw)]
    assert wrong[:1] == []
    stats = {r.diff_id: (r.files_changed, r.total_additions) for r in D.diff_stats(df).collect()}
    assert stats == {i: (len(rows), sum(row[3] for row in rows)) for i, rows in got.items()}


def test_file_contexts_make_each_text_once(spark):
    names = ("a", "b", "c")
    raw = "".join(f"diff --git a/{n} b/{n}\n--- a/{n}\n+++ b/{n}\n@@ -1 +1 @@\n-x\n+y\n" for n in names)
    # one number twice, in one repository and in two; a row without a number
    rows = [("r", i, raw) for i in range(40)] + [("r", 0, raw), ("s", 1, raw), ("r", None, raw), ("t", 99, raw)]
    diffs = spark.createDataFrame(rows, "repo_id STRING, diff_id BIGINT, raw STRING")
    held = [("r", "a", "2"), ("r", "a", "1"), ("r", "b", None), ("r", "x", "0"), ("s", "a", "3"), ("s", "c", "4"), ("t", "b", None)]
    files = spark.createDataFrame(held, "repo_id STRING, path STRING, content STRING")

    def block(path, *contents):
        return [f"### {path}\n```\n{c}\n```\n" for c in contents]

    wanted = dict.fromkeys([*range(40), None], "\n".join(block("a", "1", "2")))
    wanted[0] = "\n".join(block("a", "1", "1", "2", "2"))
    wanted[1] = "\n".join([*block("a", "1", "2", "3"), *block("c", "4")])
    wanted[99] = ""
    assert {r.diff_id: r.file_context for r in RV.file_contexts(diffs, files).collect()} == wanted
    # columns of a text are computed once, whatever the number of its diffs
    shown = RV.file_contexts(diffs, files, lambda text: [text.alias("text"), F.uuid().alias("made")]).collect()
    assert {r.diff_id: r.text for r in shown} == wanted
    assert len({r.made for r in shown}) == 4
