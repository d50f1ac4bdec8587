from __future__ import annotations

from corpusgauge.operators import repo as RE
from corpusgauge.operators import structure as S
from corpusgauge.operators.positions import with_positions

TREE = {
    "Zeta/a.py": "", "alpha/b.py": "", "alpha/Beta/c.py": "", "alpha/__init__.py": "",
    "alpha/beta_file.py": "", "README.md": "", "b.py": "", ".hidden/x.py": "", "alpha/.secret": "",
    "build/out.py": "", "pkg/__pycache__/m.pyc": "", "onlyhidden/.x": "", "m/build/__init__.py": "",
}


def test_nodes_modules_and_pruning(make_files):
    rows = S.tree_nodes(make_files(TREE)).collect()
    kinds = {r.path: r.node_type for r in rows}
    assert kinds == {
        "": "directory", "Zeta": "directory", "Zeta/a.py": "file", "alpha": "module",
        "alpha/b.py": "file", "alpha/Beta": "directory", "alpha/Beta/c.py": "file",
        "alpha/__init__.py": "file", "alpha/beta_file.py": "file", "README.md": "file", "b.py": "file",
    }
    by_path = {r.path: r for r in rows}
    assert (by_path[""].name, by_path[""].parent, by_path[""].depth) == ("r", None, 0)
    assert (by_path["Zeta"].parent, by_path["alpha/Beta/c.py"].parent) == ("", "alpha/Beta")
    assert by_path["alpha/Beta/c.py"].depth == 3


def test_display_order(make_files):
    rows = S.ordered_tree(S.tree_nodes(make_files(TREE))).collect()
    assert [r.path for r in rows] == [
        "", "alpha", "alpha/Beta", "alpha/Beta/c.py", "alpha/__init__.py", "alpha/b.py",
        "alpha/beta_file.py", "Zeta", "Zeta/a.py", "b.py", "README.md",
    ]


def test_root_survives_alone_and_may_be_a_module(make_files):
    assert [r.path for r in S.tree_nodes(make_files({".x/y": ""})).collect()] == [""]
    root = S.tree_nodes(make_files({"__init__.py": ""})).filter("depth = 0").collect()[0]
    assert root.node_type == "module"
    # the marker file itself may be excluded
    rows = S.tree_nodes(make_files({"p/__init__.py": "", "p/a.py": ""}), ["__init__*"]).collect()
    assert {(r.path, r.node_type) for r in rows} == {("", "directory"), ("p", "module"), ("p/a.py", "file")}


def test_imports_and_dependencies(make_files):
    df = make_files(
        {
            "a.py": "import os\nimport os\nfrom .core import x\nfrom a.b import c\n",
            "b.js": "import x from './lib'\nimport r from 'react'\nconst q = require('a/b')\n",
            "c.tsx": "import x from './lib'\n",
            "d.h": '#include "x/y.h"\n',
            "e.c": '#include "x/y.h"\n#include <stdio.h>\n',
            "node_modules/f.js": "import x from './lib'\n",
        }
    )
    found = {(r.path, r.module) for r in S.imports(df).collect()}
    assert found == {
        ("a.py", "os"), ("a.py", ".core"), ("a.py", "a.b"), ("b.js", "./lib"), ("b.js", "react"),
        ("b.js", "a/b"), ("e.c", "x/y.h"), ("e.c", "stdio.h"),
    }
    assert S.imports(df).count() == len(found)
    edges = {(r.source, r.target, r.dependency_type) for r in S.dependencies(df).collect()}
    assert edges == {
        ("a.py", ".core", "import"), ("b.js", "./lib", "import"), ("b.js", "a/b", "import"),
        ("e.c", "x/y.h", "import"),
    }


def test_entry_points(make_files):
    df = make_files(
        {
            "x/main.py": "", "y.py": "if __name__ == '__main__':\n", "z.py": "# nothing",
            "lib.go": "func main() {}", "lib2.go": "func mainly() {}", "w.rb": "func main() {}",
            ".h/main.py": "", "dist/main.js": "", "Main.java": "", "main.java": "",
        }
    )
    assert {r.path for r in S.entry_points(df).collect()} == {"x/main.py", "y.py", "lib.go", "Main.java"}


def test_language_stats_and_ranking(make_files):
    df = make_files(
        {"b.py": "1\n2\n", "a.go": "1\n2", "c.js": "1\n2\n3\n4\n", "x.pyc": "9\n9\n", "Makefile": "", "n": ""}
    )
    rows = RE.language_stats(df).orderBy("language_rank").collect()
    assert [(r.language, r.files, r.lines, r.percentage) for r in rows] == [
        ("JavaScript", 1, 4, 50.0), ("Go", 1, 2, 25.0), ("Python", 1, 2, 25.0),
        ("Makefile", 1, 0, 0.0), ("Other", 1, 0, 0.0),
    ]
    totals = RE.repo_totals(df).collect()[0]
    assert (totals.total_files, totals.total_lines) == (5, 8)
    assert {(r.language, r.files) for r in RE.language_files(df).collect()} == {
        ("JavaScript", 1), ("Go", 1), ("Python", 1), ("Makefile", 1), ("Other", 2),
    }


def test_repository_with_everything_excluded_keeps_its_overview(spark, make_files):
    commits = spark.sql(
        "SELECT 'q' repo_id, 'abc1234567' hash, ' m\n' message, 'a' author, TIMESTAMP_NTZ '2024-01-02 03:04:05' date"
    )
    row = RE.repo_overview(make_files({"x.pyc": "1\n"}), commits).collect()[0]
    assert (row.total_files, row.total_lines, row.languages, row.recent_commits) == (0, 0, [], [])
    prompt = RE.repo_prompts(RE.repo_overview(make_files({"a.py": "1\n"}, repo_id="q"), commits)).collect()[0]
    assert "Languages: Python: 100.0%\n" in prompt.prompt
    assert "- [abc1234] 2024-01-02: m\n" in prompt.prompt


def test_recent_commits_and_display(spark):
    commits = spark.range(40).selectExpr(
        "CASE WHEN id % 4 = 0 THEN 'small' ELSE 'big' END AS repo_id",
        "lpad(CAST(id AS STRING), 40, '0') AS hash",
        "repeat('m', CAST(id + 40 AS INT)) AS message",
        "'a' AS author",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id DIV 2 AS INT)) AS date",
    )
    recent = RE.recent_commits(commits, 3)
    rows = recent.filter("repo_id = 'big'").orderBy("commit_rank").collect()
    assert [int(r.hash) for r in rows] == [38, 39, 37]
    shown = RE.displayed_commits(recent, shown=2).filter("repo_id = 'big'").collect()
    assert [len(r.message) for r in shown] == [60, 60]


def test_positions_are_gapless_whatever_the_partitions(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", n % 17) for n in range(400)] + [("b", 5), (None, 1), (None, 0)])]
    table = spark.createDataFrame(rows, "k STRING, v INT, position INT").repartition(7)
    got = with_positions(table, ["k"], ["v"]).collect()
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        placed = sorted((r.position, r.v) for r in got if r.k == key)
        assert [p for p, _ in placed] == list(range(1, len(placed) + 1))
        assert [v for _, v in placed] == sorted(v for k, v, _ in rows if k == key)
    assert with_positions(table.limit(0), ["k"], ["v"]).collect() == []
    plan = with_positions(table, [], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(__part" in plan  # never over a whole key
