from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusgauge.functions import rules as R
from corpusgauge.functions.text import folded
from corpusgauge.operators import quality as Q
from corpusgauge.plans.queries import QUERIES
from corpusgauge.sources.bindings import FIXTURE_SCHEMAS


def issues(df, **options):
    rows = Q.issues(df, **options).orderBy("path", "issue_idx").collect()
    return [(r.path, r.line, r.issue_type, r.severity) for r in rows]


def report(df, **options):
    return Q.quality_report(Q.repo_metrics(Q.file_metrics(df, **options))).collect()[0]


def test_issue_positions_and_order(make_files):
    df = make_files({"a.py": "x = 1\n# TODO a # TODO b\n\npassword = 'p'\nprint(250)\n# TODO\n"})
    assert issues(df) == [
        ("a.py", 2, "todo_comment", "info"),
        ("a.py", 2, "todo_comment", "info"),
        ("a.py", 6, "todo_comment", "info"),
        ("a.py", 4, "hardcoded_password", "error"),
        ("a.py", 5, "debug_statement", "info"),
        ("a.py", 5, "magic_number", "info"),
    ]


def test_user_rules(make_files):
    rule = R.Rule("tab", r"\t", "Tab found", "warning")
    assert issues(make_files({"a.py": "a\n\tb\tc"}), rules=[rule]) == [
        ("a.py", 2, "tab", "warning"),
        ("a.py", 2, "tab", "warning"),
    ]


@pytest.mark.parametrize(("body", "expected"), [(49, None), (50, 51)])
def test_function_threshold(make_files, body, expected):
    df = make_files({"a.py": "def f(a):\n" + "\n".join(["    x"] * body)})
    found = Q.issues(df).filter("issue_type = 'long_function'").collect()
    if expected is None:
        assert found == []
    else:
        assert found[0].message == f"Function 'f' has {expected} lines (threshold: 50)"


def test_function_extent_starts_at_the_blank_lines_above(make_files):
    code = "x = 1\n\n\ndef foo(\n): pass\n" + "y\n" * 50 + "  async def bar ( a):\n z\n"
    rows = Q.file_extents(make_files({"a.py": code})).orderBy("function_idx").collect()
    assert [(r.name, r.line, r.lines) for r in rows] == [("foo", 2, 55), ("bar", 56, 3)]


def test_function_headers_by_language(make_files):
    df = make_files(
        {
            "a.js": "function one(a) {}\nlet x\ntwo = async function () {}\n three: (q) => {}\n",
            "a.ts": "async function four() {}\n",
            "a.go": "func (s *S) Five(a int) {}\nfunc six() {}\n",
            "A.java": "class A {\n  public static List<String[]> seven(int a) {}\n  void eight() {}\n}\n",
            "a.rb": "def nine()\n",
        }
    )
    rows = Q.file_extents(df).orderBy("path", "function_idx").collect()
    assert [(r.path, r.name, r.line) for r in rows] == [
        ("A.java", "seven", 2),
        ("A.java", "eight", 3),
        ("a.go", "Five", 1),
        ("a.go", "six", 2),
        ("a.js", "one", 1),
        ("a.js", "two", 3),
        ("a.js", "three", 4),
        ("a.ts", "four", 1),
    ]


def test_many_matches_in_one_file(make_files):
    df = make_files({"a.py": "\n".join(["250 # TODO"] * 20000)})
    rows = Q.issues(df).groupBy("issue_type").agg(F.count("*").alias("n"), F.max("line").alias("last"))
    assert {(r.issue_type, r.n, r["last"]) for r in rows.collect()} == {
        ("magic_number", 20000, 20000),
        ("todo_comment", 20000, 20000),
    }


def test_scope_and_empty_files(make_files):
    df = make_files(
        {
            "a.py": "if x:\n  y\n",
            "notes.txt": "for while",
            "b.unknown": "if if if",
            "node_modules/c.js": "if",
            "src/rebuilding.py": "if",
            "empty.py": "",
            "big.py": "if if if",
        },
        sizes={"big.py": 600 * 1024},
    )
    row = report(df)
    # the empty and the oversize file count, but bring nothing
    assert (row.files_analyzed, row.total_lines, row.complexity_score) == (4, 3, 2 + 3)
    assert report(df, excludes=["a.*"]).files_analyzed == 5


def test_repository_without_files_in_scope_is_clean(make_files):
    row = report(make_files({"x.unknown": "password = 'p'"}))
    assert (row.files_analyzed, row.score, row.grade, row.errors) == (0, 100.0, "Excellent", 0)


def test_score_and_grades(spark):
    rows = [
        (0, 0, 5, 5, 5), (10, 20, 0, 0, 0), (30, 20, 0, 0, 0), (12, 20, 1, 1, 1),
        (40, 20, 3, 2, 1), (40, 20, 8, 0, 0), (40, 20, 30, 0, 0),
    ]
    df = spark.createDataFrame(
        rows, "complexity BIGINT, total_lines BIGINT, errors BIGINT, warnings BIGINT, infos BIGINT"
    )
    got = [(r.score, r.grade) for r in Q.with_score(df.coalesce(1)).collect()]
    expected = [
        (100.0, "Excellent"), (100.0, "Excellent"), (80.0, "Good"), (88.5, "Good"),
        (60.5, "Fair"), (40.0, "Needs Improvement"), (0.0, "Poor"),
    ]
    assert [(pytest.approx(s), g) for s, g in expected] == got


def test_report_text(make_files):
    code = "token = 'abc'\n" + "# FIXME\n" * 6 + "x\n" * 20
    row = report(make_files({"a.py": code}))
    assert row.summary == (
        "Quality Score: 83.0/100 (Good)\nFiles Analyzed: 1\n"
        "Issues Found: 7 total (1 errors, 6 warnings, 0 info)\n"
        "\nCritical issues require immediate attention, particularly potential security concerns.\n"
        "\nConsider addressing the warnings to improve code maintainability."
    )


def test_both_ways_to_count_agree(make_files):
    df = make_files({"a.py": "# TODO\n" + "def f(a):\n" + "    x = 300\n" * 60, "b.js": "debugger; pwd='1'"})
    counts = ["path", "lines", "complexity", "errors", "warnings", "infos"]
    assert sorted(Q.file_metrics(df).select(counts).collect()) == sorted(
        Q.file_results(df).select(counts).collect()
    )


def test_rules_search_only_texts_that_hold_their_word(spark):
    """The test before a search lets every hit through and spares texts without the word."""
    hits = ["# todo", "/* İ */ // FİXME", "#HACK", "paſswd: 'x'", "tOKEN = \"k\"", "// fıxme"]
    plain = "# see http://a/b, 'plain' \"words\" / nothing"
    df = spark.createDataFrame([(t,) for t in [*hits, plain]], "text STRING").withColumn("low", folded(F.col("text")))
    rules = [r for r in R.RULES if r.needs_folded]
    assert len(rules) == 5
    for rule in rules:
        may, found = zip(
            *df.select(Q._may_hit(F.col("text"), F.col("low"), rule), F.col("text").rlike(rule.java)).collect(), strict=True
        )
        assert may == found, rule.issue_type
        assert not may[-1]


def test_folded_letters_are_those_of_a_case_blind_pattern(spark):
    chars = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343")
    text = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    odd = chars.select(text.alias("c")).filter(
        F.col("c").rlike("^(?iu)[a-z]$") & ~folded(F.col("c")).rlike("^[a-z]$")
    )
    assert odd.count() == 0


def test_reports_search_their_texts_once(spark, tmp_path):
    """Head and issues come from written results, not from two scans of the tables."""
    rows = {
        "documents": [(1, "x = 250\n", "en", "src0")],
        "pages": [(1, "http://h.example/a/b", "<p>299</p>")],
        "part": [(p, p % 5) for p in range(40)],
    }
    for name, values in rows.items():
        df = spark.createDataFrame(values, FIXTURE_SCHEMAS[name])
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    result = QUERIES["report_json_quality"](spark, str(tmp_path))
    assert result.count() > 0
    assert not [f for f in result.inputFiles() if str(tmp_path) in f]
