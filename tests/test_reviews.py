from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import kilobytes
from corpusgauge.functions.templates import TEMPLATES, Lines, fill, slots
from corpusgauge.operators import agents as A
from corpusgauge.operators import explain as E
from corpusgauge.operators import replies as RP
from corpusgauge.operators import reports as M
from corpusgauge.operators import reviews as RV
from corpusgauge.sources.sinks import report_json

DIFF = "diff --git a/a.py b/a.py\n@@ -1 +1 @@\n-x\n+y\n"
ITEM = {"file": "a.py", "line": 3, "severity": "ERROR", "category": "bug", "message": "m", "suggestion": "s"}


@pytest.fixture
def make_responses(spark):
    def build(rows):
        return spark.createDataFrame(rows, "diff_id BIGINT, agent STRING, response STRING, error STRING")

    return build


@pytest.fixture
def parse(make_responses):
    def run(response: str):
        return RP.parsed_replies(make_responses([(1, "security", response, None)])).collect()[0]

    return run


def test_reply_forms(parse):
    listed = parse(json.dumps([ITEM, {}]))
    assert [tuple(c) for c in listed.comments] == [
        ("a.py", 3, "error", "bug", "m", "s"),
        ("unknown", None, "info", "general", "", None),
    ]
    assert (listed.errors, listed.warnings, listed.infos) == (1, 0, 1)
    assert len(parse(json.dumps({"comments": [ITEM]})).comments) == 1
    assert parse(json.dumps({"issues": [ITEM]})).comments == []
    assert len(parse("Sure:\n```json\n[" + json.dumps(ITEM) + "]\n```\nbye").comments) == 1
    assert parse("```json\n5\n```").comments == []


@pytest.mark.parametrize(
    "text", ["no json here", "[nan]", "[-NaN]", '[{"a": 1}', "[1] tail", '{"a": 1}} x', "{'a': 1}", "[1]]", '{"a":1}, {"b":2}', "```json\n\n```"]
)
def test_text_fallback(parse, text):
    (comment,) = parse(f"  {text}\n").comments
    assert tuple(comment) == ("general", None, "info", "general", text, None)


def test_fuzzed_json_is_accepted_as_python_does(spark, texts):
    RP.accept_repeated_keys(spark)

    def accepts(text: str) -> bool:
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    rng = random.Random(5)
    tokens = ["{", "}", "[", "]", ",", ":", '"a"', '"comments"', "1", "-2.5e3", "null", "true", " ", "\n", "x", '"\\u00e9"', "01"]
    samples = ["".join(rng.choices(tokens, k=rng.randint(1, 7))) for _ in range(6000)]
    for _ in range(1500):
        valid = json.dumps(rng.choice([[ITEM], {"comments": [ITEM, {}]}, {"a": [1, {"b": None}]}, [], {}]))
        tail = "".join(rng.choices(tokens, k=rng.randint(0, 4)))
        cut = rng.randint(0, len(valid))
        samples += [valid + tail, valid[:cut], valid[:cut] + rng.choice(tokens) + valid[cut:]]
    df = texts(samples).select("idx", RP.strict_variant(F.col("text")).isNotNull().alias("ok"))
    got = [r.ok for r in df.orderBy("idx").collect()]
    wrong = [(s, g) for s, g in zip(samples, got, strict=True) if g != accepts(s)]
    assert wrong == []


def test_blank_reply_brings_nothing(parse):
    assert parse(" \n ").comments == []


def test_severities_and_explicit_nulls(parse):
    rows = [{"severity": s} for s in ("warning", "Error", "fatal")] + [
        {"file": None, "category": None, "message": None, "line": None, "suggestion": None},
        {"line": "x", "message": 7},
    ]
    got = parse(json.dumps(rows)).comments
    assert [c.severity for c in got] == ["warning", "error", "info", "info", "info"]
    assert (got[3].file, got[3].category, got[3].message) == (None, None, None)
    assert (got[4].line, got[4].message) == (None, "7")


@pytest.mark.parametrize(
    ("data", "failure"),
    [
        ([ITEM, {"severity": None}], "'NoneType' object has no attribute 'upper'"),
        ([{"severity": 3}], "'int' object has no attribute 'upper'"),
        (["text", {"severity": None}], "'str' object has no attribute 'get'"),
        ([[1]], "'list' object has no attribute 'get'"),
        ({"comments": None}, "'NoneType' object is not iterable"),
        ({"comments": 2.5}, "'float' object is not iterable"),
        ({"comments": True}, "'bool' object is not iterable"),
        ({"comments": "ab"}, "'str' object has no attribute 'get'"),
        ({"comments": {"a": 1}}, "'str' object has no attribute 'get'"),
        ({"comments": ""}, None),
        ({"comments": {}}, None),
        ({"comments": []}, None),
    ],
)
def test_items_that_break_a_review(parse, data, failure):
    row = parse(json.dumps(data))
    assert (row.failure, row.comments) == (failure, [])


def test_summaries(parse):
    assert parse('{"summary": "fine", "comments": []}').own_summary == "fine"
    assert parse('{"summary": null}').own_summary == ""
    assert parse("Text\n## Summary: all good\nreally\n## Next").own_summary == "all good\nreally"
    assert parse("summary\n  two\n\nrest").own_summary == "two"
    assert parse("In Summary: no").own_summary == ""
    assert parse("[]\nSummary: x").own_summary == "x"


@pytest.fixture
def reviewed(spark, make_responses):
    diffs = spark.createDataFrame(
        [("r", 1, DIFF), ("r", 2, "  "), ("r", 3, DIFF), ("r", 4, DIFF)],
        "repo_id STRING, diff_id BIGINT, raw STRING",
    )
    warning, info = dict(ITEM, severity="warning", line=0, suggestion=""), dict(ITEM, severity="info")
    responses = make_responses(
        [
            (1, "architect", json.dumps([warning, ITEM, warning]), None),
            (1, "security", json.dumps({"comments": [info], "summary": "own"}), None),
            (1, "performance", json.dumps([ITEM]), None),
            (3, "architect", None, "timeout"),
            (3, "security", '[{"severity": null}]', None),
            (4, "security", json.dumps([warning]), None),
            (9, "security", "stray", None),
        ]
    )
    return RV.reviewed_diffs(diffs, responses, A.select_agents()).cache()


def test_agent_reviews(reviewed):
    rows = {(r.diff_id, r.agent): r for r in RV.agent_reviews(reviewed).collect()}
    assert sorted(rows) == [(i, a) for i in (1, 3, 4) for a in ("architect", "security")]
    assert rows[1, "architect"].summary == "아키텍처 리뷰 결과: 심각한 이슈 1건, 주의 필요 2건"
    assert rows[1, "security"].summary == "own"
    assert rows[3, "architect"].summary == "리뷰 실패: timeout"
    assert rows[3, "security"].summary == (
        "리뷰 실행 중 오류 발생: 'NoneType' object has no attribute 'upper'"
    )
    assert rows[4, "architect"].summary == "리뷰 실패: no response"
    assert [rows[1, a].n_comments for a in ("architect", "security")] == [3, 1]


def test_totals_and_verdicts(reviewed):
    totals = {r.diff_id: r.total_comments for r in RV.comment_totals(reviewed).collect()}
    assert totals == {1: 4, 2: 0, 3: 0, 4: 1}
    verdicts = {r.diff_id: r for r in RV.review_verdict(reviewed).collect()}
    assert {i: r.verdict for i, r in verdicts.items()} == {1: "must_fix", 3: "mergeable", 4: "should_look"}
    assert verdicts[1].summary == (
        "총 4개의 코멘트가 발견되었습니다.\n- ERROR: 1개\n- WARNING: 2개\n- INFO: 1개\n\n"
        "병합 전 ERROR 이슈를 해결해야 합니다."
    )
    severities = {(r.diff_id, r.severity, r.n_comments) for r in RV.by_severity(reviewed).collect()}
    assert severities == {(1, "warning", 2), (1, "error", 1), (1, "info", 1), (4, "warning", 1)}


def test_review_results_and_reports(spark, reviewed):
    model = spark.createDataFrame(
        [(1, "model text", None), (3, "unused", None), (4, None, "down")],
        "diff_id BIGINT, summary STRING, error STRING",
    )
    results = RV.review_results(reviewed, model)
    rows = {r.diff_id: r for r in results.collect()}
    assert rows[1].summary == "model text"
    assert rows[2].summary == "리뷰할 변경사항이 없습니다." and rows[2].agent_reviews == []
    assert rows[3].summary == ""
    assert rows[4].summary.endswith("WARNING 이슈를 검토하는 것이 좋습니다.")
    order = results.filter("diff_id = 1").select(F.map_keys("by_severity")).collect()[0][0]
    assert order == ["warning", "error", "info"]
    assert tuple(rows[1].diff_summary) == (1, 1, 1)

    report = M.review_markdown(results.filter("diff_id = 4")).collect()[0].report
    assert report == (
        "# Code Review Results\n\n## Diff Statistics\n\n- **Files Changed**: 1\n- **Additions**: +1\n"
        "- **Deletions**: -1\n\n## Issues by Severity\n\n- **WARNING** [!]: 1\n\n"
        "### architect\n\n*0 comments*\n\n**Summary**: 리뷰 실패: no response\n\n"
        "### security\n\n*1 comments*\n\n- **[WARNING]** `a.py`\n  - m\n\n"
        "**Summary**: 보안 리뷰 결과: 보안 주의 1건\n\n"
        "## Overall Summary\n\n" + rows[4].summary + "\n"
    )
    data = json.loads(report_json(results.filter("diff_id = 1"), "diff_id").collect()[0].report)
    assert data["agent_reviews"][1]["comments"][0] == {
        "agent": "security", "file": "a.py", "line": 3, "severity": "info", "category": "bug",
        "message": "m", "suggestion": "s",
    }
    assert data["by_severity"] == {"warning": 2, "error": 1, "info": 1}


def test_reviews_text(reviewed):
    row = reviewed.filter("diff_id = 1").select(RV.reviews_text(F.col("reviews")).alias("t")).collect()[0]
    assert row.t.startswith("### architect\n\n- [WARNING] a.py\n  m\n\n- [ERROR] a.py:3\n  m\n  Suggestion: s\n\n")
    assert row.t.endswith("### security\n\n- [INFO] a.py:3\n  m\n  Suggestion: s\n\n**Summary**: own\n")


def test_shared_and_priority_issues(make_responses):
    same = json.dumps([dict(ITEM, severity="info"), ITEM])
    other = json.dumps([dict(ITEM, line=None), dict(ITEM, file="b.py")])
    responses = make_responses(
        [(1, "architect", same, None), (1, "security", same, None), (1, "junior", other, None)]
    )
    shared = RV.shared_issues(responses).collect()
    assert [(r.file, r.place, r.n_agents, r.n_comments) for r in shared] == [("a.py", "3", 2, 4)]
    ordered = RV.priority_issues(responses).collect()
    assert [r.severity for r in ordered] == ["error"] * 4 + ["info"] * 2


def test_agent_selection():
    assert [a.name for a in A.select_agents(["Junior", "SECURITY"])] == ["junior", "security"]
    with pytest.raises(ValueError, match="nobody"):
        A.select_agents(["security", "nobody"])


def test_prompts_keep_slots_found_in_values(spark):
    diffs = spark.createDataFrame([("r", 1, "{diff} {lines}")], "repo_id STRING, diff_id BIGINT, raw STRING")
    rows = RV.review_prompts(diffs, A.AGENTS).orderBy("agent_idx").collect()
    assert [r.agent for r in rows] == ["architect", "security", "performance", "junior"]
    for row, agent in zip(rows, A.AGENTS, strict=True):
        expected = TEMPLATES[agent.template].replace("{file_context}", RV.NO_CONTEXT)
        assert row.prompt == expected.replace("{diff}", "{diff} {lines}")


def test_template_errors():
    assert slots("summary") == ["files_changed", "additions", "deletions", "agent_reviews"]
    with pytest.raises(KeyError, match="content"):
        fill("file", {"file_path": F.lit("p"), "language": F.lit("l"), "lines": F.lit(1)})
    with pytest.raises(FileNotFoundError):
        fill("nothing", {})


# a bullet without text takes the next line with it, so "-c" keeps its mark
SECTIONS = [
    ("### Purpose\n does this \nand that\n\n### Key Elements\n- a\n* b\n  -  \n-c\n### Rest\n- no\n",
     "does this \nand that", ["a", "b", "-c"]),
    ("First paragraph\nmore\n\nSecond\n- x\n", "First paragraph\nmore", []),
    ("## key elements\n- one\n\n## PURPOSE\nlast", "last", ["one"]),
    ("", "", []),
]


def test_reply_sections(texts):
    df = texts([text for text, _, _ in SECTIONS])
    rows = df.orderBy("idx").select(
        RP.purpose_of(F.col("text")).alias("p"), RP.key_elements_of(F.col("text")).alias("k")
    ).collect()
    assert [(r.p, r.k) for r in rows] == [(p, k) for _, p, k in SECTIONS]


def test_explanations_capture_failures(make_files):
    files = make_files({"a.py": "x\ny\n", "bad.py": "fail", "big.py": "z"}, sizes={"big.py": 501 * 1024})

    def client():
        def complete(prompt: str) -> str:
            if "fail" in prompt:
                raise RuntimeError("model down")
            return "### Purpose\nSays hello.\n\n### Key Elements\n- x\n"

        return complete

    answered = E.complete_batch(E.file_prompts(E.explained_files(files)), client)
    rows = {r.path: r for r in answered.collect()}
    assert sorted(rows) == ["a.py", "bad.py"]
    assert (rows["bad.py"].response, rows["bad.py"].error) == (None, "model down")
    explained = E.explanations(answered).collect()
    assert [(r.path, r.language, r.lines, r.purpose, r.key_elements) for r in explained] == [
        ("a.py", "Python", 2, "Says hello.", ["x"])
    ]
    report = M.explanation_markdown(E.explanations(answered)).collect()[0].report
    assert report.startswith("# a.py\n\n> a.py\n\n- **Language**: Python\n- **Lines**: 2\n\n## Purpose\n\nSays hello.\n")
    assert [(r.path, r.reason) for r in E.rejected_files(files).collect()] == [
        ("big.py", "file size 501.0KB is over the limit of 500KB")
    ]


def test_names_given_twice_are_one_reviewer():
    assert [a.name for a in A.select_agents(["architect", "Architect", "junior"])] == ["architect", "junior"]


def test_one_of_several_replies_counts(spark):
    diffs = spark.createDataFrame([(1, "diff --git a/x b/x\n"), (2, "diff --git a/x b/x\n")], "diff_id BIGINT, raw STRING")
    rows = [
        (1, "architect", '[{"severity": "error"}]', None, 1),
        (1, "architect", '[{"severity": "info"}, {"severity": "warning"}]', None, 2),
        (1, "security", None, "timeout", 1),
        (1, "security", "fine", None, 1),
        (2, "architect", "one", None, None),
        (2, "architect", "[]", None, 1),
    ]
    replies = spark.createDataFrame(rows, "diff_id BIGINT, agent STRING, response STRING, error STRING, attempt INT")
    for source in (replies, replies.orderBy("response")):
        for fields in (RV.COUNT_FIELDS, RV.SUMMARY_FIELDS, RV.COMMENT_FIELDS):
            reviewed = RV.reviewed_diffs(diffs, source, A.select_agents(), fields)
            got = {(r.diff_id, r.agent): (r.errors, r.warnings, r.infos) for r in RV.agent_reviews(reviewed).collect()}
            assert got == {
                (1, "architect"): (0, 1, 1), (1, "security"): (0, 0, 1),
                (2, "architect"): (0, 0, 0), (2, "security"): (0, 0, 0),
            }
            severities = [tuple(r) for r in RV.by_severity(reviewed).collect()]
            assert sorted(severities) == [(1, "info", 2), (1, "warning", 1)]
            assert [s for _, s, _ in severities] == ["info", "warning"]


def test_counts_shuffle_no_comments(spark):
    from corpusgauge.plans.queries import QUERIES

    for name in ("comment_totals", "by_severity", "review_verdict", "agent_reviews"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        folds = [line for line in plan.split("\n") if "partial_max" in line]
        assert folds and not any("comments" in line or "summary" in line for line in folds), name
        assert "REPARTITION_BY_NUM" not in plan


def test_lists_fill_lines(spark):
    df = spark.createDataFrame([(["a", "b {lines}"],)], "names ARRAY<STRING>")
    values = dict.fromkeys(slots("summary"), F.lit("v")) | {"agent_reviews": Lines(F.col("names"))}
    assert "\na\nb {lines}\n" in df.select(fill("summary", values)).first()[0]


def test_lines_that_are_no_whole_numbers(parse):
    text = json.dumps([{"line": x} for x in (12, "12", 3.7, None, True, 0)])
    assert [c.line for c in parse(text).comments] == [12, None, None, None, None, 0]


def _python_json(text):
    try:
        return json.loads(text)
    except ValueError:
        return "no json"


JSON_PARTS = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', '"NaN"', '"\\\\"', '"x\\"y"', "NaN", "Infinity", "-Infinity", "-NaN",
              "1", "2.5", "true", "null", " ", '"', "nan"]


def _some_json(rng, depth=0):
    kind = rng.choice(["list", "dict", "leaf"]) if depth < 3 else "leaf"
    if kind == "list":
        return "[" + ",".join(_some_json(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    if kind == "dict":
        items = (f'"{rng.choice("abN")}": {_some_json(rng, depth + 1)}' for _ in range(rng.randrange(4)))
        return "{" + ", ".join(items) + "}"
    return rng.choice(JSON_PARTS[6:-2] if rng.random() < 0.9 else JSON_PARTS)


def _plain(value):
    """Marks for numbers that JSON has not, so that both sides can be compared."""
    if isinstance(value, float) and value != value:
        return RP.NAN_TEXT
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return RP.NAN_TEXT if value == float(RP.NAN_TEXT) else value


def test_json_is_read_as_python_reads_it(spark, texts):
    rng = random.Random(11)
    cases = [_some_json(rng) for _ in range(600)]
    cases += ["".join(rng.choices(JSON_PARTS, k=rng.randrange(1, 7))) for _ in range(400)]
    cases += ['{"a": 1, "a": {"b": NaN, "b": 2}, "a": [3]}', '["' + '\\n' * 50_000 + 'NaN", NaN]', "[1NaN]", "[-NaN]"]
    RP.accept_repeated_keys(spark)
    rows = texts(cases).select("text", F.to_json(RP.strict_variant(F.col("text"))).alias("got")).collect()
    for row in rows:
        wanted = _python_json(row.text)
        if wanted == "no json":
            assert row.got is None, row.text[:200]
        else:
            assert row.got is not None, row.text[:200]
            assert _plain(json.loads(row.got)) == _plain(wanted), row.text[:200]


def test_replies_with_repeated_keys_and_odd_numbers(spark):
    reply = '{"comments": [], "comments": [{"file": "a", "file": "b", "line": NaN, "message": -Infinity, "category": NaN}]}'
    broken = '[{"severity": NaN, "message": "m"}]'
    df = spark.createDataFrame([(1, "junior", reply, None), (2, "junior", broken, None)],
                               "diff_id BIGINT, agent STRING, response STRING, error STRING")
    good, bad = RP.parsed_replies(df).orderBy("diff_id").collect()
    assert [(c.file, c.line, c.message, c.category) for c in good.comments] == [("b", None, "-Infinity", "NaN")]
    assert bad.failure == "'float' object has no attribute 'upper'"


def test_sizes_round_as_python_rounds(spark):
    sizes = [0, 1, 51, 52, 1023, 1024, 1280, 1792, 64_000, 513_001, 10**9 + 256, 2**41 + 768]
    df = spark.createDataFrame([(s,) for s in sizes], "s BIGINT").select("s", kilobytes(F.col("s")).alias("t"))
    assert all(r.t == f"{r.s / 1024:.1f}" for r in df.collect())
