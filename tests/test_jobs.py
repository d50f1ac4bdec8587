from __future__ import annotations

import json
import os
import uuid

import pytest

from corpusgauge.operators import explain as E
from corpusgauge.plans import jobs, queries


@pytest.fixture
def client():
    def make_client():
        def complete(prompt: str) -> str:
            if "boom" in prompt:
                raise RuntimeError("model down")
            if prompt.startswith("# Security review"):
                return json.dumps([{"file": "a.py", "line": 1, "severity": "error", "message": "m"}])
            if prompt.startswith("# Design review"):
                return "[]"
            return f"  about {prompt.splitlines()[0][2:]}  "

        return complete

    return make_client


@pytest.fixture
def changes(spark):
    diff = "diff --git a/a.py b/a.py\n@@ -1 +1 @@\n-x\n+{}\n"
    return spark.createDataFrame(
        [("r", 1, diff.format("y")), ("r", 2, ""), ("r", 3, diff.format("boom"))],
        "repo_id STRING, diff_id BIGINT, raw STRING",
    )


def test_review_job(client, changes, make_files):
    results = jobs.review_diffs(changes, client, ["architect", "Security"], make_files({"a.py": "ctx"}))
    rows = {r.diff_id: r for r in results.collect()}
    assert rows[1].summary == "about Merge the reviews"
    assert (rows[1].total_comments, rows[1].by_severity) == (1, {"error": 1})
    assert rows[2].agent_reviews == []
    assert [r.summary for r in rows[3].agent_reviews] == ["리뷰 실패: model down"] * 2
    assert rows[3].summary == ""
    plain = jobs.review_diffs(changes, client, summarize=False)
    assert {r.summary for r in plain.filter("diff_id <> 2").collect()} == {""}
    report = jobs.render(results, "review").filter("diff_id = 1").collect()[0].report
    assert report.endswith("## Overall Summary\n\nabout Merge the reviews\n")


def test_repository_job(client, spark, make_files):
    commits = spark.sql(
        "SELECT 'r' repo_id, 'abcdef012' hash, 'm' message, 'me' author, TIMESTAMP_NTZ '2024-05-06 00:00:00' date"
    )
    files = make_files({"a.py": "x\n"}).union(make_files({"b.go": "y\nz\n"}, repo_id="q"))
    rows = jobs.summarize_repositories(files, commits, client)
    assert {r.repo_id: r.total_lines for r in rows.collect()} == {"r": 1, "q": 2}
    assert {r.summary for r in rows.collect()} == {"  about Describe this repository  "}
    text = jobs.render(rows, "repository").filter("repo_id = 'r'").collect()[0].report
    assert "- `abcdef0` m (*me, 2024-05-06*)\n" in text
    assert text.endswith("## Summary\n\n  about Describe this repository  \n")
    assert jobs.summarize_repositories(files, commits).filter("summary = ''").count() == 2
    data = json.loads(jobs.render(rows, "repository", "JSON").filter("repo_id = 'q'").collect()[0].report)
    assert data["recent_commits"] == [] and "error" not in data
    with pytest.raises(ValueError, match="yaml"):
        jobs.render(rows, "repository", "yaml")


def test_quality_and_structure_jobs(make_files):
    files = make_files({"p/__init__.py": "", "p/main.py": "from .x import y\n# TODO\n"})
    result = jobs.analyze_quality(files)
    assert [r.issue_type for r in result.issues.collect()] == ["todo_comment"]
    assert result.reports.collect()[0].infos == 1
    assert result.lines.count() == 4 + 4 + 1 + 1 + 4
    tree = jobs.analyze_structure(files)
    assert [r.path for r in tree.nodes.collect()] == ["", "p", "p/__init__.py", "p/main.py"]
    assert [r.target for r in tree.dependencies.collect()] == [".x"]
    assert [r.path for r in tree.entry_points.collect()] == ["p/main.py"]


def test_explain_job(client, make_files):
    files = make_files({"a.py": "x", "b.py": "boom", "c.py": "y"}, sizes={"c.py": 10**6})
    explained, failures = jobs.explain_files(files, client)
    assert [(r.path, r.purpose) for r in explained.collect()] == [("a.py", "about Explain this file")]
    assert {r.path: r.reason for r in failures.collect()} == {
        "b.py": "model down",
        "c.py": "file size 976.6KB is over the limit of 500KB",
    }


def test_diff_job(changes):
    parsed, stats = jobs.parse_diffs(changes)
    assert parsed.count() == 2
    assert {r.diff_id: r.files_changed for r in stats.collect()} == {1: 1, 2: 0, 3: 1}


def test_files_named_themselves_pass_every_filter(make_files):
    files = make_files({".hidden/build/x.unknown": "if a\n# TODO\n", "node_modules/main.py": "from .a import b\n"})
    assert jobs.analyze_quality(files).reports.collect()[0].files_analyzed == 0
    report = jobs.analyze_quality(files, filtered=False).reports.collect()[0]
    assert (report.files_analyzed, report.total_lines, report.infos) == (2, 3, 1)
    tree = jobs.analyze_structure(files, filtered=False)
    assert [r.path for r in tree.entry_points.collect()] == ["node_modules/main.py"]
    assert [r.target for r in tree.dependencies.collect()] == [".a"]
    assert tree.nodes.filter("node_type = 'file'").count() == 2


def test_own_settings_of_a_repository(spark, make_files):
    files = make_files({"src/a.py": "x = 1\n", "src/b[1].py": "x = 1\n"}, "one").unionByName(
        make_files({"src/a.py": "x = 1\n" * 400, "build/b.py": "x"}, "two")
    )
    settings = spark.createDataFrame(
        [("one", (["b[[]1].py"], 500)), ("two", (["none"], 1)), ("three", None)],
        "repo_id STRING, analyze STRUCT<exclude_patterns ARRAY<STRING>, max_file_size_kb INT>",
    )
    got = {r.repo_id: r for r in jobs.analyze_quality(files, settings=settings).reports.collect()}
    assert (got["one"].files_analyzed, got["one"].total_lines) == (1, 1)
    assert (got["two"].files_analyzed, got["two"].total_lines) == (2, 1)
    plain = {r.repo_id: r for r in jobs.analyze_quality(files).reports.collect()}
    assert (plain["one"].files_analyzed, plain["two"].files_analyzed, plain["two"].total_lines) == (2, 1, 400)


def test_quality_report_as_json(make_files):
    result = jobs.analyze_quality(make_files({"a.py": "pwd='x'\n# TODO é\n"}))
    rows = jobs.render(result, "quality", "json").orderBy("part", "issue_idx").collect()
    heads = [json.loads(r.report) for r in rows if r.part == "head"]
    issues = [json.loads(r.report) for r in rows if r.part == "issue"]
    assert len(heads) == 1 and set(heads[0]) == {"complexity_score", "summary"}
    assert [i["issue_type"] for i in issues] == ["todo_comment", "hardcoded_password"]
    assert set(issues[0]) == {"path", "line", "issue_type", "message", "severity"}


def test_repository_dates_are_iso_with_offset(spark, make_files):
    files = make_files({"a.py": "x"})
    for kind, wanted in (("TIMESTAMP", "2024-05-06T01:02:03+00:00"), ("TIMESTAMP_NTZ", "2024-05-06T01:02:03+00:00")):
        commits = spark.sql(f"SELECT 'r' AS repo_id, 'h' AS hash, 'm' AS message, 'a' AS author, CAST('2024-05-06 01:02:03' AS {kind}) AS date")
        row = jobs.render(jobs.summarize_repositories(files, commits), "repository", "json").first()
        data = json.loads(row.report)
        assert list(data) == ["path", "name", "total_files", "total_lines", "languages", "recent_commits", "summary"]
        assert data["recent_commits"][0]["date"] == wanted


REPLY = '```json\n{"comments": [{"file": "x", "severity": "error", "message": "m"}]}\n```'


def test_own_reviewers_of_a_repository(spark):
    raw = "diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b\n"
    changes = spark.createDataFrame(
        [("own", 1, raw), ("none", 2, raw), ("empty", 3, raw), ("own", 4, " "), (None, 5, raw)],
        "repo_id STRING, diff_id BIGINT, raw STRING",
    )
    settings = spark.createDataFrame(
        [("own", (["Junior", "style", None, "JUNIOR"],)), ("none", None), ("empty", ([],))],
        "repo_id STRING, review STRUCT<default_agents: ARRAY<STRING>>",
    )
    done = jobs.review_diffs(
        changes, lambda: lambda prompt: REPLY, ["performance"], summarize=False, settings=settings
    )
    got = {r.diff_id: [(v.agent_name, len(v.comments), v.summary) for v in r.agent_reviews] for r in done.collect()}
    assert [name for name, _, _ in got[3]] == ["architect", "security"]
    assert [name for name, _, _ in got[2]] == [name for name, _, _ in got[5]] == ["performance"]
    assert got[4] == []
    (first, n, _), (second, none, why) = got[1]
    assert (first, n, second, none) == ("junior", 1, "style", 0)
    assert "unknown reviewer: style; known: architect, junior, performance, security" in why


def test_a_killed_run_goes_on_where_its_log_ends(spark, tmp_path):
    calls, ready = tmp_path / "calls", tmp_path / "ready"
    calls.mkdir()

    def client():
        def complete(prompt: str) -> str:
            (calls / uuid.uuid4().hex).write_text(prompt)
            if prompt == "prompt 7" and not ready.exists():
                os._exit(1)  # the worker dies, which no handler of errors sees
            if prompt == "prompt 3":
                raise RuntimeError("refused")
            return prompt.upper()

        return complete

    rows = [(i, f"prompt {i % 30}") for i in range(60)]
    prompts = spark.createDataFrame([*rows, (60, None)], "id INT, prompt STRING").filter("prompt IS NOT NULL")
    log = str(tmp_path / "log")
    with pytest.raises(Exception, match="(?i)job aborted|crashed|exit"):
        E.complete_logged(prompts, client, log, slices=6).collect()
    logged = spark.read.parquet(log).filter("error IS NULL").count()
    before = len(list(calls.iterdir()))
    ready.touch()
    done = {r.id: (r.response, r.error) for r in E.complete_logged(prompts, client, log, slices=6).collect()}
    assert done == {i: (None, "refused") if p == "prompt 3" else (p.upper(), None) for i, p in rows}
    later = [p.read_text() for p in calls.iterdir()]
    assert logged > 0 and len(later) - before == 30 - logged
    # a third run asks only the failed call again
    E.complete_logged(prompts, client, log, slices=6).collect()
    assert len(list(calls.iterdir())) == len(later) + 1


def test_report_index_scans_the_files_once(spark, monkeypatch):
    placed = []
    whole = queries.packed_lines
    monkeypatch.setattr(queries, "packed_lines", lambda lines, *rest: placed.append(lines) or whole(lines, *rest))
    # an order is found in two passes; neither may go back to the tables
    assert queries.QUERIES["report_index"](spark, "/root/testdata/sf0.001").count() > 0
    assert placed and not any("/testdata/" in name for name in placed[0].inputFiles())
