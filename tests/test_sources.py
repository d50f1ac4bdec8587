from __future__ import annotations

import json
import os

import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.sql import functions as F

from corpusgauge.operators import quality as Q
from corpusgauge.operators import repo as RE
from corpusgauge.operators import reports as M
from corpusgauge.plans import jobs
from corpusgauge.sources import bindings
from corpusgauge.sources import files as SF
from corpusgauge.sources.files import decoded, decoded_for_explain, read_files_table, scan_files
from corpusgauge.sources.sinks import write_json, write_markdown, write_packed_lines, write_report_lines


def test_tree_scan(spark, tmp_path):
    (tmp_path / "deep/er dir").mkdir(parents=True)
    (tmp_path / "a.py").write_bytes(b"if x:\r\n  y\r\n")
    (tmp_path / "deep/er dir/b c.py").write_bytes("é\xe9".encode("latin-1"))
    files = scan_files(spark, str(tmp_path), "mine")
    rows = {r.path: r for r in files.collect()}
    assert sorted(rows) == ["a.py", "deep/er dir/b c.py"]
    assert (rows["a.py"].repo_id, rows["a.py"].size_bytes) == ("mine", 12)
    assert {r.path: r.content for r in decoded(files).collect()}["deep/er dir/b c.py"] == ""
    assert {r.path: r.content for r in decoded_for_explain(files).collect()}["deep/er dir/b c.py"] == "éé"
    metrics = {r.path: r for r in Q.file_metrics(decoded(files)).collect()}
    assert (metrics["a.py"].lines, metrics["a.py"].complexity) == (2, 2)


def test_single_file_and_size_cap(spark, tmp_path):
    (tmp_path / "big.py").write_text("x = 300\n" * 1000)
    (tmp_path / "small.py").write_text("x")
    one = scan_files(spark, str(tmp_path / "small.py"), "r").collect()
    assert [(r.path, r.size_bytes) for r in one] == [("small.py", 1)]
    capped = scan_files(spark, f"file://{tmp_path}", "r", max_kb=1)
    assert {r.path: r.content is None for r in capped.collect()} == {"big.py": True, "small.py": False}
    report = Q.repo_metrics(Q.file_metrics(decoded(capped), max_kb=1)).collect()[0]
    assert (report.files_analyzed, report.total_lines, report.infos) == (2, 1, 0)


ODD = (
    "pkg/__init__.py", "pkg/__main__.py", "pkg/_priv.py", "pkg/a.py", "pkg/a b%20.py", "pkg/[x].py",
    "_build/b.py", ".github/c.py", "deep/.d/_e/f.py", ".hidden", "_x.py",
)


def test_scan_finds_what_a_walk_finds(spark, tmp_path):
    for name in ODD:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    (tmp_path / "empty").mkdir()
    walked = {
        os.path.relpath(os.path.join(folder, n), tmp_path) for folder, _, names in os.walk(tmp_path) for n in names
    }
    assert walked == set(ODD)
    for root in (str(tmp_path), f"{tmp_path}/"):
        found = scan_files(spark, root, "r").collect()
        assert {r.path: bytes(r.content).decode() for r in found} == {n: f"# {n}\n" for n in ODD}
    for name in ("_x.py", ".hidden", "pkg/[x].py"):
        one = scan_files(spark, str(tmp_path / name), "r").collect()
        assert [r.path for r in one] == [name.rpartition("/")[2]]


@pytest.mark.parametrize("entries", [20_000, 3])
def test_deep_and_broad_trees_are_listed_in_rounds(spark, tmp_path, monkeypatch, entries):
    monkeypatch.setattr(SF, "LIST_ENTRIES", entries)
    monkeypatch.setattr(SF, "BATCH_ENTRIES", 7)
    chain = "/".join(["d"] * (60 if entries > 3 else 12))
    names = [f"{chain}/deep.py", *[f"flat/f{i}.py" for i in range(50)]]
    names += [f"wide/{i}/{j}/x.py" for i in range(5) for j in range(4)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "wide/empty/er").mkdir(parents=True)
    found = scan_files(spark, str(tmp_path), "r").collect()
    assert {r.path: bytes(r.content).decode() for r in found} == {n: n for n in names} and len(found) == len(names)
    assert scan_files(spark, str(tmp_path / "wide/empty"), "r").collect() == []


def test_a_folder_of_very_many_files(spark, tmp_path):
    for i in range(20_000):
        (tmp_path / f"f{i}.txt").touch()
    listed = SF.listed_files(spark, LocalFileSystem(), str(tmp_path))
    assert listed.count() == 20_000 and listed.select("full").distinct().count() == 20_000


def test_jobs_over_a_scan(spark, tmp_path):
    for name in ODD:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    files = decoded(scan_files(spark, str(tmp_path), "r"))
    tree = jobs.analyze_structure(files)
    nodes = {r.path: r.node_type for r in tree.nodes.collect()}
    assert nodes["pkg"] == "module" and nodes["_build/b.py"] == "file" and ".github" not in nodes
    assert "pkg/__main__.py" in {r[1] for r in tree.entry_points.select("repo_id", "path").collect()}
    report = jobs.analyze_quality(files).reports.first()
    # hidden files are kept by the quality scan, but `.git` is part of `.github` and `build` of `_build`
    assert report.files_analyzed == len([n for n in ODD if n.endswith(".py") and ".git" not in n and "build" not in n])


def test_empty_folder(spark, tmp_path):
    assert scan_files(spark, str(tmp_path)).collect() == []


def test_files_table(spark, tmp_path, make_files):
    path = str(tmp_path / "t")
    make_files({"a.py": "x"}).withColumn("extra", F.lit(1)).write.parquet(path)
    table = read_files_table(spark, path)
    assert table.columns == ["repo_id", "path", "size_bytes", "content"]
    plan = RE.file_counts(table)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<repo_id:string>" in plan


def test_sinks(spark, tmp_path, make_files):
    files = make_files({"b.py": "# TODO\n" * 3, "a.py": "pwd='x'\n"})
    results = Q.file_results(files)
    lines = M.quality_markdown(results, Q.exploded(results))
    write_report_lines(lines, str(tmp_path / "md"))
    parts = sorted((tmp_path / "md" / "repo_id=r").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == (
        "# Quality Report\n\n**Complexity Score**: 2.0\n\n## Issues\n\n"
        "| File | Line | Type | Severity | Message |\n|------|------|------|----------|---------|\n"
        "| a.py | 1 | hardcoded_password | error | Potential hardcoded password detected |\n"
        "| b.py | 1 | todo_comment | info | TODO comment found |\n"
        "| b.py | 2 | todo_comment | info | TODO comment found |\n"
        "| b.py | 3 | todo_comment | info | TODO comment found |\n"
        "\n## Summary\n\nQuality Score: 93.5/100 (Excellent)\nFiles Analyzed: 2\n"
        "Issues Found: 4 total (1 errors, 0 warnings, 3 info)\n\n"
        "Critical issues require immediate attention, particularly potential security concerns.\n\n"
    )
    write_json(Q.quality_report(Q.repo_metrics(results)), str(tmp_path / "json"))
    (part,) = (tmp_path / "json").glob("part-*.json")
    assert json.loads(part.read_text())["grade"] == "Excellent"
    commits = spark.createDataFrame(
        [("none", "h", "m", "a", None)], "repo_id STRING, hash STRING, message STRING, author STRING, date TIMESTAMP"
    )
    write_markdown(M.repo_markdown(RE.repo_overview(files, commits)), str(tmp_path / "text"), "report")
    text = "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*")))
    assert text.startswith("# r\n\n> r\n\n## Statistics\n\n- **Total Files**: 2\n- **Total Lines**: 4\n")


def test_packed_reports_make_files_by_size_not_by_repository(spark, tmp_path):
    sizes = {f"r{i:03}": 1 + i % 3 for i in range(300)} | {"large": 950}
    rows = [(r, 2, f"f{i // 10}", i, f"{r} {i}") for r, n in sizes.items() for i in range(n)]
    rows.append(("r000", 4, "", 0, "two\nlines"))
    lines = spark.createDataFrame(rows, "repo_id STRING, section INT, path STRING, line_idx INT, line STRING").repartition(6)
    write_packed_lines(lines, str(tmp_path / "md"), per_file=100)
    files = {}
    for folder in (tmp_path / "md" / "files").glob("file=*"):
        (part,) = folder.glob("part-*")
        files[int(folder.name.removeprefix("file="))] = part.read_text().split("\n")[:-1]
    total = len(rows) + 1
    assert sorted(files) == list(range(-(-total // 100))) and sum(map(len, files.values())) == total
    index = spark.read.parquet(str(tmp_path / "md" / "index")).collect()
    for repo in sizes:
        places = sorted((r.file, r.first_line, r.n_lines) for r in index if r.repo_id == repo)
        got = [x for f, first, n in places for x in files[f][first - 1 : first - 1 + n]]
        wanted = [r[4] for r in sorted(rows) if r[0] == repo]
        assert got == "\n".join(wanted).split("\n")


def test_narrow_tables_are_dealt_over_tasks(spark, tmp_path):
    spark.range(1, 301).selectExpr("id AS p_partkey", "CAST(id % 9 AS INT) AS p_size").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet"
    )
    code = bindings.FILES_CODE.read(spark, str(tmp_path))
    # a filter on what is computed stays behind the shuffle, with the work
    found = code.filter(F.contains("content", F.lit("import"))).withColumn("task", F.spark_partition_id())
    counted = {r["task"]: r["count"] for r in found.groupBy("task").count().collect()}
    assert len(counted) >= 4 and max(counted.values()) < 2 * 300 / len(counted)
    everything = spark.read.parquet(f"{tmp_path}/part.parquet").selectExpr(
        *[f"{expr} AS {name}" for name, expr in bindings.FILES_CODE.columns.items()]
    )
    assert sorted(code.collect()) == sorted(everything.collect())
