"""Names, languages and the three exclude semantics against ``pathlib`` and ``fnmatch``."""

from __future__ import annotations

from fnmatch import fnmatch
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from corpusgauge.functions import languages as L
from corpusgauge.functions import paths as P
from corpusgauge.operators import files as FL

PATHS = [
    "a.py", "src/A.PY", ".bashrc", "x/.bashrc", "Makefile", "d/Dockerfile", "Gemfile", "noext",
    "trailing.", "two.tar.gz", "..a", "dir.py/file", "node_modules", "node_modules/x.js",
    "lib/node_modules/y/z.js", "src/build.py", "src/rebuilding.py", "build/x.c", "a/build", "my.pyc",
    "a/b/c.pyc", "c.pyc/inner.txt", ".git/config", ".github/w.yml", ".gitignore", "x/.hidden/y.py",
    "vendor.py", "a/vendor/b.go", "dist/app.min.js", "app.min.js", "app.min.css.map", "w[1].py", "w1.py",
    "q?.py", "qx.py", "venv", "a/venv/b", "x.R", "k.h", "k.tsx", "a.unknown", "new\nline.py",
]
GLOBS = ("*.py", "w[1].py", "q?.py", "[!a]*.c", "src/*", "build", "*/vendor/*", "a/*/c.pyc", "[", "x.[rR]")


def frame(texts):
    return texts(PATHS).withColumnRenamed("text", "path").withColumn("repo_id", F.lit("r"))


def values(df, column):
    return [row[0] for row in df.orderBy("idx").select(column).collect()]


def test_name_and_suffix(texts):
    df = frame(texts)
    assert values(df, P.file_name(F.col("path"))) == [p.rsplit("/", 1)[-1] for p in PATHS]

    def suffix(path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        return name[dot:].lower() if 0 < dot < len(name) - 1 else ""

    assert values(df, P.suffix(F.col("path"))) == [suffix(p) for p in PATHS]


def test_languages(texts):
    rows = {r["path"]: r for r in FL.detected_languages(frame(texts)).collect()}
    assert rows["src/A.PY"].code_language == "Python"
    assert (rows["Makefile"].code_language, rows["Makefile"].stats_language) == ("Unknown", "Makefile")
    assert rows["d/Dockerfile"].explain_language == "Dockerfile"
    assert (rows["Gemfile"].stats_language, rows["Gemfile"].explain_language) == ("Other", "Ruby")
    assert (rows[".bashrc"].stats_language, rows[".bashrc"].explain_language) == ("Other", "Shell")
    assert rows["x.R"].code_language == "R"
    assert rows["a.unknown"].stats_language == "Other"
    assert rows["a.unknown"].explain_language == "Unknown"
    assert len(L.LANGUAGES) == 78


def test_tracked_excludes(texts):
    for globs in (P.TRACKED_EXCLUDES, GLOBS, ()):
        expected = [any(fnmatch(p, g) for g in globs) for p in PATHS]
        assert values(frame(texts), P.tracked_excluded(F.col("path"), globs)) == expected


def test_quality_excludes(texts):
    for globs in (P.QUALITY_EXCLUDES, GLOBS):
        expected = [
            any(fnmatch(p.rsplit("/", 1)[-1], g) or g in p for g in globs) for p in PATHS
        ]
        assert values(frame(texts), P.quality_excluded(F.col("path"), globs)) == expected
        literal = F.array(*[F.lit(g) for g in globs])
        assert values(frame(texts), P.quality_excluded_by(F.col("path"), literal, P.name_regexes(literal))) == expected


def test_structure_excludes(texts):
    def entry_excluded(path: str, globs: tuple[str, ...]) -> bool:
        name, rooted = path.rsplit("/", 1)[-1], "/" + path
        return any(
            name == g or fnmatch(name, g) or fnmatch(rooted, g) or f"/{g}/" in rooted or rooted.endswith(f"/{g}")
            for g in globs
        )

    def excluded(path: str, globs: tuple[str, ...]) -> bool:
        entries = [path, *[str(p) for p in PurePosixPath(path).parents if str(p) != "."]]
        return any(entry_excluded(e, globs) for e in entries)

    for globs in (P.STRUCTURE_EXCLUDES, GLOBS):
        expected = [excluded(p, globs) for p in PATHS]
        assert values(frame(texts), P.structure_excluded(F.col("path"), globs)) == expected


def test_hidden(texts):
    expected = [any(part.startswith(".") for part in p.split("/")) for p in PATHS]
    assert values(frame(texts), P.hidden(F.col("path"))) == expected


def test_settings_replace_the_base_section_as_a_whole(spark):
    files = spark.createDataFrame(
        [("own", "docs/a.py", 3000), ("own", "b.py", 10), ("base", "docs/a.py", 3000), ("base", "x.pyc", 1)],
        "repo_id STRING, path STRING, size_bytes BIGINT",
    )
    settings = spark.createDataFrame(
        [("own", (["docs"], 1)), ("other", None)],
        "repo_id STRING, analyze STRUCT<exclude_patterns: ARRAY<STRING>, max_file_size_kb: INT>",
    )
    rows = FL.scoped_by_settings(FL.resolve_settings(files, settings, ["*.pyc"], 500)).collect()
    assert {(r.repo_id, r.path, r.max_file_size_kb, r.is_read) for r in rows} == {
        ("own", "b.py", 1, True),
        ("base", "docs/a.py", 500, True),
    }


def test_pattern_column_reads_globs_as_fnmatch(spark):
    patterns = ["a[?]py", "b[*]c", "x[]]y", "[!-]z", "[]", "q[", "*.p?", "[a-c]1", "[!a-c]1", "a.b+c", "[^x]", "[!]]k", "[&]m", "-"]
    names = ["a.py", "a?py", "b.c", "b*c", "x]y", "xy", "-z", "zz", "[]", "q[", "n.py", "b1", "d1", "a.b+c", "aXb+c", "^", "x", "]k", "ak", "&m", "-"]
    rows = [(p, n) for p in patterns for n in names]
    df = spark.createDataFrame(rows, "p STRING, n STRING")
    regexes = P.name_regexes(F.array("p"))
    got = df.select("p", "n", F.exists(regexes, lambda r: F.regexp_like("n", r)).alias("hit")).collect()
    assert [(r.p, r.n) for r in got if r.hit != fnmatch(r.n, r.p)] == []
