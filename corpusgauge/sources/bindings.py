"""Engine inputs derived from the fixture tables.

The fixture tables hold no source code or diffs, so each input is a projection of
one table.  The expressions are written in the SQL that Spark and DuckDB share, and
both engines build the inputs from this one place.  No binding joins or groups:
every input row comes from one table row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NL = "chr(10)"
_SQ = "chr(39)"


def _text(*pieces: str) -> str:
    """Concatenate plain text pieces; ``{expr}`` embeds an SQL expression.

    A newline in a piece becomes ``chr(10)``, a single quote ``chr(39)``.
    """
    out: list[str] = []
    for piece in pieces:
        for i, part in enumerate(_split_braces(piece)):
            if i % 2:
                out.append(f"CAST({part} AS STRING)")
                continue
            for j, line in enumerate(part.split("\n")):
                if j:
                    out.append(_NL)
                for k, bit in enumerate(line.split("'")):
                    if k:
                        out.append(_SQ)
                    if bit:
                        out.append(f"'{bit}'")
    return "(" + " || ".join(out or ["''"]) + ")"


def _split_braces(piece: str) -> list[str]:
    parts: list[str] = []
    rest = piece
    while "<<" in rest:
        plain, rest = rest.split("<<", 1)
        expr, rest = rest.split(">>", 1)
        parts += [plain, expr]
    return parts + [rest]


def _when(condition: str, text: str, otherwise: str = "''") -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE {otherwise} END"


def _cases(subject: str, branches: dict[int, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items())
    return f"CASE {subject} {whens} ELSE {otherwise} END"


def spread(rows: DataFrame, evenly: bool) -> DataFrame:
    """The same rows, dealt over tasks for what is computed from them.

    A scan has tasks by the bytes and row groups of its files.  A few megabytes of keys
    stand for gigabytes of text here, so without this one or two tasks would work on all
    of it.  ``evenly`` makes a task for every shuffle partition, for rows that bring much work
    each; else rows are dealt by their columns and AQE joins tasks down to the number of
    cores.  The filter holds for every row; as it depends on the task, no other filter and
    so none of the work moves below the shuffle.
    """
    spark = rows.sparkSession
    if evenly:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = rows.repartition(tasks)
    else:
        dealt = rows.repartition(*rows.columns)
    return dealt.filter(F.spark_partition_id() >= 0)


@dataclass(frozen=True)
class Binding:
    table: str
    columns: dict[str, str]
    where: str = ""
    #: Set where texts are made of a table's keys: whether to deal these evenly, see ``spread``.
    evenly: bool | None = None

    def sql(self, source: str | None = None) -> str:
        items = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {items} FROM {source or self.table}{where}"

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # a given schema spares the job that would read one from a footer
        reader = spark.read.schema(FIXTURE_SCHEMAS[self.table])
        source = reader.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.where:
            source = source.where(self.where)
        if self.evenly is not None:
            # only the columns asked for, since rows may be dealt by them
            names = [n for n in source.columns if re.search(rf"\b{n}\b", " ".join(self.columns.values()))]
            source = spread(source.select(*names), self.evenly)
        return source.select(*[F.expr(expr).alias(name) for name, expr in self.columns.items()])


FIXTURE_SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING",
    "events": "event_id BIGINT, user_id BIGINT, event_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "part": "p_partkey BIGINT, p_size INT",
    "supplier": "s_suppkey BIGINT",
}

# --- files ------------------------------------------------------------------

_DOC_NAME = _cases(
    "doc_id % 15",
    {14: _text("tool_<<doc_id>>/Makefile")},
    _when(
        "doc_id % 10 = 9",
        _text("misc/doc_<<doc_id>>.xyz"),
        "lang || '/doc_' || CAST(doc_id AS STRING) || "
        "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' "
        "WHEN 'es' THEN '.java' ELSE '.txt' END",
    ),
)
FILES_DOCS = Binding(
    "documents", {"repo_id": "source", "path": _DOC_NAME, "content": "text"}
)
FILES_PAGES = Binding(
    "pages",
    {
        "repo_id": "split_part(url, '/', 3)",
        "path": "split_part(url, '/', 4) || '/page_' || CAST(page_id AS STRING) || '.html'",
        "content": "html",
    },
)

_P = "p_partkey"
_PYTHON = _text(
    "import os\nfrom .core import base_<<p_partkey % 7>>\nimport pkg.mod<<p_partkey % 5>>\n",
    "from ..util.text import strip\nimport os\n\n",
)
_PYTHON_BODY = [
    _when(f"{_P} % 4 = 1", _text("# TODO: tidy up <<p_partkey>>\n")),
    _when(f"{_P} % 9 = 2", _text("x = 1  #fixme later\n// hack around\n")),
    _when(f"{_P} % 11 = 3", _text('password = "hunter<<p_partkey>>"\n')),
    _when(f"{_P} % 13 = 4", _text("API_KEY: 'k-<<p_partkey>>'\n")),
    _text("def f_<<p_partkey>>(a, b):\n"),
    "repeat('    x = 1' || chr(10), p_size * 2)",
    _text("    if a and b or not a:\n        return 250\n    elif b:\n        return 12\n\n\n"),
    _text("async def g_<<p_partkey>>(c):\n"),
    f"repeat('    y = c' || chr(10), CAST({_P} % 60 AS INT))",
    _when(f"{_P} % 6 = 1", _text("try:\n    pass\nexcept:\n    pass\n")),
    _when(f"{_P} % 6 = 2", _text("try:\n    pass\nexcept:\n\n    ...\nfinally:\n    pass\n")),
    _when(f"{_P} % 5 = 1", _text('if __name__ == "__main__":\n    print ("x", 4096)\n')),
    _when(f"{_P} % 8 = 3", "'# ' || repeat('long ', 30) || chr(10)"),
]
_SCRIPT = [
    _text("import x from \"./lib/a<<p_partkey % 3>>\";\nimport y from 'react';\n"),
    _text('const fs = require("fs");\nlet q = require("../q<<p_partkey % 4>>");\n'),
    _when(f"{_P} % 3 = 0", _text("/* TODO split */ //   todo again\n")),
    _text("function run_<<p_partkey>>(a) {\n"),
    "repeat('  a += 1;' || chr(10), p_size * 2)",
    _text("  console.log(a);\n  return a ?: 0;\n}\n"),
    _text("handler_<<p_partkey>> = async function (e) {\n  while (a&&b) { debugger }\n"),
    f"repeat('  e();' || chr(10), CAST({_P} % 70 AS INT))",
    _text("}\n  short: (x) => { try { x() } catch (e) { } }\n"),
    _when(f"{_P} % 4 = 0", _text("module.exports = run;\n")),
    _when(f"{_P} % 3 = 1", _text("export async function main() {}\n")),
    _when(f"{_P} % 5 = 0", _text("token = 'abc<<p_partkey>>'; pwd: \"p\"\n")),
]
_GO = [
    _text('package main\n\nimport "fmt"\nimport str "strings/<<p_partkey % 4>>"\n'),
    _text('import (\n\t"net/http"\n\t"./local"\n)\n\nfunc (s *Srv) Do_<<p_partkey>>(a int) {\n'),
    "repeat(chr(9) || 'a++' || chr(10), p_size * 2)",
    _text("}\n\nfunc main() {\n\tfor { switch { case 1: print(300) } }\n}\n"),
]
_JAVA = [
    _text("import java.util.List;\nimport com.acme<<p_partkey % 3>>.Core;\n\npublic class A {\n"),
    _text("  private static List<String> go_<<p_partkey>>(int a) {\n"),
    "repeat('    a++;' || chr(10), p_size * 2)",
    _text("  }\n  public static void main(String[] args) {\n    do { } while (1 || 2);\n  }\n}\n"),
]
_RUST = [
    _text("use std::io;\nextern crate serde<<p_partkey % 3>>;\nuse std::io;\n"),
    _text("fn main() { // FIXME 12345\n}\n"),
]
_C = [
    _text("#include <stdio.h>\n  #include \"lib/util<<p_partkey % 3>>.h\"\n"),
    _text("/* hack */ int main(void) { return 999; }\n"),
]
_RUBY = [_text("require 'json'\nrequire_relative './lib/<<p_partkey % 3>>'\nputs 1200 if x\n")]


def _joined(parts: list[str]) -> str:
    return "(" + " || ".join(f"({part})" for part in parts) + ")"


_CODE_TEXT = _cases(
    f"CASE WHEN {_P} % 10 = 5 THEN 4 ELSE {_P} % 10 END",
    {
        4: _joined(_SCRIPT),
        6: _joined(_GO),
        7: _joined(_JAVA),
        8: _joined(_RUST),
        9: _when(f"{_P} % 3 = 0", _joined(_RUBY), _joined(_C)),
    },
    _when(
        f"{_P} % 20 = 0",
        "''",
        _joined([_PYTHON, _when(f"{_P} % 10 <> 0", _joined(_PYTHON_BODY))]),
    ),
)
_CODE_FOLDER = _when(
    f"{_P} % 10 < 2",
    f"'lib/mod_' || CAST({_P} - {_P} % 10 AS STRING) || '/'",
    "CASE "
    f"WHEN {_P} % 17 = 0 THEN 'node_modules/left/' WHEN {_P} % 19 = 0 THEN '.cache/tmp/' "
    f"WHEN {_P} % 23 = 0 THEN 'src/rebuilding/' WHEN {_P} % 29 = 0 THEN 'src/build/' "
    f"WHEN {_P} % 31 = 0 THEN 'dist/' WHEN {_P} % 37 = 0 THEN 'Src/Core/.github/' "
    f"ELSE 'src/pkg' || CAST({_P} % 8 AS STRING) || '/' END",
)
_CODE_FILE = _cases(
    f"{_P} % 10",
    {
        0: "'__init__.py'",
        4: f"'View' || CAST({_P} AS STRING) || CASE WHEN {_P} % 4 = 0 THEN '.min.js' ELSE '.js' END",
        5: f"'w' || CAST({_P} AS STRING) || '.ts'",
        6: f"'d' || CAST({_P} AS STRING) || '/main.go'",
        7: f"'App' || CAST({_P} AS STRING) || '.JAVA'",
        8: f"'r' || CAST({_P} AS STRING) || '.rs'",
        9: f"'n' || CAST({_P} AS STRING) || CASE WHEN {_P} % 3 = 0 THEN '.rb' "
        f"WHEN {_P} % 3 = 1 THEN '.c' ELSE '.cpp' END",
    },
    "CASE "
    f"WHEN {_P} % 41 = 0 THEN 't' || CAST({_P} AS STRING) || '/Dockerfile' "
    f"WHEN {_P} % 43 = 0 THEN 't' || CAST({_P} AS STRING) || '/Gemfile' "
    f"WHEN {_P} % 47 = 0 THEN 't' || CAST({_P} AS STRING) || '/.bashrc' "
    f"WHEN {_P} % 53 = 0 THEN 'c' || CAST({_P} AS STRING) || '.pyc' "
    f"ELSE 'f' || CAST({_P} AS STRING) || '.py' END",
)
FILES_CODE = Binding(
    "part",
    {
        "repo_id": f"'code' || CAST(({_P} - {_P} % 10) % 120 AS STRING)",
        "path": f"{_CODE_FOLDER} || {_CODE_FILE}",
        # every 13th file has \r\n line ends
        "content": f"replace({_CODE_TEXT}, chr(10), "
        f"{_when(f'{_P} % 13 = 0', 'chr(13) || chr(10)', 'chr(10)')})",
    },
    evenly=True,
)
#: Path of a part file as a version of a file that the diffs touch: ``f<n>.py`` becomes
#: one of their paths, any other stays.  Several files may share a path.
_INDEX = r"CAST(nullif(regexp_extract(path, 'f([0-9]+)[.]py$', 1), '') AS BIGINT)"
CONTEXT_PATH = (
    f"CASE WHEN {_INDEX} IS NULL THEN path ELSE 'src/m' || CAST({_INDEX} % 7 AS STRING) || '/f' || "
    f"CAST({_INDEX} % 50 AS STRING) || '_' || CAST({_INDEX} % 4 + 1 AS STRING) || '.py' END"
)
FILE_BINDINGS = (FILES_DOCS, FILES_PAGES, FILES_CODE)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(repo_id, path, content, size_bytes)`` over documents, pages and part."""
    first, *others = [binding.read(spark, sf_dir) for binding in FILE_BINDINGS]
    for other in others:
        first = first.unionByName(other)
    return first.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


# --- commits ----------------------------------------------------------------

COMMITS = Binding(
    "orders",
    {
        "repo_id": "'src' || CAST(o_custkey % 24 AS STRING)",
        "hash": "md5(CAST(o_orderkey AS STRING))",
        "message": "'  ' || o_orderpriority || ' change ' || CAST(o_orderkey AS STRING) || "
        "CASE WHEN o_orderkey % 5 = 0 THEN ' with a much longer subject line that goes past "
        "the display width' ELSE '' END || chr(10)",
        "author": "'dev' || CAST(o_custkey % 97 AS STRING)",
        "date": "o_orderdate",
    },
)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commits(repo_id, hash, message, author, date)``."""
    return COMMITS.read(spark, sf_dir)


# --- diffs ------------------------------------------------------------------


def _diff_section(i: int) -> str:
    """The i-th section of an order's diff; its kind follows from the keys."""
    kind = f"(o_orderkey + o_custkey * {i} + {i}) % 9"
    path = f"src/m<<o_custkey % 7>>/f<<o_orderkey % 50>>_{i}.py"
    count = f"CAST((o_orderkey + {i}) % 6 AS INT)"
    edits = (
        f"repeat('+added line' || chr(10), {count}) || repeat('-old line' || chr(10), "
        f"CAST(o_custkey % 4 AS INT)) || ' context' || chr(10)"
    )
    head = f"diff --git a/{path} b/{path}\n"
    modified = _joined(
        [
            _text(head + f"index 1..2 100644\n--- a/{path}\n+++ b/{path}\n"),
            _text("@@ -<<o_orderkey % 90 + 1>>,4 +<<o_orderkey % 80 + 1>>,7 @@ def f():\n keep\n"),
            edits,
        ]
    )
    two_hunks = _joined(
        [
            _text(head + f"--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n"),
            edits,
            _text("@@ -<<o_custkey % 30 + 20>>,3 +22,5 @@ class B:\n  +not an edit at first\n"),
            _text("++++ plus trap\n---- minus trap\n-- kept as minus\n+\n-\n"),
        ]
    )
    added = _joined(
        [
            _text(head + f"new file mode 100644\n--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,3 @@\n"),
            edits,
        ]
    )
    deleted = _text(
        head + f"deleted file mode 100644\n--- a/{path}\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    )
    pure_rename = _text(
        f"diff --git a/old name/<<o_orderkey>>.py b/new name/<<o_orderkey>>.py\n"
        f"similarity index 100%\nrename from old name/<<o_orderkey>>.py\n"
        f"rename to new name/<<o_orderkey>>.py\n"
    )
    edited_rename = _joined(
        [
            _text(f"diff --git a/x b/y_{i} b/z_{i}\nsimilarity index 87%\nrename from x b/y_{i}\n"),
            _text(f"rename to z_{i}\n--- a/x b/y_{i}\n+++ b/z_{i}\n@@ -5,2 +5,2 @@\n"),
            edits,
        ]
    )
    binary = _text(
        f"diff --git a/img/{i}_<<o_orderkey % 40>>.png b/img/{i}_<<o_orderkey % 40>>.png\n"
        f"index 1..2\nBinary files a/img/{i}.png and b/img/{i}.png differ\n"
    )
    copied = _text(
        f"diff --git a/c_{i} b/d_{i}\nsimilarity index 90%\ncopy from c_{i}\ncopy to d_{i}\n"
    )
    return _cases(
        kind,
        {0: two_hunks, 1: added, 2: deleted, 3: pure_rename, 4: edited_rename, 5: binary, 6: copied},
        modified,
    )


DIFFS = Binding(
    "orders",
    {
        "repo_id": "'code' || CAST((o_custkey - o_custkey % 10) % 120 AS STRING)",
        "diff_id": "o_orderkey",
        "raw": _cases(
            "o_orderkey % 40",
            {7: "''", 23: "' ' || chr(10) || chr(9)"},
            _joined(
                [
                    _when("o_orderkey % 10 = 1", _text("commit <<o_orderkey>>\n\n")),
                    _diff_section(1),
                    _when("o_custkey % 4 >= 1", _diff_section(2)),
                    _when("o_custkey % 4 >= 2", _diff_section(3)),
                    _when("o_custkey % 4 >= 3", _diff_section(4)),
                    _when("o_orderkey % 97 = 5", _text("diff --git malformed\n+x\n")),
                ]
            ),
        ),
    },
    evenly=False,
)


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``diffs(repo_id, diff_id, raw)``; some blank, some with a preamble."""
    return DIFFS.read(spark, sf_dir)


# --- replies ----------------------------------------------------------------

_SEVERITY = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' "
    "WHEN 'click' THEN 'info' WHEN 'signup' THEN 'Warning' ELSE 'critical' END"
)
_REPLY_FILE = "src/m<<user_id % 7>>/f<<event_id % 3>>.py"
_FULL_ITEM = (
    f'{{"file": "{_REPLY_FILE}", "line": <<user_id % 5>>, "severity": "<<{_SEVERITY}>>", '
    '"category": "<<event_type>>", "message": "value <<event_id % 89>>", '
    '"suggestion": "check <<user_id>>"}'
)
_SHORT_ITEM = '{"severity": "error", "line": null, "message": "short", "file": "a.py"}'
_EMPTY_ITEM = "{}"
RESPONSES = Binding(
    "events",
    {
        # four consecutive events answer for the four reviewers of one diff
        "diff_id": "CAST((event_id - event_id % 4) / 4 AS BIGINT)",
        "agent": _cases(
            "event_id % 4", {0: "'architect'", 1: "'security'", 2: "'performance'"}, "'junior'"
        ),
        "response": _when(
            "event_id % 31 = 0",
            "NULL",
            _cases(
                "event_id % 13",
                {
                    0: _text(f"[{_FULL_ITEM}, {_SHORT_ITEM}]"),
                    1: _text(f'{{"comments": [{_FULL_ITEM}, {_EMPTY_ITEM}], "summary": "ok <<user_id>>"}}'),
                    2: _text('{"verdict": "fine", "n": 3}'),
                    3: _text(f"Here it is:\n```json\n[{_SHORT_ITEM}, {_FULL_ITEM}, {_FULL_ITEM}]\n```\n",
                             "## Summary:\n Fenced <<event_id % 7>>\n\nmore"),
                    4: _text("  Plain words about <<event_type>>.\nSummary: looks <<event_type>>\n## Next\n"),
                    5: _text(f"[{_FULL_ITEM}, {{"),
                    6: _text("  \n "),
                    7: _text('{"comments": [], "summary": ""}'),
                    8: _text(f'[{_FULL_ITEM}, {{"severity": null}}]'),
                    9: _text('["just text", 5]'),
                    10: _text('{"comments": null}'),
                    11: _text(f'{{"summary": "only <<user_id>>", "comments": [{_SHORT_ITEM}]}}'),
                },
                _text(f"[{_FULL_ITEM}] trailing words"),
            ),
        ),
        "error": _when("event_id % 31 = 0", _text("timeout after <<user_id>> s"), "NULL"),
    },
    evenly=False,
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responses(diff_id, agent, response, error)``, one per diff and reviewer."""
    return RESPONSES.read(spark, sf_dir)


REPLIES = Binding(
    "conversations",
    {
        "repo_id": "'conv' || CAST(conv_id % 6 AS STRING)",
        "path": "'c' || CAST(conv_id AS STRING) || '/t' || CAST(turn AS STRING) || '.md'",
        "response": _cases(
            "(conv_id + turn) % 4",
            {
                0: _joined(
                    [
                        _text("### Purpose\n  "),
                        "text",
                        _text("\n\n### Key Elements\n- alpha <<conv_id>>\n* beta\n-   \n"),
                        _text("  - gamma <<turn>>\nplain\n### Details\n- not this\n"),
                    ]
                ),
                1: _joined([_text("Intro\n\nkey elements\n- one\n-two\n\n## Purpose \nDoes <<turn>>\nof it\n## End"), "text"]),
                2: _joined(["text", _text("\n\nSecond paragraph\n- bullet")]),
            },
            "text",
        ),
    },
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_replies(repo_id, path, response)``."""
    return REPLIES.read(spark, sf_dir)


# --- settings ---------------------------------------------------------------

SETTINGS = Binding(
    "supplier",
    {
        # one row a repository; from the 22nd on of repositories without files
        "repo_id": "CASE WHEN s_suppkey < 10 THEN 'src' || CAST(s_suppkey * 2 AS STRING) "
        "WHEN s_suppkey < 22 THEN 'code' || CAST((s_suppkey - 10) * 10 AS STRING) "
        "ELSE 'supplier' || CAST(s_suppkey AS STRING) END",
        # a NULL section falls back to the base section as a whole
        "patterns": "CASE s_suppkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN '*.py' WHEN 2 THEN 'f?[13]*' END",
        "max_file_size_kb": "CASE s_suppkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 500 WHEN 2 THEN 2 END",
        # reviewers of a review section, by commas; NULL for none, '' for one that names nobody
        "reviewers": "CASE s_suppkey % 5 WHEN 0 THEN 'junior,Security' "
        "WHEN 1 THEN 'style,architect,ARCHITECT' WHEN 2 THEN '' END",
    },
)


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``settings(repo_id, analyze STRUCT<exclude_patterns, max_file_size_kb>,
    review STRUCT<default_agents>)``."""
    flat = SETTINGS.read(spark, sf_dir)
    section = F.struct(
        F.array("patterns").alias("exclude_patterns"),
        F.col("max_file_size_kb").cast("int").alias("max_file_size_kb"),
    )
    names = F.filter(F.split("reviewers", ","), lambda name: name != "")
    review = F.struct(names.alias("default_agents"))
    return flat.select(
        "repo_id",
        F.when(F.col("patterns").isNotNull(), section).alias("analyze"),
        F.when(F.col("reviewers").isNotNull(), review).alias("review"),
    )


# --- SQL side ---------------------------------------------------------------


def files_sql() -> str:
    union = " UNION ALL ".join(binding.sql() for binding in FILE_BINDINGS)
    return f"SELECT *, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes FROM ({union})"
