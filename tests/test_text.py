"""Text helpers against Python's own string methods and ``re``."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from corpusgauge.functions import rules as R
from corpusgauge.functions import text as X
from corpusgauge.functions.numbers import grouped, one_decimal
from corpusgauge.functions.regex import java_regex

SAMPLES = [
    "",
    "one line",
    "one\n",
    "a\nb\n\nc",
    "\n\n",
    "crlf\r\nnext\r\n",
    "old\rmac\r",
    "mix\r\n\r\n\n\rend",
    "v\x0bt\x0cf\x1cs\x85n l p",
    "ends with sep ",
    "  \t padded 　 ",
    "café ifé if éif x²if and́ or",
    "﷐ if ﷑\n﷐\nif",
    "a&&b&&c a && b x||y ||z x|| and&&or",
    "x ? : y ?: z ?\n: w",
]


def universal(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def collect(df, column):
    return [row[0] for row in df.orderBy("idx").select(column).collect()]


def test_line_counts_follow_python(texts):
    df = texts(SAMPLES).withColumn("u", X.universal_newlines(F.col("text")))
    assert collect(df, X.split_lines(F.col("u"))) == [len(universal(s).splitlines()) for s in SAMPLES]
    by_iteration = [
        universal(s).count("\n") + (universal(s) != "" and universal(s)[-1] != "\n") for s in SAMPLES
    ]
    assert collect(df, X.iterated_lines(F.col("u"))) == by_iteration


def test_strip_and_blank_follow_python(texts):
    df = texts(SAMPLES + [" \x1c  "])
    expected = SAMPLES + [" \x1c  "]
    assert collect(df, X.strip(F.col("text"))) == [s.strip() for s in expected]
    assert collect(df, X.is_blank(F.col("text"))) == [s.strip() == "" for s in expected]


RULE_TEXTS = SAMPLES + [
    "# TODO: x\n//todo\n/* ToDo */ #TODOs #\n TODO",
    "# FIXME\n// hack\n/*\tHACK */ # hackish",
    "password = 'x' PWD:\"y\" passwd=''\npwd\n=\n'z' ſecret = 'u' token : \"t\"",
    "console.log(1) xconsole.log(2) print (3) blueprint(4)\ndebugger debuggers",
    "try:\n  x\nexcept :\n\n   pass\nexcept:\n ...\nexcept: pass\nexcept:\n  passed",
    "12 200 1999 0200 x300 4٣٣ 2000000 99 3.141592 250px",
    "short\n" + "x" * 120 + "\n" + "y" * 121 + "\n" + "z" * 300,
    "\U0001f600" * 121,
]


def test_rule_lines_follow_python(texts):
    df = texts(RULE_TEXTS)
    for rule in R.RULES:
        flags = (re.MULTILINE if rule.multiline else 0) | (re.IGNORECASE if rule.ignore_case else 0)
        expected = [
            [s.count("\n", 0, m.start()) + 1 for m in re.finditer(rule.pattern, s, flags)]
            for s in RULE_TEXTS
        ]
        assert collect(df, X.match_lines(F.col("text"), rule.java)) == expected, rule.issue_type
        counts = collect(df, X.count_matches(F.col("text"), rule.java))
        assert counts == [len(lines) for lines in expected], rule.issue_type


def test_complexity_patterns_follow_python(texts):
    df = texts(RULE_TEXTS)
    words = [w for ws in R.COMPLEXITY_WORDS.values() for w in ws]
    single = [rf"\b{w}\b" for w in words] + [R.TERNARY, r"\b(?:&&|\|\|)\b"]
    expected = [sum(len(re.findall(p, s)) for p in single) for s in RULE_TEXTS]
    assert collect(df, X.count_matches(F.col("text"), R.total_complexity_pattern())) == expected
    parts = [collect(df, X.count_matches(F.col("text"), p)) for p in R.complexity_patterns().values()]
    assert [sum(row) for row in zip(*parts, strict=True)] == expected


CODE_TEXTS = [
    "import os\n  import a.b.c as d\nfrom .x.y import z\nfrom  pkg import(q)\nimportlib\n",
    "import x from './lib'\nimport { a,\n b } from 'c'\nconst f = require(\"fs\")\n var g=require('../g')\n",
    'package m\nimport "fmt"\nimport s "str/x"\nimport (\n\t"net/http"\n  alias "q"\n)\nfunc main() {}\n',
    "import java.util.List;\nimport static a.B;\npublic static void main ( String[] a) {\n",
    "use std::io::Read;\nextern crate serde;\n fn main( ) {}\n",
    "#include <stdio.h>\n  #include\"u.h\"\n int main(void) {}\nvoid  main (){}\n",
    "require 'json'\nrequire_relative \"./x\"\n",
    "if __name__ == '__main__' :\n  pass\n",
    "export async function main(){}\nmodule.exports = 1\n// module.exports = 2\nfunction main (a) {}\n",
]


def test_import_and_entry_patterns_follow_python(texts):
    df = texts(CODE_TEXTS)
    for patterns in R.IMPORTS.values():
        for p in patterns:
            found = collect(df, F.regexp_extract_all("text", F.lit(java_regex(p, multiline=True)), F.lit(1)))
            assert found == [re.findall(p, s, re.MULTILINE) for s in CODE_TEXTS], p
    for patterns in R.ENTRY_PATTERNS.values():
        for p in patterns:
            flags = re.MULTILINE if p.startswith("^") else 0
            found = collect(df, F.col("text").rlike(java_regex(p, multiline=bool(flags))))
            assert found == [bool(re.search(p, s, flags)) for s in CODE_TEXTS], p


HEADER_TEXTS = CODE_TEXTS + [
    "\n\n  \n\tdef f (a):\n\n\n\n def g(\n): pass\n   \n\nasync  def h(",
    "class A {\n\n\n  int a(int b) {}\n public  static\nvoid b() {}\npublicstatic int c(\nint d(\n\n\n}",
    "public\n\n\n static List<int[]> e (\n\n\n\n\n f(\n new Foo(\n  return g(",
    "x\n\n\nfunction one(\n two : function\n\n\n a = (b,\n c) => d\n\nasync three = async () =>\n",
    "func a()\n\n\n\nfunc (r *R) b (x)\n  func\tc (",
]


def test_function_headers_follow_python(texts):
    """Against the plain wording: every start tried, blanks taken one by one."""
    df = texts(HEADER_TEXTS)
    java = r"^\s*(?:public|private|protected|static|\s)+[\w<>[\]]+\s+(\w+)\s*\("
    plain = R.FUNCTION_HEADERS | {"Java": java}
    for language, header in R.FUNCTION_HEADERS.items():
        pattern = java_regex(header, multiline=True)
        found = collect(df, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        expected = [[m.group(0) for m in re.finditer(plain[language], s, re.M)] for s in HEADER_TEXTS]
        assert found == expected, language


def test_reworded_patterns_match_the_same(texts):
    excepts = ["except:\n\n pass", "except :  \n\t\n  ...", "except:pass", "except: \n passed", "except:\x0b\n\x0cpass"]
    exports = ["module.exports = 1", "a\nx module.exports=", "// module.exports = 1", "/\n module.exports =", "a/b\nc"]
    loose = r"except\s*:\s*\n\s*pass\b|except\s*:\s*\n\s*\.\.\."
    rule = next(r for r in R.RULES if r.issue_type == "empty_except")
    assert collect(texts(excepts), F.col("text").rlike(rule.java)) == [
        bool(re.search(loose, s)) for s in excepts
    ]
    entry = java_regex(R.ENTRY_PATTERNS["JavaScript"][1], multiline=True)
    assert collect(texts(exports), F.col("text").rlike(entry)) == [
        bool(re.search(r"^[^/]*module\.exports\s*=", s, re.M)) for s in exports
    ]


FUZZ_TOKENS = (
    ["if", "and", "or", "else", "&&", "||", "?", ":", "\n", "\n", "\n\n", " ", " ", "  \n", "\t", "\x0b", "\x1c"]
    + ["#", "//", "/*", "TODO", "hack", "password", "token", "=", "'", '"', "250", "1999", "12", "\u0663"]
    + ["except", "pass", "...", "print", "debugger", "def ", "async ", "f(", "(", ")", " => ", "func ", "x"]
    + ["public ", "static", "int ", "List<a[]>", "import ", "from ", "const ", "require", "use ", "a.b", "./c"]
    + ["function ", "main", "{}", "module.exports", "/", "\u00e9", "\u00b2", "\u0301", "\u2028", "\u00a0", "\r", "\ufdd0"]
)


def test_fuzzed_texts_follow_python(texts):
    rng = random.Random(11)
    samples = ["".join(rng.choices(FUZZ_TOKENS, k=rng.randint(1, 60))) for _ in range(1500)]
    df = texts(samples).cache()
    for rule in R.RULES:
        flags = (re.MULTILINE if rule.multiline else 0) | (re.IGNORECASE if rule.ignore_case else 0)
        expected = [
            [s.count("\n", 0, m.start()) + 1 for m in re.finditer(rule.pattern, s, flags)] for s in samples
        ]
        assert collect(df, X.match_lines(F.col("text"), rule.java)) == expected, rule.issue_type
    words = [w for ws in R.COMPLEXITY_WORDS.values() for w in ws]
    single = [rf"\b{w}\b" for w in words] + [R.TERNARY, r"\b(?:&&|\|\|)\b"]
    expected = [sum(len(re.findall(p, s)) for p in single) for s in samples]
    assert collect(df, X.count_matches(F.col("text"), R.total_complexity_pattern())) == expected
    java = r"^\s*(?:public|private|protected|static|\s)+[\w<>[\]]+\s+(\w+)\s*\("
    plain = R.FUNCTION_HEADERS | {"Java": java}
    line_patterns = [(plain[k], p) for k, p in R.FUNCTION_HEADERS.items()]
    line_patterns += [(p, p) for ps in R.IMPORTS.values() for p in ps]
    for python, ours in line_patterns:
        found = collect(
            df, F.regexp_extract_all("text", F.lit(java_regex(ours, multiline=True)), F.lit(0))
        )
        assert found == [[m.group(0) for m in re.finditer(python, s, re.M)] for s in samples], ours
    universal_text = X.universal_newlines(F.col("text"))
    assert collect(df, X.split_lines(universal_text)) == [len(universal(s).splitlines()) for s in samples]
    assert collect(df, X.strip(F.col("text"))) == [s.strip() for s in samples]


def test_long_runs_of_blanks_stay_cheap(texts):
    blanks = ["\n" * 400_000 + "}", "except:" + "\n" * 400_000 + "x", "  \n" * 150_000, " " * 400_000 + "}"]
    df = texts(blanks)
    headers = [java_regex(p, multiline=True) for p in R.FUNCTION_HEADERS.values()]
    modules = [java_regex(p, multiline=True) for ps in R.IMPORTS.values() for p in ps]
    for pattern in [*headers, *modules, *[r.java for r in R.RULES if r.issue_type != "long_line"]]:
        assert sum(collect(df, X.count_matches(F.col("text"), pattern))) == 0


def test_decoding(spark):
    rows = [
        (0, "pläin".encode()),
        (1, "café olé".encode("latin-1")),
        (2, b"a\xffb\xe9\xe9c\xf0\x9f\x98d"),
        (3, "keeps �".encode() + b"\xff"),
        (4, b""),
    ]
    df = spark.createDataFrame(rows, "idx INT, content BINARY")
    assert collect(df, X.decode_dropping(F.col("content"))) == [
        b.decode("utf-8", errors="ignore") for _, b in rows
    ]

    def strict(b: bytes) -> str:
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return b.decode("latin-1")

    assert collect(df, X.decode_or_latin1(F.col("content"))) == [strict(b) for _, b in rows]


def test_numbers_follow_python_format(spark):
    values = [0.0, 0.05, 0.25, 0.35, 0.45, 12.25, 12.35, 33.333, 66.65, 87.25, 87.75, 99.95, 99.96, 100.0]
    values += [i / 7 for i in range(0, 700, 13)] + [i / 40 for i in range(0, 4000, 37)]
    df = spark.createDataFrame(list(enumerate(values)), "idx INT, v DOUBLE")
    assert collect(df, one_decimal(F.col("v"))) == [f"{v:.1f}" for v in values]
    whole = spark.createDataFrame([(0, 0), (1, 999), (2, 1234567)], "idx INT, v BIGINT")
    assert collect(whole, grouped(F.col("v"))) == ["0", "999", "1,234,567"]
