"""DuckDB counterparts of the registered queries.

Where it can be, the SQL takes another road than the Spark side (lines and windows
instead of markers and lambdas, GLOB instead of regexes, tokens instead of word
edges), so that a slip in one of them shows.
"""

from __future__ import annotations

from corpusgauge.functions import languages as L
from corpusgauge.functions import paths as P
from corpusgauge.functions import rules as R
from corpusgauge.functions.templates import TEMPLATES, _SLOT
from corpusgauge.operators import agents as A
from corpusgauge.operators import reviews as RV
from corpusgauge.sources import bindings as B

ORACLES: dict[str, str] = {}

NL = "chr(10)"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def text(value: str) -> str:
    """An SQL string expression; newlines by ``chr(10)``."""
    lines = ["'" + line.replace("'", "''") + "'" for line in value.split("\n")]
    return "(" + f" || {NL} || ".join(lines) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def _re2(pattern: str) -> str:
    """RE2 text of a rule pattern: Unicode word characters, escaped bracket in a class."""
    word = r"\p{L}\p{N}_"
    out = pattern.replace(r"[\w<>[\]]", rf"[{word}<>\[\]]").replace(r"[\w", f"[{word}")
    # RE2 has no possessive form and needs none
    return out.replace(r"\w", f"[{word}]").replace(r"\s++", r"\s")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple[str, ...]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


# --- shared parts ------------------------------------------------------------


def _any_glob(subject: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{subject} GLOB {lit(p)}" for p in patterns) + ")"


_STRUCTURE_TEST = " OR ".join(
    f"split_part(x, '/', -1) = {lit(p)} OR split_part(x, '/', -1) GLOB {lit(p)} "
    f"OR ('/' || x) GLOB {lit(p)} OR contains('/' || x, {lit(f'/{p}/')}) "
    f"OR ends_with('/' || x, {lit(f'/{p}')})"
    for p in P.STRUCTURE_EXCLUDES
)
_QUALITY_TEST = " OR ".join(
    f"name GLOB {lit(p)} OR contains(path, {lit(p)})" for p in P.QUALITY_EXCLUDES
)


def _bare(names: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in names.items())
    return f"CASE lower(name) {whens} END"


FILES = f"""
files AS MATERIALIZED ({B.files_sql()}),
langs(ext, language) AS ({_values(list(L.LANGUAGES.items()))}),
named AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS name,
    lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext,
    string_split(path, '/') AS parts,
    replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS txt
  FROM files),
f AS MATERIALIZED (
  SELECT named.*,
    coalesce(language, 'Unknown') AS code_language,
    coalesce(CASE WHEN named.ext = '' THEN {_bare(L.BARE_NAMES)} ELSE language END, 'Other')
      AS stats_language,
    coalesce(CASE WHEN named.ext = '' THEN {_bare(L.BARE_NAMES_EXPLAIN)} ELSE language END, 'Unknown')
      AS explain_language,
    NOT {_any_glob("path", P.TRACKED_EXCLUDES)} AS tracked,
    NOT ({_QUALITY_TEST}) AS quality_kept,
    len(list_filter(parts, lambda x: starts_with(x, '.'))) = 0 AS visible,
    len(list_filter(list_transform(range(1, len(parts) + 1),
        lambda i: array_to_string(parts[1:i], '/')), lambda x: {_STRUCTURE_TEST})) = 0
      AS structure_kept,
    len(txt) - len(replace(txt, chr(10), ''))
      + CASE WHEN txt <> '' AND right(txt, 1) <> chr(10) THEN 1 ELSE 0 END AS lines
  FROM named LEFT JOIN langs ON named.ext = langs.ext)
"""


def files_query(select: str, *more: str) -> str:
    return "WITH " + ",".join((FILES, *more)) + select


def simple(name: str, select: str, *more: str) -> None:
    ORACLES[name] = files_query(select, *more)


# --- files ---------------------------------------------------------------------

simple("name_suffix", "SELECT repo_id, path, name, ext AS suffix FROM f")
simple(
    "language_detect",
    "SELECT repo_id, path, code_language, stats_language, explain_language FROM f",
)
simple("tracked_files", "SELECT repo_id, path FROM f WHERE tracked")
simple("exclude_quality", "SELECT repo_id, path FROM f WHERE quality_kept")
simple("exclude_structure", "SELECT repo_id, path FROM f WHERE structure_kept")
simple("visible_files", "SELECT repo_id, path FROM f WHERE visible")
simple("code_files", "SELECT repo_id, path FROM f WHERE code_language <> 'Unknown'")
simple(
    "line_counts",
    r"""SELECT repo_id, path, lines,
      len(regexp_extract_all(txt, '[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))
      + CASE WHEN txt <> '' AND NOT regexp_matches(right(txt, 1),
          '[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') THEN 1 ELSE 0 END AS split_lines
      FROM f""",
)
simple(
    "rejected_files",
    """SELECT repo_id, path, 'file size ' || printf('%.1f', size_bytes / 1024.0) || 'KB is over the limit of 4KB'
      AS reason FROM files WHERE size_bytes > 4096""",
)
simple(
    "decode_text",
    # bytes of accented Latin-1 letters are not UTF-8 here, so exactly they are dropped
    r"""SELECT repo_id, path, length(c) AS content_chars, md5(c) AS content_md5
      FROM (SELECT repo_id, path, CASE WHEN length(path) % 3 = 0
        THEN regexp_replace(content, '[^\x00-\x7f]', '', 'g') ELSE content END AS c FROM files)""",
)
simple(
    "decode_explain",
    "SELECT repo_id, path, length(content) AS content_chars, md5(content) AS content_md5 FROM files",
)
simple(
    "settings_resolve",
    f"""SELECT f.repo_id, f.path,
        coalesce(s.max_file_size_kb, 500) AS max_file_size_kb,
        f.size_bytes <= coalesce(s.max_file_size_kb, 500) * 1024 AS is_read
      FROM f LEFT JOIN settings s ON f.repo_id = s.repo_id
      WHERE NOT CASE WHEN s.patterns IS NULL
        THEN {" OR ".join(f"name GLOB {lit(p)} OR contains(path, {lit(p)})" for p in P.TRACKED_EXCLUDES)}
        ELSE name GLOB s.patterns OR contains(path, s.patterns) END""",
    f"settings AS ({B.SETTINGS.sql()})",
)

# --- repository statistics --------------------------------------------------------

simple("count_files", "SELECT repo_id, count(*) AS files FROM files GROUP BY ALL")
simple(
    "language_files",
    "SELECT repo_id, stats_language AS language, count(*) AS files FROM f GROUP BY ALL",
)
STATS = """
per_language AS (
  SELECT repo_id, stats_language AS language, count(*) AS files,
    CAST(sum(lines) AS BIGINT) AS lines, min(path) AS first_path
  FROM f WHERE tracked GROUP BY ALL),
shares AS (
  SELECT *, CASE WHEN sum(lines) OVER (PARTITION BY repo_id) > 0
    THEN CAST(lines AS DOUBLE) / sum(lines) OVER (PARTITION BY repo_id) * 100 ELSE 0.0 END AS pct
  FROM per_language),
stats AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pct DESC, first_path) AS rank
  FROM shares)
"""
simple(
    "language_stats",
    "SELECT repo_id, language, files, lines, round(pct, 6) AS percentage FROM stats",
    STATS,
)
simple(
    "language_ranking",
    "SELECT repo_id, CAST(rank AS INTEGER) AS language_rank, language, round(pct, 6) AS percentage FROM stats",
    STATS,
)
TOTALS = """
totals AS (
  SELECT repo_id, count(*) FILTER (tracked) AS total_files,
    coalesce(CAST(sum(lines) FILTER (tracked) AS BIGINT), 0) AS total_lines
  FROM f GROUP BY repo_id)
"""
simple("repo_totals", "SELECT * FROM totals", TOTALS)
COMMITS = f"""
commits AS ({B.COMMITS.sql()}),
log AS (
  SELECT repo_id, hash, left(hash, 7) AS short_hash, {strip("message")} AS message, author,
    strftime(date, '%Y-%m-%d') AS date, date AS ts
  FROM commits),
recent AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, hash) AS INTEGER)
    AS commit_rank
  FROM log QUALIFY commit_rank <= 10)
"""
ORACLES["commit_log"] = f"WITH {COMMITS} SELECT * EXCLUDE (ts) FROM log"
ORACLES["recent_commits"] = f"WITH {COMMITS} SELECT * EXCLUDE (ts) FROM recent"
ORACLES["commit_display"] = f"""WITH {COMMITS} SELECT repo_id, commit_rank, short_hash,
  left(message, 60) AS message, author, date AS day FROM recent WHERE commit_rank <= 5"""
OVERVIEW = f"""
{STATS}, {TOTALS}, {COMMITS},
language_text AS (
  SELECT repo_id, string_agg(language || ': ' || printf('%.1f', pct) || '%', ', ' ORDER BY rank) AS lt,
    string_agg('| ' || language || ' | ' || files || ' | ' || format('{{:,}}', lines) || ' | '
      || printf('%.1f', pct) || '% |', {NL} ORDER BY rank) AS table_rows
  FROM stats GROUP BY repo_id),
commit_text AS (
  SELECT repo_id,
    string_agg('- [' || short_hash || '] ' || date || ': ' || message, {NL} ORDER BY commit_rank) AS ct,
    string_agg('- `' || short_hash || '` ' || message || ' (*' || author || ', ' || date || '*)',
      {NL} ORDER BY commit_rank) FILTER (commit_rank <= 5) AS listed
  FROM recent GROUP BY repo_id),
overview AS (
  SELECT totals.*, coalesce(lt, '') AS languages, table_rows,
    coalesce(ct, 'No commits found.') AS recent_commits, listed
  FROM totals LEFT JOIN language_text USING (repo_id) LEFT JOIN commit_text USING (repo_id))
"""
simple("fmt_languages", "SELECT repo_id, languages FROM overview", OVERVIEW)
simple("fmt_commits", "SELECT repo_id, recent_commits FROM overview", OVERVIEW)


def filled(name: str, values: dict[str, str]) -> str:
    parts = [
        f"CAST({values[piece]} AS VARCHAR)" if i % 2 else text(piece)
        for i, piece in enumerate(_SLOT.split(TEMPLATES[name]))
    ]
    return " || ".join(parts)


_REPO_SLOTS = {c: c for c in ("total_files", "total_lines", "languages", "recent_commits")}
simple("prompts_repo", f"SELECT repo_id, {filled('repo', _REPO_SLOTS)} AS prompt FROM overview", OVERVIEW)
simple(
    "md_repo",
    f"""SELECT repo_id, '# ' || repo_id || {text(chr(10) * 2)} || '> ' || repo_id
      || {text(chr(10) * 2 + "## Statistics" + chr(10) * 2)}
      || '- **Total Files**: ' || total_files || {NL}
      || '- **Total Lines**: ' || format('{{:,}}', total_lines) || {text(chr(10))}
      || coalesce({text(chr(10) + "## Languages" + chr(10) * 2 + "| Language | Files | Lines | Percentage |"
                        + chr(10) + "|----------|-------|-------|------------|" + chr(10))}
           || table_rows || {NL}, '')
      || coalesce({text(chr(10) + "## Recent Commits" + chr(10) * 2)} || listed || {NL}, '')
      AS report FROM overview""",
    OVERVIEW,
)

# --- quality -----------------------------------------------------------------------



def _quality_ctes(max_kb: int = 500) -> str:
    words = ",\n    ".join(
        f"len(list_filter(tokens, lambda w: w IN ({', '.join(lit(x) for x in ws)}))) AS {name}_words"
        for name, ws in R.COMPLEXITY_WORDS.items()
    )
    positions = []
    for rule in R.RULES:
        if rule.issue_type == "long_line":
            continue
        pattern = "[0-9]+" if rule.issue_type == "magic_number" else _re2(rule.pattern)
        flags = "(?i)" if rule.ignore_case else ""
        positions.append((rule.issue_type, flags + pattern))
    rule_rows = ", ".join(
        f"({lit(r.issue_type)}, {lit(r.message)}, {lit(r.severity)}, {i})" for i, r in enumerate(R.RULES)
    )
    found = "\n  UNION ALL ".join(
        f"""SELECT repo_id, path, {lit(name)} AS issue_type, i,
          ms[i] AS matched, (string_split_regex(q, {lit(p)}))[i] AS before
        FROM (SELECT repo_id, path, q, regexp_extract_all(q, {lit(p)}) AS ms FROM scoped
          WHERE regexp_matches(q, {lit(p)})), unnest(range(1, len(ms) + 1)) AS t(i)"""
        for name, p in positions
    )
    return rf"""
scoped AS MATERIALIZED (
  SELECT repo_id, path, code_language AS language,
    quality_kept AND code_language <> 'Unknown' AS in_scope,
    CASE WHEN in_scope AND size_bytes / 1024 <= {max_kb} THEN txt ELSE '' END AS q
  FROM f),
tokenized AS (
  SELECT *, regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+') AS tokens,
    len(list_filter(regexp_extract_all(q, '[^\p{{L}}\p{{N}}_]+'), lambda g: g IN ('&&', '||'))) AS marks,
    len(regexp_extract_all(q, '\?\s*:')) AS ternaries
  FROM scoped),
counted AS (
  SELECT *, {words} FROM tokenized),
file_complexity AS (
  SELECT repo_id, path, in_scope, q,
    conditional_words + ternaries AS conditional, loop_words AS "loop",
    exception_words AS exception, logical_words + marks AS logical,
    CASE WHEN q = '' THEN 0 ELSE 1 + conditional_words + ternaries + loop_words + exception_words
      + logical_words + marks END AS complexity
  FROM counted),
rules(issue_type, message, severity, rule_idx) AS (VALUES {rule_rows}),
found AS (
  {found}),
placed AS (
  SELECT repo_id, path, issue_type, matched,
    1 + sum(len(before) - len(replace(before, {NL}, ''))) OVER w
      + sum(len(matched) - len(replace(matched, {NL}, ''))) OVER w
      - (len(matched) - len(replace(matched, {NL}, ''))) AS line
  FROM found WINDOW w AS (PARTITION BY repo_id, path, issue_type ORDER BY i)),
hits AS (
  SELECT repo_id, path, issue_type, line FROM placed
  WHERE issue_type <> 'magic_number' OR (len(matched) >= 3 AND left(matched, 1) BETWEEN '2' AND '9')
  UNION ALL
  SELECT repo_id, path, 'long_line', i FROM (SELECT repo_id, path, string_split(q, {NL}) AS ls
    FROM scoped), unnest(range(1, len(ls) + 1)) AS t(i) WHERE len(ls[i]) > 120),
rule_issues AS (
  SELECT repo_id, path, CAST(line AS INTEGER) AS line, issue_type, message, severity, rule_idx
  FROM hits JOIN rules USING (issue_type))
"""


def _header_ctes() -> str:
    parts = []
    for language, pattern in R.FUNCTION_HEADERS.items():
        p = "(?m)" + _re2(pattern)
        name = (
            f"coalesce(nullif(regexp_extract(ms[i], {lit(p)}, 1), ''), regexp_extract(ms[i], {lit(p)}, 2))"
            if language in R.TWO_GROUP_HEADERS
            else f"regexp_extract(ms[i], {lit(p)}, 1)"
        )
        parts.append(
            f"""SELECT repo_id, path, i, ms[i] AS matched, {name} AS name,
              (string_split_regex(q, {lit(p)}))[i] AS before,
              len(q) - len(replace(q, {NL}, '')) + 1 AS last
            FROM (SELECT repo_id, path, q, regexp_extract_all(q, {lit(p)}) AS ms FROM scoped
              WHERE language = {lit(language)}), unnest(range(1, len(ms) + 1)) AS t(i)"""
        )
    return f"""
headers AS ({" UNION ALL ".join(parts)}),
header_lines AS (
  SELECT repo_id, path, i, name, last,
    1 + sum(len(before) - len(replace(before, {NL}, ''))) OVER w
      + sum(len(matched) - len(replace(matched, {NL}, ''))) OVER w
      - (len(matched) - len(replace(matched, {NL}, ''))) AS line
  FROM headers WINDOW w AS (PARTITION BY repo_id, path ORDER BY i)),
extents AS (
  SELECT repo_id, path, CAST(i - 1 AS INTEGER) AS function_idx, CAST(line AS INTEGER) AS line, name,
    CAST(coalesce(lead(line) OVER (PARTITION BY repo_id, path ORDER BY i), last) - line + 1 AS INTEGER)
      AS lines
  FROM header_lines),
long_ones AS (
  SELECT repo_id, path, line, 'long_function' AS issue_type,
    'Function ''' || name || ''' has ' || lines || ' lines (threshold: 50)' AS message,
    'warning' AS severity, 9 AS rule_idx
  FROM extents WHERE lines > 50 AND name <> ''),
issues AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY rule_idx, line, message) - 1
    AS INTEGER) AS issue_idx
  FROM (SELECT * FROM rule_issues UNION ALL SELECT * FROM long_ones)),
issue_counts AS (
  SELECT repo_id, count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos
  FROM issues GROUP BY repo_id),
complexities AS (
  SELECT repo_id, count(*) FILTER (in_scope) AS files_analyzed,
    CAST(sum(len(regexp_extract_all(q, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'))
      + CASE WHEN q <> '' AND right(q, 1) <> {NL} THEN 1 ELSE 0 END) AS BIGINT) AS total_lines,
    CAST(sum(complexity) AS BIGINT) AS complexity
  FROM file_complexity GROUP BY repo_id),
scores AS (
  SELECT *, CASE WHEN total_lines = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0
      - CASE WHEN complexity / total_lines > 0.5
          THEN least(20.0, (CAST(complexity AS DOUBLE) / total_lines - 0.5) * 40) ELSE 0.0 END
      - 5.0 * errors - 2.0 * warnings - 0.5 * infos)) END AS s
  FROM (SELECT repo_id, files_analyzed, total_lines, complexity, coalesce(errors, 0) AS errors,
      coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos
    FROM complexities LEFT JOIN issue_counts USING (repo_id))),
graded AS (
  SELECT *, CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 75 THEN 'Good' WHEN s >= 60 THEN 'Fair'
    WHEN s >= 40 THEN 'Needs Improvement' ELSE 'Poor' END AS grade
  FROM scores),
reports AS (
  SELECT repo_id, files_analyzed, total_lines, CAST(complexity AS DOUBLE) AS complexity_score,
    round(s, 6) AS score, grade, errors, warnings, infos,
    'Quality Score: ' || printf('%.1f', CAST(s AS DOUBLE)) || '/100 (' || grade || ')' || {NL}
      || 'Files Analyzed: ' || files_analyzed || {NL}
      || 'Issues Found: ' || (errors + warnings + infos) || ' total (' || errors || ' errors, '
      || warnings || ' warnings, ' || infos || ' info)'
      || CASE WHEN errors > 0 THEN {NL} || {NL} || 'Critical issues require immediate attention, '
        || 'particularly potential security concerns.' ELSE '' END
      || CASE WHEN warnings > 5 THEN {NL} || {NL} || 'Consider addressing the warnings to improve '
        || 'code maintainability.' ELSE '' END AS summary
  FROM graded)
"""


QUALITY = _quality_ctes() + "," + _header_ctes()
simple(
    "size_cap",
    "SELECT repo_id, files_analyzed, total_lines, complexity, errors, warnings, infos FROM scores",
    _quality_ctes(4) + "," + _header_ctes(),
)
simple("complexity", "SELECT repo_id, path, complexity FROM file_complexity WHERE in_scope", QUALITY)
simple(
    "complexity_by_category",
    """SELECT repo_id, CAST(sum(conditional) AS BIGINT) AS conditional, CAST(sum("loop") AS BIGINT) AS "loop",
      CAST(sum(exception) AS BIGINT) AS exception, CAST(sum(logical) AS BIGINT) AS logical
      FROM file_complexity WHERE in_scope GROUP BY repo_id""",
    QUALITY,
)
simple("repo_complexity", "SELECT repo_id, complexity, total_lines FROM scores", QUALITY)
simple("issue_severity", "SELECT repo_id, errors, warnings, infos FROM scores", QUALITY)
simple("quality_score", "SELECT repo_id, CAST(round(s, 6) AS DOUBLE) AS score FROM scores", QUALITY)
simple("quality_grade", "SELECT repo_id, grade FROM graded", QUALITY)
simple("quality_report", "SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM reports", QUALITY)
simple(
    "pattern_issues",
    """SELECT repo_id, path, line, issue_type, message, severity,
      CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY rule_idx, line) - 1 AS INTEGER) AS issue_idx
      FROM rule_issues""",
    QUALITY,
)
simple("function_extents", "SELECT * FROM extents", QUALITY)
simple("long_functions", "SELECT * EXCLUDE (rule_idx) FROM long_ones", QUALITY)
simple("all_issues", "SELECT * EXCLUDE (rule_idx) FROM issues", QUALITY)
_TABLE_HEAD = ["## Issues", "", "| File | Line | Type | Severity | Message |",
               "|------|------|------|----------|---------|"]
_MD_QUALITY = f"""SELECT repo_id, 0 AS section, '' AS path, CAST(i - 1 AS INTEGER) AS line_idx, ['# Quality Report', '',
      '**Complexity Score**: ' || CAST(complexity_score AS BIGINT) || '.0', ''][i] AS line
    FROM reports, range(1, 5) AS t(i)
    UNION ALL SELECT repo_id, 1, '', CAST(i - 1 AS INTEGER), [{", ".join(lit(x) for x in _TABLE_HEAD)}][i]
    FROM reports, range(1, 5) AS t(i) WHERE errors + warnings + infos > 0
    UNION ALL SELECT repo_id, 2, path, issue_idx, '| ' || path || ' | ' || line || ' | ' || issue_type
      || ' | ' || severity || ' | ' || message || ' |' FROM issues
    UNION ALL SELECT repo_id, 3, '', 0, '' FROM reports WHERE errors + warnings + infos > 0
    UNION ALL SELECT repo_id, 4, '', CAST(i - 1 AS INTEGER), ['## Summary', '', summary, ''][i]
    FROM reports, range(1, 5) AS t(i)"""
simple("md_quality", _MD_QUALITY, QUALITY)
simple(
    "report_index",
    f"""SELECT repo_id, (place - 1) // 1000 AS file, min((place - 1) % 1000 + 1) AS first_line, count(*) AS n_lines
      FROM (SELECT repo_id, row_number() OVER (ORDER BY repo_id, section, path, line_idx, piece) AS place
        FROM ({_MD_QUALITY}), range(0, len(string_split(line, chr(10)))) AS t(piece)) GROUP BY ALL""",
    QUALITY,
)

# --- structure ------------------------------------------------------------------------

TREE = """
listed AS (SELECT repo_id, path, name, parts, visible AND structure_kept AS in_tree FROM f),
module_dirs AS (
  SELECT DISTINCT repo_id, array_to_string(parts[1:len(parts) - 1], '/') AS path
  FROM listed WHERE name = '__init__.py'),
dirs AS (
  SELECT DISTINCT repo_id, array_to_string(parts[1:d], '/') AS path, d AS depth
  FROM listed, unnest(range(0, len(parts))) AS t(d) WHERE in_tree OR d = 0),
nodes AS (
  SELECT repo_id, path, depth, CASE WHEN m.path IS NULL THEN 'directory' ELSE 'module' END AS node_type
  FROM dirs LEFT JOIN module_dirs m USING (repo_id, path)
  UNION ALL
  SELECT repo_id, path, len(parts), 'file' FROM listed WHERE in_tree)
"""
simple(
    "tree_nodes",
    """SELECT repo_id, path,
      CASE WHEN depth > 0 THEN array_to_string(string_split(path, '/')[1:depth - 1], '/') END AS parent,
      CASE WHEN depth = 0 THEN repo_id ELSE split_part(path, '/', -1) END AS name,
      node_type, CAST(depth AS INTEGER) AS depth FROM nodes""",
    TREE,
)
simple("modules", "SELECT repo_id, path FROM nodes WHERE node_type = 'module'", TREE)
_TREE_ORDER = """SELECT repo_id, path, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN '' ELSE
      array_to_string(list_append(
        list_transform(string_split(path, '/')[1:depth - 1], lambda x: '0' || lower(x)),
        CASE node_type WHEN 'file' THEN '1' ELSE '0' END || lower(split_part(path, '/', -1))), chr(1))
      END AS sort_key FROM nodes"""
simple("tree_order", _TREE_ORDER, TREE)
simple(
    "tree_positions",
    f"""SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY sort_key, path) AS position
      FROM ({_TREE_ORDER})""",
    TREE,
)


def _per_language(table: dict[str, tuple[str, ...]], build: str, otherwise: str) -> str:
    whens = " ".join(
        f"WHEN {lit(language)} THEN "
        + ("(" + {"all": " || ", "any": " OR "}[build].join(
            f"regexp_extract_all(txt, {lit('(?m)' + _re2(p))}, 1)" if build == "all"
            else f"regexp_matches(txt, {lit(('(?m)' if p.startswith('^') else '') + _re2(p))})"
            for p in patterns
        ) + ")")
        for language, patterns in table.items()
    )
    return f"CASE code_language {whens} ELSE {otherwise} END"


IMPORTS = f"""
imported AS (
  SELECT repo_id, path, code_language AS language,
    unnest(list_distinct({_per_language(R.IMPORTS, "all", "[]")})) AS module
  FROM f WHERE visible AND structure_kept)
"""
simple("imports", "SELECT * FROM imported", IMPORTS)
simple(
    "dependencies",
    """SELECT repo_id, path AS source, module AS target, 'import' AS dependency_type FROM imported
      WHERE left(module, 1) = '.' OR position('/' IN module) > 0""",
    IMPORTS,
)
simple(
    "entry_points",
    f"""SELECT repo_id, path, code_language AS language FROM f WHERE visible AND structure_kept AND
      (name IN ({", ".join(lit(n) for n in R.ENTRY_NAMES)})
        OR {_per_language(R.ENTRY_PATTERNS, "any", "false")})""",
)

# --- diffs ---------------------------------------------------------------------------------

DIFFS = f"""
diffs AS MATERIALIZED ({B.DIFFS.sql()}),
sections AS (
  SELECT diff_id, CAST(i - 2 AS INTEGER) AS file_idx, 'diff --git ' || pieces[i] AS s
  FROM (SELECT diff_id, string_split({NL} || raw, {NL} || 'diff --git ') AS pieces FROM diffs),
    unnest(range(2, len(pieces) + 1)) AS t(i)),
facts AS MATERIALIZED (
  SELECT *, CASE WHEN regexp_matches(s, '(?m)^new file mode') THEN 'added'
      WHEN regexp_matches(s, '(?m)^deleted file mode') THEN 'deleted'
      WHEN regexp_matches(s, '(?m)^similarity index [0-9]+%$') OR regexp_matches(s, '(?m)^rename from ')
        THEN 'renamed' ELSE 'modified' END AS change_type,
    regexp_matches(s, '(?m)^Binary files .* differ$') AS is_binary,
    regexp_matches(s, '(?m)^diff --git a/.* b/.*$') AS has_header,
    regexp_extract(s, '(?m)^diff --git a/(.*) b/(.*)$', 2) AS header_path,
    regexp_matches(s, '(?m)^rename from ') AND regexp_matches(s, '(?m)^rename to ') AS both_names,
    regexp_extract(s, '(?m)^rename from (.*)$', 1) AS from_path,
    regexp_extract(s, '(?m)^rename to (.*)$', 1) AS to_path
  FROM sections),
file_rows AS MATERIALIZED (
  SELECT diff_id, file_idx, change_type, is_binary,
    CASE WHEN NOT has_header THEN NULL WHEN change_type = 'renamed' AND both_names THEN to_path
      ELSE header_path END AS path,
    CASE WHEN change_type = 'renamed' AND both_names THEN from_path END AS old_path,
    CASE WHEN NOT has_header THEN 'Invalid diff format: no file header found' END AS parse_error
  FROM facts),
diff_lines AS (
  SELECT diff_id, file_idx, n, ls[n] AS l,
    regexp_matches(ls[n], '^@@ -[0-9]+(,[0-9]+)? \\+[0-9]+(,[0-9]+)? @@') AS is_head
  FROM (SELECT diff_id, file_idx, string_split(s, {NL}) AS ls FROM facts WHERE NOT is_binary),
    unnest(range(1, len(ls) + 1)) AS t(n)),
numbered AS (
  SELECT *, sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY diff_id, file_idx ORDER BY n) AS h
  FROM diff_lines),
hunk_rows AS MATERIALIZED (
  SELECT diff_id, file_idx, CAST(h - 1 AS INTEGER) AS hunk_idx, any_value(l) FILTER (is_head) AS head,
    coalesce({strip(f"string_agg(l, {NL} ORDER BY n) FILTER (NOT is_head)")}, '') AS content
  FROM numbered WHERE h > 0 GROUP BY diff_id, file_idx, h),
hunks AS (
  SELECT *, CAST(regexp_extract(head, '-([0-9]+)', 1) AS INTEGER) AS old_start,
    CAST(coalesce(nullif(regexp_extract(head, '^@@ -[0-9]+,([0-9]+)', 1), ''), '1') AS INTEGER) AS old_count,
    CAST(regexp_extract(head, '\\+([0-9]+)', 1) AS INTEGER) AS new_start,
    CAST(coalesce(nullif(regexp_extract(head, '\\+[0-9]+,([0-9]+) @@', 1), ''), '1') AS INTEGER) AS new_count
  FROM hunk_rows),
changes AS (
  SELECT diff_id, file_idx,
    CAST(sum(len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))) AS INTEGER) AS additions,
    CAST(sum(len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))) AS INTEGER) AS deletions
  FROM (SELECT diff_id, file_idx, string_split(content, {NL}) AS ls FROM hunk_rows) GROUP BY ALL),
file_changes AS (
  SELECT diff_id, file_idx, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions
  FROM file_rows LEFT JOIN changes USING (diff_id, file_idx)),
diff_stats AS (
  SELECT diff_id, count(file_idx) AS files_changed,
    coalesce(CAST(sum(additions) AS BIGINT), 0) AS total_additions,
    coalesce(CAST(sum(deletions) AS BIGINT), 0) AS total_deletions
  FROM diffs LEFT JOIN file_changes USING (diff_id) GROUP BY diff_id)
"""


def diff_query(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {DIFFS} {select}"


diff_query("diff_files", "SELECT diff_id, file_idx, path, old_path, parse_error FROM file_rows")
diff_query("change_types", "SELECT diff_id, file_idx, change_type, is_binary FROM file_rows")
diff_query("file_changes", "SELECT * FROM file_changes")
diff_query(
    "hunks",
    """SELECT diff_id, file_idx, path, hunk_idx, old_start, old_count, new_start, new_count, content
      FROM hunks JOIN file_rows USING (diff_id, file_idx)""",
)
diff_query("diff_stats", "SELECT * FROM diff_stats")
diff_query(
    "fmt_diff",
    f"""SELECT diff_id, coalesce(string_agg(block, {NL} ORDER BY file_idx), '') AS diff_text FROM diffs
      LEFT JOIN (
        SELECT diff_id, file_idx, concat_ws({NL}, '--- a/' || path, '+++ b/' || path,
          string_agg('@@ -' || old_start || ',' || old_count || ' +' || new_start || ',' || new_count
            || ' @@' || {NL} || content, {NL} ORDER BY hunk_idx)) AS block
        FROM file_rows LEFT JOIN hunks USING (diff_id, file_idx) WHERE parse_error IS NULL
        GROUP BY diff_id, file_idx, path)
      USING (diff_id) GROUP BY diff_id""",
)

# --- reviews -------------------------------------------------------------------------------

_NAMES = ("architect", "security", "performance", "junior")
ORACLES["review_tasks"] = f"""WITH diffs AS ({B.DIFFS.sql()})
  SELECT diff_id, CAST(i - 1 AS INTEGER) AS agent_idx, ['security', 'junior', 'architect'][i] AS agent
  FROM diffs, range(1, 4) AS t(i) WHERE {strip("raw")} <> ''"""

ORACLES["settings_tasks"] = f"""WITH diffs AS ({B.DIFFS.sql()}), settings AS ({B.SETTINGS.sql()}),
  named AS (
    SELECT repo_id, string_split(reviewers, ',')[i] AS name, i
    FROM settings, range(1, 4) AS t(i) WHERE i <= len(string_split(reviewers, ','))),
  own AS (
    SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY min(i)) - 1 AS INTEGER) AS agent_idx,
      lower(name) AS agent FROM named WHERE name <> '' GROUP BY repo_id, lower(name)),
  listed AS (
    SELECT * FROM own
    UNION ALL SELECT repo_id, 0, 'architect' FROM settings WHERE reviewers = ''
    UNION ALL SELECT repo_id, 1, 'security' FROM settings WHERE reviewers = ''
    UNION ALL SELECT repo_id, 0, 'performance' FROM diffs WHERE repo_id NOT IN (SELECT repo_id FROM settings
      WHERE reviewers IS NOT NULL) GROUP BY repo_id
    UNION ALL SELECT repo_id, 1, 'junior' FROM diffs WHERE repo_id NOT IN (SELECT repo_id FROM settings
      WHERE reviewers IS NOT NULL) GROUP BY repo_id)
  SELECT diff_id, agent_idx, agent, CASE WHEN agent NOT IN ('architect', 'security', 'performance', 'junior')
      THEN 'unknown reviewer: ' || agent || '; known: architect, junior, performance, security' END AS error
  FROM diffs JOIN listed USING (repo_id) WHERE {strip("raw")} <> ''"""

_FENCE = "```json"
_JSON_TYPE = (
    "CASE json_type({v}) WHEN 'NULL' THEN 'NoneType' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' "
    "WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' "
    "ELSE 'float' END"
)


def _type(value: str) -> str:
    return _JSON_TYPE.format(v=value)


def _field(name: str, default: str) -> str:
    return f"CASE WHEN json_type(item, '$.{name}') IS NULL THEN {lit(default)} ELSE item->>'$.{name}' END"


REPLIES = f"""
responses AS ({B.RESPONSES.sql()}),
located AS (
  SELECT *, CASE WHEN regexp_matches(response, '{_FENCE}\\s*[\\s\\S]*?\\s*```')
      THEN {strip(f"regexp_extract(response, '{_FENCE}\\s*([\\s\\S]*?)\\s*```', 1)")}
    WHEN left({strip("response")}, 1) IN ('[', '{{') THEN {strip("response")} END AS json
  FROM responses),
typed AS (
  SELECT *, CASE WHEN json IS NOT NULL AND json_valid(json) THEN CAST(json AS JSON) END AS data
  FROM located),
shaped AS MATERIALIZED (
  SELECT *, CASE WHEN data IS NULL THEN 'text' ELSE {_type("data")} END AS shape,
    CASE WHEN json_type(data) = 'ARRAY' THEN data
      WHEN json_type(data, '$.comments') = 'ARRAY' THEN data->'$.comments' END AS listed
  FROM typed),
items AS (
  SELECT diff_id, agent, i, json_extract(listed, '$[' || (i - 1) || ']') AS item
  FROM shaped, unnest(range(1, CAST(json_array_length(listed) AS BIGINT) + 1)) AS t(i)
  WHERE listed IS NOT NULL),
bad_items AS (
  SELECT diff_id, agent, arg_min(CASE WHEN json_type(item) <> 'OBJECT'
      THEN '''' || {_type("item")} || ''' object has no attribute ''get'''
      ELSE '''' || {_type("item->'$.severity'")} || ''' object has no attribute ''upper''' END, i) AS why
  FROM items WHERE json_type(item) <> 'OBJECT' OR json_type(item, '$.severity') <> 'VARCHAR'
  GROUP BY ALL),
failures AS (
  SELECT diff_id, agent, why FROM bad_items
  UNION ALL
  SELECT diff_id, agent, '''' || {_type("data->'$.comments'")} || ''' object is not iterable'
  FROM shaped WHERE shape = 'dict' AND json_type(data, '$.comments') = 'NULL'),
comments AS MATERIALIZED (
  SELECT diff_id, agent, CAST(i - 1 AS INTEGER) AS comment_idx, {_field("file", "unknown")} AS file,
    TRY_CAST(item->>'$.line' AS INTEGER) AS line,
    CASE WHEN lower(item->>'$.severity') IN ('error', 'warning') THEN lower(item->>'$.severity')
      ELSE 'info' END AS severity,
    {_field("category", "general")} AS category, {_field("message", "")} AS message,
    item->>'$.suggestion' AS suggestion
  FROM items ANTI JOIN failures USING (diff_id, agent)
  UNION ALL
  SELECT diff_id, agent, 0, 'general', NULL, 'info', 'general', {strip("response")}, NULL
  FROM shaped WHERE shape = 'text' AND {strip("response")} <> ''),
summaries AS (
  SELECT diff_id, agent, CASE WHEN shape = 'dict' AND json_type(data, '$.summary') IS NOT NULL
      THEN coalesce(data->>'$.summary', '')
    WHEN response IS NULL THEN ''
    ELSE {strip("regexp_extract(response, '(?i)(?:^|\\n)(?:##?\\s*)?Summary:?\\s*([\\s\\S]*?)(?:\\n##|\\n\\n|$)', 1)")}
    END AS own_summary
  FROM shaped)
"""
ORACLES["json_locate"] = f"WITH {REPLIES} SELECT diff_id, agent, json FROM located"
ORACLES["comments"] = f"WITH {REPLIES} SELECT * FROM comments"
ORACLES["reply_summary"] = f"WITH {REPLIES} SELECT * FROM summaries"
ORACLES["priority_issues"] = f"""WITH {REPLIES} SELECT diff_id, CASE severity WHEN 'error' THEN 1
    WHEN 'warning' THEN 2 ELSE 3 END AS priority, file, line, agent, comment_idx, message FROM comments"""
ORACLES["shared_issues"] = f"""WITH {REPLIES} SELECT diff_id, file,
    CASE WHEN line IS NULL THEN '#' || category ELSE CAST(line AS VARCHAR) END AS place,
    count(DISTINCT agent) AS n_agents, count(*) AS n_comments
  FROM comments GROUP BY ALL HAVING count(DISTINCT agent) >= 2"""


def _default_summary() -> str:
    whens = []
    for a in A.AGENTS:
        parts = ", ".join(
            f"CASE WHEN {n} > 0 THEN {lit(label + ' ')} || {n} || {lit(A.COUNT_SUFFIX)} END"
            for n, label in (("errors", a.error_label), ("warnings", a.warning_label), ("infos", a.info_label))
        )
        whens.append(
            f"WHEN {lit(a.name)} THEN CASE WHEN n_comments = 0 THEN {lit(a.none_text)} "
            f"ELSE {lit(a.heading)} || concat_ws(', ', {parts}) END"
        )
    return f"CASE agent {' '.join(whens)} END"


REVIEWS = f"""{DIFFS}, {REPLIES},
tasks AS (
  SELECT diff_id, CAST(i - 1 AS INTEGER) AS agent_idx, [{", ".join(lit(n) for n in _NAMES)}][i] AS agent
  FROM diffs, range(1, 5) AS t(i) WHERE {strip("raw")} <> ''),
per_agent AS (
  SELECT diff_id, agent, count(*) AS n, count(*) FILTER (severity = 'error') AS e,
    count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i
  FROM comments GROUP BY ALL),
joined AS (
  SELECT diff_id, agent_idx, agent, coalesce(n, 0) AS n_comments, coalesce(e, 0) AS errors,
    coalesce(w, 0) AS warnings, coalesce(i, 0) AS infos, why, own_summary,
    CASE WHEN r.agent IS NULL THEN 'no response' ELSE r.error END AS call_error
  FROM tasks LEFT JOIN responses r USING (diff_id, agent) LEFT JOIN per_agent USING (diff_id, agent)
    LEFT JOIN failures USING (diff_id, agent) LEFT JOIN summaries USING (diff_id, agent)),
reviews AS MATERIALIZED (
  SELECT *, CASE WHEN call_error IS NOT NULL THEN {lit(A.CALL_FAILED)} || call_error
      WHEN why IS NOT NULL THEN {lit(A.REVIEW_FAILED)} || why
      WHEN own_summary <> '' THEN own_summary ELSE {_default_summary()} END AS summary
  FROM joined),
totals AS MATERIALIZED (
  SELECT diff_id, CAST(coalesce(sum(n_comments), 0) AS BIGINT) AS total_comments,
    CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
    CAST(coalesce(sum(warnings), 0) AS BIGINT) AS warnings, CAST(coalesce(sum(infos), 0) AS BIGINT) AS infos
  FROM diffs LEFT JOIN reviews USING (diff_id) GROUP BY diff_id),
comment_text AS (
  SELECT diff_id, agent,
    string_agg('- [' || upper(severity) || '] ' || coalesce(file, 'None')
      || CASE WHEN coalesce(line, 0) <> 0 THEN ':' || line ELSE '' END || {NL} || '  ' || coalesce(message, 'None')
      || CASE WHEN coalesce(suggestion, '') <> '' THEN {NL} || '  Suggestion: ' || suggestion ELSE '' END
      || {NL}, {NL} ORDER BY comment_idx) AS listed,
    string_agg('- **[' || upper(severity) || ']** `' || coalesce(file, 'None') || '`'
      || CASE WHEN coalesce(line, 0) <> 0 THEN ' (line ' || line || ')' ELSE '' END || {NL}
      || '  - ' || coalesce(message, 'None')
      || CASE WHEN coalesce(suggestion, '') <> '' THEN {NL} || '  - *Suggestion*: ' || suggestion ELSE '' END
      || {NL}, {NL} ORDER BY comment_idx) AS marked
  FROM comments GROUP BY ALL),
review_text AS (
  SELECT diff_id,
    string_agg('### ' || agent || {NL} || {NL} || coalesce(listed, '*No issues found.*' || {NL})
      || CASE WHEN summary <> '' THEN {NL} || '**Summary**: ' || summary || {NL} ELSE '' END,
      {NL} ORDER BY agent_idx) AS plain,
    string_agg('### ' || agent || {NL} || {NL} || '*' || n_comments || ' comments*' || {NL}
      || coalesce({NL} || marked, '')
      || CASE WHEN summary <> '' THEN {NL} || '**Summary**: ' || summary || {NL} ELSE '' END,
      {NL} ORDER BY agent_idx) AS marked
  FROM reviews LEFT JOIN comment_text USING (diff_id, agent) GROUP BY diff_id),
first_seen AS (
  SELECT diff_id, severity, min(agent_idx * 1000 + comment_idx) AS seen, count(*) AS n
  FROM comments JOIN tasks USING (diff_id, agent) GROUP BY ALL),
severity_text AS (
  SELECT diff_id, string_agg('- **' || upper(severity) || '** ['
    || CASE severity WHEN 'error' THEN 'X' WHEN 'warning' THEN '!' ELSE 'i' END || ']: ' || n,
    {NL} ORDER BY seen) AS severities
  FROM first_seen GROUP BY diff_id)
"""


def review_query(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {REVIEWS} {select}"


review_query(
    "agent_reviews",
    "SELECT diff_id, agent_idx, agent, n_comments, errors, warnings, infos FROM reviews",
)
review_query("agent_summary", "SELECT diff_id, agent, summary FROM reviews")
review_query("comment_totals", "SELECT diff_id, total_comments FROM totals")
review_query("by_severity", "SELECT diff_id, severity, n AS n_comments FROM first_seen")
_BEFORE, _AFTER = RV.TOTAL_TEXT
_COUNTS = ", ".join(
    f"CASE WHEN {n} > 0 THEN {lit(prefix)} || {n} || {lit(RV.COUNT_UNIT)} END"
    for n, prefix in zip(("errors", "warnings", "infos"), RV.PER_SEVERITY, strict=True)
)
review_query(
    "review_verdict",
    f"""SELECT diff_id, total_comments, errors, warnings, infos,
      CASE WHEN errors > 0 THEN 'must_fix' WHEN warnings > 0 THEN 'should_look' ELSE 'mergeable' END AS verdict,
      concat_ws({NL}, {lit(_BEFORE)} || total_comments || {lit(_AFTER)}, {_COUNTS},
        CASE WHEN errors > 0 THEN {text(RV.MUST_FIX)} WHEN warnings > 0 THEN {text(RV.SHOULD_LOOK)}
          ELSE {text(RV.MERGEABLE)} END) AS summary
      FROM totals SEMI JOIN tasks USING (diff_id)""",
)
review_query(
    "fmt_reviews",
    "SELECT diff_id, coalesce(plain, '') AS agent_reviews FROM diffs LEFT JOIN review_text USING (diff_id)",
)
_SUMMARY_SLOTS = {
    "files_changed": "files_changed",
    "additions": "total_additions",
    "deletions": "total_deletions",
    "agent_reviews": "plain",
}
review_query(
    "prompts_summary",
    f"""SELECT diff_id, length(p) AS prompt_chars, md5(p) AS prompt_md5
      FROM (SELECT diff_id, {filled("summary", _SUMMARY_SLOTS)} AS p
        FROM review_text JOIN diff_stats USING (diff_id))""",
)
review_query(
    "md_review",
    f"""SELECT diff_id, {text("# Code Review Results" + chr(10) * 2 + "## Diff Statistics" + chr(10) * 2)}
      || '- **Files Changed**: ' || files_changed || {NL} || '- **Additions**: +' || total_additions || {NL}
      || '- **Deletions**: -' || total_deletions || {NL}
      || coalesce({text(chr(10) + "## Issues by Severity" + chr(10) * 2)} || severities || {NL}, '')
      || coalesce({NL} || marked, '')
      || CASE WHEN plain IS NULL THEN {text(chr(10) + "## Overall Summary" + chr(10) * 2 + RV.NOTHING_TO_REVIEW + chr(10))}
        ELSE '' END AS report
      FROM diffs JOIN diff_stats USING (diff_id) LEFT JOIN severity_text USING (diff_id)
        LEFT JOIN review_text USING (diff_id)""",
)


def _agent_prompts() -> str:
    values = {"diff": "raw", "file_context": lit(RV.NO_CONTEXT)}
    whens = " ".join(f"WHEN {lit(a.name)} THEN {filled(a.template, values)}" for a in A.AGENTS)
    return f"CASE agent {whens} END"


ORACLES["prompts_review"] = f"""WITH diffs AS ({B.DIFFS.sql()}),
  tasks AS (SELECT diff_id, raw, unnest([{", ".join(lit(n) for n in _NAMES)}]) AS agent
    FROM diffs WHERE {strip("raw")} <> ''),
  prompts AS (SELECT diff_id, agent, {_agent_prompts()} AS p FROM tasks)
  SELECT diff_id, agent, length(p) AS prompt_chars, md5(p) AS prompt_md5 FROM prompts"""

ORACLES["file_context"] = f"""WITH {DIFFS}, parts AS ({B.FILES_CODE.sql()}),
  sources AS (
    SELECT repo_id, {B.CONTEXT_PATH} AS path, content FROM parts
    UNION ALL {B.FILES_DOCS.sql()} UNION ALL {B.FILES_PAGES.sql()}),
  blocks AS (
    SELECT diff_id, string_agg('### ' || path || {NL} || '```' || {NL} || content || {NL} || '```' || {NL},
      {NL} ORDER BY file_idx, content) AS c
    FROM file_rows JOIN diffs USING (diff_id) JOIN sources USING (repo_id, path) GROUP BY diff_id)
  SELECT diff_id, length(c) AS file_context_chars, md5(c) AS file_context_md5 FROM blocks"""

# --- explanations -----------------------------------------------------------------------------

_SECTION = r"(?is)(?:###?\s*)?{title}\s*\n(.*?)(?:\n###?\s|\n\n###?|\z)"
_PURPOSE, _KEYS = _SECTION.format(title="Purpose"), _SECTION.format(title="Key Elements")
ORACLES["purpose"] = f"""WITH replies AS ({B.REPLIES.sql()})
  SELECT repo_id, path, CASE WHEN regexp_matches(response, '{_PURPOSE}')
    THEN {strip(f"regexp_extract(response, '{_PURPOSE}', 1)")}
    ELSE {strip(f"string_split({strip('response')}, {NL} || {NL})[1]")} END AS purpose FROM replies"""
ORACLES["key_elements"] = f"""WITH replies AS ({B.REPLIES.sql()}),
  bullets AS (
    SELECT repo_id, path, list_filter(list_transform(
        regexp_extract_all(regexp_extract(response, '{_KEYS}', 1), '(?m)^\\s*[-*]\\s*(.+)$', 1),
        lambda x: {strip("x")}), lambda x: x <> '') AS es
    FROM replies)
  SELECT repo_id, path, CAST(i - 1 AS INTEGER) AS idx, es[i] AS element
  FROM bullets, unnest(range(1, len(es) + 1)) AS t(i)"""

_FILE_SLOTS = {"file_path": "path", "language": "explain_language", "lines": "n", "content": "txt"}
EXPLAIN = f"""
prompted AS (
  SELECT repo_id, path, explain_language AS language, n AS lines, {filled("file", _FILE_SLOTS)} AS p
  FROM (SELECT *, len(regexp_extract_all(txt, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'))
      + CASE WHEN txt <> '' AND right(txt, 1) <> {NL} THEN 1 ELSE 0 END AS n FROM f)
  WHERE size_bytes <= 500 * 1024),
answered AS (
  SELECT *, CASE WHEN length(p) % 11 <> 0 THEN '### Purpose' || {NL} || 'Holds ' || length(p)
      || ' characters.' || {text(chr(10) * 2 + "### Key Elements" + chr(10))} || '- first ' || length(p) % 7
      || {text(chr(10) + "* second" + chr(10) * 2 + "### Details" + chr(10) + "None.")} END AS response,
    CASE WHEN length(p) % 11 = 0 THEN 'refused ' || length(p) END AS error
  FROM prompted)
"""
simple(
    "prompts_file",
    "SELECT repo_id, path, length(p) AS prompt_chars, md5(p) AS prompt_md5 FROM prompted",
    EXPLAIN,
)
simple("complete_batch", "SELECT repo_id, path, language, lines, response, error FROM answered", EXPLAIN)
simple(
    "file_explanations",
    """SELECT repo_id, path, language, lines, 'Holds ' || length(p) || ' characters.' AS purpose,
      'first ' || length(p) % 7 || '|second' AS key_elements, response AS explanation
      FROM answered WHERE response IS NOT NULL""",
    EXPLAIN,
)
simple(
    "md_file",
    f"""SELECT repo_id, path, '# ' || name || {NL} || {NL} || '> ' || path || {NL} || {NL}
      || '- **Language**: ' || language || {NL} || '- **Lines**: ' || lines
      || {text(chr(10) * 2 + "## Purpose" + chr(10) * 2)} || 'Holds ' || length(p) || ' characters.'
      || {text(chr(10) * 2 + "## Key Elements" + chr(10) * 2)} || '- first ' || length(p) % 7
      || {text(chr(10) + "- second" + chr(10) * 2 + "## Explanation" + chr(10) * 2)} || response || {NL} AS report
      FROM (SELECT *, split_part(path, '/', -1) AS name FROM answered) WHERE response IS NOT NULL""",
    EXPLAIN,
)

# --- JSON reports -------------------------------------------------------------------------------

review_query(
    "review_result",
    f"""SELECT diff_id, files_changed, total_additions, total_deletions, coalesce(reviewers, '') AS reviewers,
      total_comments, coalesce(by_severity, '') AS by_severity,
      CASE WHEN reviewers IS NULL THEN {lit(RV.NOTHING_TO_REVIEW)} ELSE '' END AS summary
      FROM diff_stats JOIN totals USING (diff_id)
        LEFT JOIN (SELECT diff_id, string_agg(agent, ',' ORDER BY agent_idx) AS reviewers FROM reviews
          GROUP BY diff_id) USING (diff_id)
        LEFT JOIN (SELECT diff_id, string_agg(severity || '=' || n, ',' ORDER BY seen) AS by_severity
          FROM first_seen GROUP BY diff_id) USING (diff_id)""",
)
review_query(
    "report_json_review",
    f"""SELECT diff_id, CAST(to_json(struct_pack(
        diff_summary := struct_pack(files_changed := files_changed, total_additions := total_additions,
          total_deletions := total_deletions),
        agent_reviews := coalesce(rs, []), total_comments := total_comments,
        by_severity := coalesce(m, MAP {{}}),
        summary := CASE WHEN rs IS NULL THEN {lit(RV.NOTHING_TO_REVIEW)} ELSE '' END)) AS VARCHAR) AS report
      FROM diff_stats JOIN totals USING (diff_id)
        LEFT JOIN (
          SELECT diff_id, list(struct_pack(agent_name := agent, comments := coalesce(cs, []),
            summary := summary) ORDER BY agent_idx) AS rs
          FROM reviews LEFT JOIN (
            SELECT diff_id, agent, list(struct_pack(agent := agent, file := file, line := line,
              severity := severity, category := category, message := message, suggestion := suggestion)
              ORDER BY comment_idx) AS cs
            FROM comments GROUP BY ALL) USING (diff_id, agent)
          GROUP BY diff_id) USING (diff_id)
        LEFT JOIN (SELECT diff_id, map_from_entries(list((severity, n) ORDER BY seen)) AS m
          FROM first_seen GROUP BY diff_id) USING (diff_id)""",
)
simple(
    "report_json_quality",
    """SELECT repo_id, 'head' AS part, CAST(NULL AS VARCHAR) AS path,
        CAST(to_json(struct_pack(complexity_score := complexity_score, summary := summary)) AS VARCHAR) AS report
      FROM reports
      UNION ALL
      SELECT repo_id, 'issue', path, CAST(to_json(struct_pack(path := path, line := line,
        issue_type := issue_type, message := message, severity := severity)) AS VARCHAR)
      FROM issues""",
    QUALITY,
)
simple(
    "report_json_repo",
    """SELECT repo_id, CAST(to_json(struct_pack(path := repo_id, name := repo_id,
        total_files := total_files, total_lines := total_lines, languages := coalesce(ls, []),
        recent_commits := coalesce(cs, []), summary := '')) AS VARCHAR) AS report
      FROM totals
        LEFT JOIN (SELECT repo_id, list(struct_pack(language := language, files := files, lines := lines,
          percentage := round(pct, 6)) ORDER BY rank) AS ls FROM stats GROUP BY repo_id) USING (repo_id)
        LEFT JOIN (SELECT repo_id, list(struct_pack(hash := hash, short_hash := short_hash,
          message := message, author := author, date := strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00')
          ORDER BY commit_rank) AS cs FROM recent GROUP BY repo_id) USING (repo_id)""",
    OVERVIEW,
)
simple(
    "report_json_file",
    """SELECT repo_id, path, CAST(to_json(struct_pack(path := path,
        language := language, lines := lines, purpose := 'Holds ' || length(p) || ' characters.',
        key_elements := ['first ' || length(p) % 7, 'second'], explanation := response)) AS VARCHAR) AS report
      FROM answered WHERE response IS NOT NULL""",
    EXPLAIN,
)
