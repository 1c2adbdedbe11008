"""The catalog's queries once more, as SQL for DuckDB.

Written from the meaning of each operator, not from its Spark plan: its engine has no
look-ahead, so absence is tested on the text that follows, loops are found with
windows over lines, and structural equality is text equality after renaming.
"""

from __future__ import annotations

from sievework import rules as R

from .inputs import AS_OF_EPOCH, CODE_SQL, HOSTILE_SQL, KEYS_SQL, RULES_SQL, TREE_SQL
from .queries import (
    CAP,
    LICENSE_PATTERN,
    PAGE_RULES,
    RUN_DATE,
    TEXT_RULES,
    USER_SECRET,
)

W = r"[\p{L}\p{N}_]"
FILES = f"""
doc AS (SELECT source AS project, CAST(doc_id AS VARCHAR) AS path, text AS content,
        CAST(strlen(text) AS BIGINT) AS size, NULL::BIGINT AS mtime_epoch FROM documents),
code AS (SELECT project, path, content, CAST(strlen(content) AS BIGINT) AS size, mtime_epoch FROM (
{CODE_SQL}
)),
page AS (SELECT 'pages' AS project, CAST(page_id AS VARCHAR) AS path, html AS content,
         CAST(strlen(html) AS BIGINT) AS size, NULL::BIGINT AS mtime_epoch FROM pages),
both_files AS (SELECT * FROM code UNION ALL SELECT * FROM doc),
visible AS (SELECT * FROM code WHERE NOT regexp_matches(path, '(^|/)node_modules(/|$)'))"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(re2(pattern))})"


def re2(pattern: str) -> str:
    """The same pattern with Unicode words; no other dialect difference occurs in it."""
    return pattern.replace(r"(\w+)", f"({W}+)").replace(r"\w*", f"{W}*")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def redact(x: str) -> str:
    tokens = lit("\"[^\"\n]+\"|'[^'\n]+'|[^\"']+|[\"']")
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, {tokens}), lambda t: CASE WHEN length(t) > 10 "
        "AND left(t, 1) IN ('\"', '''') THEN left(t, 9) || '...REDACTED' || right(t, 1) ELSE t END), '')"
    )


def entropy(x: str) -> str:
    return f"coalesce(list_entropy(string_split({x}, '')), 0.0)"


def lines_of(files: str) -> str:
    return (
        "SELECT project, path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM "
        f"(SELECT project, path, string_split(content, chr(10)) AS ls FROM {files})"
    )


def not_comment(star: bool) -> str:
    return r"NOT regexp_matches(text, '^\s*(#|//" + (r"|\*" if star else "") + ")')"


def row(severity, check, message, file="project || '/' || path", line="0", snippet="''", project="project") -> str:
    return (
        f"{project} AS project, {severity} AS severity, {check} AS \"check\", {file} AS file, "
        f"CAST({line} AS BIGINT) AS line, {message} AS message, {snippet} AS snippet"
    )


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FILES, *ctes]) + "\n" + select


IN_TEST = "regexp_matches(lower(project || '/' || path), 'test|mock|fixture|fake|stub|example|sample|__tests__|spec\\.')"


# --- line rules ------------------------------------------------------------


def prefix_sql(files: str) -> str:
    parts = []
    for prefix, what in R.PREFIXES:
        hit = "['\"]\\Q" + prefix + "\\E[A-Za-z0-9_\\-]{10,}['\"]"
        message = f"{lit(f'Hardcoded {what} found in source code')} || CASE WHEN {IN_TEST} THEN ' (test file)' ELSE '' END"
        parts.append(
            "SELECT "
            + row(f"CASE WHEN {IN_TEST} THEN 'info' ELSE 'critical' END", "'security_scan'", message, line="line", snippet=redact(strip("text")))
            + f" FROM ({lines_of(files)}) WHERE {not_comment(True)} AND {matches('text', hit)}"
        )
    return "\nUNION ALL ".join(parts)


def secret_case(rules, value: str) -> str:
    whens = []
    for r in rules:
        found = f"regexp_extract(text, {lit(re2(r.pattern))})"
        quoted = "'[''\"](.*?)[''\"]'"
        val = f"regexp_extract({found}, {quoted}, 1)"
        gate = f"(NOT regexp_matches({found}, {quoted}) OR (length({val}) >= 10 AND {entropy(val)} >= 3.0))"
        whens.append(f"WHEN {matches('text', r.pattern)} AND {gate} THEN {lit(getattr(r, value))}")
    return "CASE " + " ".join(whens) + " END"


def secret_sql(files: str, rules) -> str:
    return (
        "SELECT "
        + row(f"CASE WHEN {IN_TEST} THEN 'info' ELSE sev END", "'security_scan'", "msg", line="line", snippet=redact(strip("text")))
        + f" FROM (SELECT *, {secret_case(rules, 'severity')} AS sev, {secret_case(rules, 'message')} AS msg"
        + f" FROM ({lines_of(files)}) WHERE {not_comment(True)}) WHERE msg IS NOT NULL"
    )


def first_case(rules, value: str) -> str:
    whens = [f"WHEN {matches('text', r.pattern)} THEN {lit(getattr(r, value))}" for r in rules]
    return "CASE " + " ".join(whens) + " END"


def first_sql(files: str, rules, check: str = "security_scan", severity: str = "sev") -> str:
    return (
        "SELECT "
        + row(severity, lit(check), "msg", line="line", snippet=f"left({redact(strip('text'))}, 200)")
        + f" FROM (SELECT *, {first_case(rules, 'severity')} AS sev, {first_case(rules, 'message')} AS msg"
        + f" FROM ({lines_of(files)}) WHERE {not_comment(False)}) WHERE msg IS NOT NULL"
    )


def error_rules():
    """The look-ahead of the first rule never applies to a call that ends its line."""
    fetch, bare = R.ERROR_RULES
    return [R.Rule(r"(?:await\s+)?fetch\s*\([^)]+\)", fetch.message, fetch.severity), bare]


def perf_lines_sql(files: str) -> str:
    return (
        first_sql(files, error_rules(), "performance_lint")
        + "\nUNION ALL "
        + first_sql(files, R.SQL_RULES, "performance_lint")
    )


# --- whole-text rules ------------------------------------------------------


def pieces(files: str, pattern: str) -> str:
    """Every match with the text before it."""
    p = lit(re2(pattern))
    return (
        f"SELECT project, path, content, found, before || array_to_string(ms[1:i - 1], '') AS others, "
        "length(before) + length(array_to_string(ms[1:i], '')) AS stop, "
        "1 + length(before || array_to_string(ms[1:i - 1], '')) "
        "- length(replace(before || array_to_string(ms[1:i - 1], ''), chr(10), '')) AS line "
        "FROM (SELECT *, ms[i] AS found, array_to_string(ps[1:i], '') AS before FROM ("
        "SELECT project, path, content, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM ("
        f"SELECT project, path, content, regexp_extract_all(content, {p}) AS ms, string_split_regex(content, {p}) AS ps "
        f"FROM {files})))"
    )


def shown(x: str) -> str:
    return f"replace(left({redact(x)}, 200), chr(10), ' | ')"


def multi_sql(files: str, rules) -> str:
    return "\nUNION ALL ".join(
        "SELECT "
        + row(lit(r.severity), "'performance_lint'", lit(r.message), line="line", snippet=shown("found"))
        + f" FROM ({pieces(files, r.pattern)})"
        for r in rules
    )


# What each rule with a look-ahead finds, and what must not begin within so many characters.
ABSENT = [
    (r"\.select\s*\(\s*['\"]?\*['\"]?\s*\)", 200, r"\.limit\s*\("),
    (r"supabase\s*\.\s*from\s*\([^)]+\)\s*\.\s*select\s*\([^)]*\)", 150, r"\.(?:limit|single|maybeSingle)\s*\("),
    (r"\.fetchall\s*\(\s*\)", 50, "LIMIT"),
]


def absent_sql(files: str, which: int = 0) -> str:
    rule, (x, n, y) = R.UNBOUNDED_RULES[which], ABSENT[which]
    return (
        "SELECT "
        + row(lit(rule.severity), "'performance_lint'", lit(rule.message), line="line", snippet=shown("found"))
        + f" FROM ({pieces(files, x)}) WHERE NOT regexp_matches(substr(content, stop + 1), '^(?s:.{{0,{n}}}){y}')"
    )


def loop_sql(files: str) -> str:
    """A header line whose first later call comes before the first line that ends its body."""
    parts = []
    for n, rule in enumerate(R.LOOP_RULES):
        lang = " AND path LIKE '%.py'" if rule.lang == "python" else ""
        parts.append(
            "SELECT "
            + row(
                lit(rule.severity),
                "'performance_lint'",
                lit(rule.message),
                line="h",
                snippet=shown(
                    "regexp_extract(head, '(?:for|while).*') || chr(10) || between_lines || "
                    f"regexp_extract(last, {lit('.*' + rule.call)})"
                ),
            )
            + f""" FROM (
  SELECT h.project, h.path, h.line AS h, any_value(h.text) AS head, arg_min(c.text, c.line) AS last, min(c.line) AS c,
    coalesce((SELECT string_agg(m.text || chr(10), '' ORDER BY m.line) FROM ({lines_of(files)}) m
      WHERE m.project = h.project AND m.path = h.path AND m.line > h.line AND m.line < min(c.line)), '') AS between_lines
  FROM ({lines_of(files)}) h JOIN ({lines_of(files)}) c
    ON h.project = c.project AND h.path = c.path AND c.line > h.line
  WHERE regexp_matches(h.text, '(?:for|while)\\s+.+:\\s*$') AND {matches('c.text', rule.call)}
    {lang.replace('path', 'h.path')}
    AND NOT EXISTS (SELECT 1 FROM (SELECT *, lag(text) OVER (PARTITION BY project, path ORDER BY line) AS prev
      FROM ({lines_of(files)})) b WHERE b.project = h.project AND b.path = h.path AND b.line > h.line AND b.line <= c.line
      AND NOT regexp_matches(b.text, '^(\\s|$)') AND NOT regexp_matches(b.prev, '^\\s*$'))
  GROUP BY h.project, h.path, h.line)"""
        )
    return "\nUNION ALL ".join(parts)


# --- usage -----------------------------------------------------------------

JS_PATH = r"regexp_matches(path, '\.(?:js|mjs|cjs|ts|tsx)$')"


def exports_sql(files: str, strict: bool = False) -> str:
    which = 2 if strict else 1
    names = ", ".join(lit(n) for n in R.FRAMEWORK_EXPORTS)
    bases = ", ".join(lit(n) for n in R.FRAMEWORK_BASENAMES)
    imp = lit(re2(R.IMPORT_PATTERN))
    part = strip("part")
    return (
        "SELECT "
        + row("'info'", "'dead_code'", "'Exported function ''' || name || ''' not imported anywhere in project'", line="line")
        + f""" FROM (SELECT project, path, line, regexp_extract(found, {lit(re2(R.EXPORT_PATTERN))}, 1) AS name
  FROM ({pieces(files, R.EXPORT_PATTERN)}) WHERE {JS_PATH}) e
WHERE name NOT IN ({names}) AND string_split(path, '/')[-1] NOT IN ({bases}) AND NOT EXISTS (
  SELECT 1 FROM (
    SELECT project, CASE WHEN {part} LIKE '% as %' THEN {strip(f"string_split({part}, ' as ')[{which}]")} ELSE {part} END AS name
    FROM (SELECT project, unnest(string_split(b, ',')) AS part FROM (
      SELECT project, unnest(regexp_extract_all(content, {imp}, 1)) AS b FROM {files} WHERE {JS_PATH}))
    UNION ALL
    SELECT project, unnest(regexp_extract_all(content, {imp}, 2)) FROM {files} WHERE {JS_PATH}
  ) i WHERE i.project = e.project AND i.name = e.name AND i.name <> '')"""
    )


def imports_sql(files: str) -> str:
    """Holds for flat import lines, the only ones in the corpus."""
    return (
        "SELECT "
        + row("'info'", "'dead_code'", "'Unused import: ' || name", line="line")
        + f""" FROM (SELECT project, path, line, trim(unnest(string_split(substr(text, 8), ','))) AS name
  FROM ({lines_of(files)}) WHERE path LIKE '%.py' AND regexp_matches(text, '^import ')) i
WHERE NOT EXISTS (SELECT 1 FROM ({lines_of(files)}) u WHERE u.project = i.project AND u.path = i.path
  AND NOT regexp_matches(u.text, '^(import |# )') AND list_contains(regexp_extract_all(u.text, '{W}+'), i.name))"""
    )


def unused_fn_sql(files: str) -> str:
    return (
        "SELECT "
        + row("'info'", "'dead_code'", "'Potentially unused function: ' || name || '() -- not called anywhere in ' || project", line="line")
        + f""" FROM (SELECT project, path, line, regexp_extract(text, '^(?:async )?def ({W}+)', 1) AS name
  FROM ({lines_of(files)}) WHERE path LIKE '%.py' AND regexp_matches(text, '^(?:async )?def ')) d
WHERE NOT regexp_matches(name, '^(__|test_)')
AND NOT EXISTS (SELECT 1 FROM ({lines_of(files)}) u WHERE u.project = d.project AND u.path = d.path AND u.line <> d.line
  AND list_contains(regexp_extract_all(u.text, '{W}+'), d.name))
AND NOT EXISTS (SELECT 1 FROM (SELECT project, unnest(regexp_extract_all(regexp_replace(content, 'def\\s+{W}+\\s*\\(', '', 'g'),
  '({W}+)\\s*\\(', 1)) AS name FROM {files} WHERE path LIKE '%.py') c WHERE c.project = d.project AND c.name = d.name)"""
    )


# --- dependencies ----------------------------------------------------------

MANIFESTS = "m AS (SELECT project, content, json_valid(content) AS ok FROM code WHERE path = 'package.json')"
JS_DEPS = """js AS (SELECT project, name, json_extract_string(content, '$.dependencies."' || name || '"') AS version FROM (
  SELECT project, content, unnest(json_keys(content, '$.dependencies')) AS name FROM m WHERE ok))"""
REQS = rf"""req_lines AS (SELECT project, line - 1 AS pos, {strip("text")} AS text FROM ({lines_of('code')}) WHERE path = 'requirements.txt'),
reqs AS (SELECT project, name, arg_max(version, pos) AS version, min(pos) AS pos FROM (
  SELECT project, pos, lower(trim(CASE WHEN text LIKE '%==%' THEN split_part(text, '==', 1)
      WHEN text LIKE '%>=%' THEN split_part(text, '>=', 1) ELSE regexp_extract(text, '^[^<>=!]*') END)) AS name,
    trim(CASE WHEN text LIKE '%==%' THEN substr(text, strpos(text, '==') + 2)
      WHEN text LIKE '%>=%' THEN substr(text, strpos(text, '>=') + 2) ELSE 'unpinned' END) AS version
  FROM req_lines WHERE text <> '' AND text NOT LIKE '#%'
    AND (text LIKE '%==%' OR text LIKE '%>=%' OR text NOT LIKE '-%')) GROUP BY project, name)"""
DEPS = [MANIFESTS, JS_DEPS, REQS]
CLEAN = r"regexp_replace(version, '^[\^~>=<! ]+', '')"


def advisory_sql() -> str:
    values = ", ".join("(" + ", ".join(lit(v) for v in a) + ")" for a in R.ADVISORIES)
    return (
        "SELECT "
        + row(
            "'warning'",
            "'dependency_audit'",
            "'Potentially vulnerable: ' || d.name || CASE eco WHEN 'python' THEN '==' ELSE '@' END || v || ' -- ' || note",
            file="project || CASE eco WHEN 'python' THEN '/requirements.txt' ELSE '/package.json' END",
        )
        + f""" FROM (SELECT project, 'javascript' AS eco, name, {CLEAN} AS v FROM js
  UNION ALL SELECT project, 'python', name, version FROM reqs WHERE version <> 'unpinned') d
JOIN (VALUES {values}) a(ecosystem, package, prefix, note)
  ON a.ecosystem = d.eco AND CASE eco WHEN 'python' THEN lower(package) ELSE package END = d.name AND starts_with(v, prefix)"""
    )


def pre_release_sql() -> str:
    return (
        "SELECT "
        + row(
            "'info'", "'dependency_audit'",
            "'Production dependency on pre-1.0: ' || name || '@' || version || ' -- may be unstable'",
            file="project || '/package.json'",
        )
        + f" FROM js WHERE regexp_extract({CLEAN}, '^\\d+') = '0' AND name NOT IN ('tailwind-merge', 'clsx')"
    )


def lock_sql() -> str:
    age = f"({AS_OF_EPOCH} - l.mtime_epoch) / 86400.0"
    old = f"(l.project IS NOT NULL AND {age} > 90)"
    return (
        "SELECT "
        + row(
            f"CASE WHEN {old} THEN 'info' ELSE 'warning' END",
            "'dependency_audit'",
            f"CASE WHEN {old} THEN 'Lockfile is ' || CAST(CAST(floor({age}) AS BIGINT) AS VARCHAR) || "
            "' days old -- consider running npm audit / npm update' ELSE 'No lockfile found -- builds may be non-deterministic' END",
            file="m.project || '/package-lock.json'",
            project="m.project",
        )
        + f""" FROM m LEFT JOIN (SELECT project, mtime_epoch FROM code WHERE path = 'package-lock.json') l ON m.project = l.project
WHERE m.ok AND ({old} OR (l.project IS NULL AND len(json_keys(m.content, '$.dependencies')) > 0))"""
    )


def manifest_sql() -> str:
    return (
        "SELECT "
        + row("'warning'", "'dependency_audit'", "'Invalid JSON in package.json'", file="project || '/package.json'")
        + " FROM m WHERE NOT ok UNION ALL SELECT "
        + row(
            "'info'", "'dependency_audit'", lit("No 'engines' field -- Node.js version not pinned"),
            file="project || '/package.json'",
        )
        + " FROM m WHERE ok AND len(json_keys(content, '$.dependencies')) > 0 AND NOT list_contains(json_keys(content), 'engines')"
    )


def unpinned_sql() -> str:
    return (
        "SELECT "
        + row(
            "'warning'", "'dependency_audit'",
            "'Unpinned Python dependencies (non-reproducible): ' || array_to_string(list(name ORDER BY pos, name)[1:10], ', ')",
            file="project || '/requirements.txt'",
        )
        + " FROM reqs WHERE version = 'unpinned' GROUP BY project"
    )


TRACKED = """tracked AS (SELECT project, name, arg_min(version, (prio, pos)) AS version FROM (
  SELECT project, name, version, 1 AS prio, 0 AS pos FROM js WHERE name IN ("""
TRACKED += ", ".join(lit(n) for n in R.TRACKED_PACKAGES) + """)
  UNION ALL SELECT project, trim(split_part(text, '==', 1)), trim(substr(text, strpos(text, '==') + 2)), 0, -pos
    FROM req_lines WHERE text LIKE '%==%'
  UNION ALL SELECT project, trim(split_part(text, '>=', 1)), '>=' || trim(substr(text, strpos(text, '>=') + 2)), 0, -pos
    FROM req_lines WHERE text LIKE '%>=%' AND text NOT LIKE '%==%') GROUP BY project, name)"""


def mismatch_sql(versions: str) -> str:
    return (
        "SELECT "
        + row(
            "'warning'", "'architecture_review'",
            "'Version mismatch for ''' || name || ''': ' || CAST(count(DISTINCT version) AS VARCHAR) || ' versions in ' || "
            "CAST(count(*) AS VARCHAR) || ' projects, from ' || min(version) || ' to ' || max(version)",
            file="'(cross-project)'", project="''",
        )
        + f" FROM {versions} GROUP BY name HAVING count(*) >= 2 AND min(version) <> max(version)"
    )


PART_VERSIONS = "WITH v AS (SELECT p_brand AS project, p_name AS name, min(p_type) AS version FROM part GROUP BY ALL)\n"


# --- layout ----------------------------------------------------------------


def required_sql(projects: str, files: str) -> str:
    return (
        "SELECT "
        + row(
            "'warning'", "'security_scan'",
            "CASE WHEN g.project IS NULL THEN 'No .gitignore file found -- secrets may be committed' "
            "ELSE r.entry || ' not found in .gitignore -- secrets may be committed' END",
            file="p.project || '/.gitignore'", project="p.project",
        )
        + f""" FROM (SELECT DISTINCT project FROM {projects}) p
LEFT JOIN (SELECT project, list_transform(string_split(content, chr(10)), lambda l: {strip('l')}) AS ls
  FROM {files} WHERE path = '.gitignore') g ON p.project = g.project
JOIN (VALUES ('.env'), ('.env.local'), ('.env.production')) r(entry)
  ON CASE WHEN g.project IS NULL THEN r.entry = '.env' ELSE NOT list_contains(ls, r.entry)
     AND NOT list_contains(ls, '*' || r.entry || '*') AND NOT list_contains(ls, '.env*') END"""
    )


def counterpart_sql(files: str) -> str:
    return (
        "SELECT "
        + row(
            "'info'", "'architecture_review'",
            lit("Project has .env but no .env.example -- new developers won't know required env vars"),
            file="project || '/.env.example'",
        )
        + f" FROM {files} WHERE path = '.env' AND project NOT IN (SELECT project FROM {files} WHERE path = '.env.example')"
    )


def no_manifest_sql(files: str) -> str:
    return (
        "SELECT "
        + row(
            "'info'", "'dependency_audit'", "'Python project without requirements.txt or pyproject.toml'",
            file="project || '/requirements.txt'",
        )
        + f""" FROM (SELECT DISTINCT project FROM {files} WHERE path LIKE '%.py' AND path NOT LIKE '%/%')
WHERE project NOT IN (SELECT project FROM {files} WHERE path IN ('requirements.txt', 'pyproject.toml'))"""
    )


def fk_sql(files: str) -> str:
    return (
        "SELECT "
        + row(
            "'warning'", "'performance_lint'",
            "'Foreign key column ''' || col || ''' in table ''' || tab || ''' has no index -- queries filtering on this will be slow'",
        )
        + rf""" FROM (SELECT project, path, tab, unnest(regexp_extract_all(body, '(?i)({W}+_id)\s+(?:integer|bigint|uuid|text)', 1)) AS col FROM (
    SELECT project, path, unnest(regexp_extract_all(content, '(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\S+)\s*\((.+?)\);', 1)) AS tab,
      unnest(regexp_extract_all(content, '(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\S+)\s*\((.+?)\);', 2)) AS body
    FROM {files} WHERE path LIKE 'migrations/%.sql')) k
WHERE NOT EXISTS (SELECT 1 FROM (SELECT project, path, unnest(string_split(content, ';')) AS st FROM {files}) s
  WHERE s.project = k.project AND s.path = k.path
    AND lower(regexp_extract(st, '(?i)INDEX.*\sON\s+(\S+)', 1)) = lower(tab)
    AND lower(regexp_extract(st, '\(([^)]*)\)', 1)) = lower(col))"""
    )


# --- groups ----------------------------------------------------------------

FINGERPRINT = rf"""md5(array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(content,
  '//[^\n]*|/\*(?s:.*?)\*/', '', 'g'),
  '''(?:[^''\\\n]|\\[^\n])*''|"(?:[^"\\\n]|\\[^\n])*"|`(?:[^`\\\n]|\\[^\n])*`', 'STR', 'g'),
  '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
  lambda t: CASE WHEN regexp_matches(t, '^[a-zA-Z_]') THEN 'ID' ELSE t END), ''))"""
DOC_GROUPS = f"""shaped AS (SELECT project, path, {FINGERPRINT} AS fp FROM doc),
groups AS (SELECT fp, count(*) AS n, count(DISTINCT project) > 1 AS cross_project,
  arg_min(project || '/' || path, (project, path)) AS file FROM shaped GROUP BY fp
  HAVING count(*) >= 2)"""


def dups_sql(files: str, path: str, lang: str) -> str:
    """One function per file of a template: equal shape is equal text without its numbers."""
    lines = "length(content) - length(replace(content, chr(10), '')) - 1"
    place = "project || '/' || path"
    return (
        "SELECT "
        + row(
            "CASE WHEN count(DISTINCT project) > 1 THEN 'warning' ELSE 'info' END",
            "'duplicate_code'",
            "'Duplicate function structure found in ' || CAST(count(*) AS VARCHAR) || ' locations' || "
            "CASE WHEN count(DISTINCT project) > 1 THEN ' (CROSS-PROJECT)' ELSE '' END || ', first: ' || "
            f"arg_min({place} || ':1 -> ' || fn || '() (' || CAST(n AS VARCHAR) || ' lines)', (project, path))",
            file=f"arg_min({place}, (project, path))",
            line="1",
            project="''",
        )
        + f""" FROM (SELECT project, path, {lines} AS n, regexp_replace(content, '\\d+', 'N', 'g') AS shape,
  regexp_extract(content, '(?:def|function) (\\w+)', 1) AS fn
  FROM (SELECT project, path, regexp_replace(content, '(?:#|//) [^\\n]*\\n$', '') AS content FROM {files} WHERE path = {lit(path)}))
GROUP BY shape HAVING count(*) >= 2"""
    )


def sprawl_sql(files: str, pattern: str, min_files: int) -> str:
    return (
        "SELECT "
        + row(
            "'info'", "'architecture_review'",
            "'Supabase client initialized in ' || CAST(count(*) AS VARCHAR) || ' files -- consider a shared client module. Files: ' "
            "|| array_to_string(list(path ORDER BY path)[1:5], ', ') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END",
            file="project",
        )
        + f" FROM {files} WHERE {matches('content', pattern)} GROUP BY project HAVING count(*) > {min_files}"
    )


def sprawl_global_sql(files: str) -> str:
    return (
        "SELECT "
        + row(
            "'warning'", "'architecture_review'",
            "'Supabase client initialized in ' || CAST(sum(n) AS VARCHAR) || ' files across ' || CAST(count(*) AS VARCHAR) || ' projects -- consider a shared client package'",
            file="'(cross-project)'", project="''",
        )
        + f" FROM (SELECT project, count(*) AS n FROM {files} WHERE {matches('content', R.CLIENT_PATTERN)} GROUP BY project)"
        + " HAVING sum(n) > 5 AND count(*) > 1"
    )


def wrappers_sql(files: str) -> str:
    return f"SELECT project, path, unnest(regexp_extract_all(content, {lit(re2(R.WRAPPER_PATTERN))}, 1)) AS name FROM {files}"


def wrapper_global_sql(files: str) -> str:
    return (
        "SELECT "
        + row(
            "'info'", "'architecture_review'",
            "'Found ' || CAST(count(*) AS VARCHAR) || ' HTTP fetch wrappers across ' || CAST(count(DISTINCT project) AS VARCHAR) "
            "|| ' projects -- consider a shared fetch utility'",
            file="'(cross-project)'", project="''",
        )
        + f" FROM ({wrappers_sql(files)}) HAVING count(*) > 8 AND count(DISTINCT project) > 2"
    )


def stale_sql(files: str) -> str:
    age = f"({AS_OF_EPOCH} - mtime_epoch) / 86400.0"
    return (
        "SELECT "
        + row(
            f"CASE WHEN {age} > 365 THEN 'warning' ELSE 'info' END", "'dead_code'",
            f"'Stale file: not modified in ' || CAST(CAST(floor({age}) AS BIGINT) AS VARCHAR) || ' days'",
        )
        + f" FROM {files} WHERE {age} > 180"
    )


# --- whole audit -----------------------------------------------------------

CODE_EXT = r"regexp_matches(path, '\.(?:py|js|mjs|cjs|ts|tsx)$')"
CONF_EXT = r"regexp_matches(path, '\.(?:json|yaml|yml|toml|xml|conf|cfg)$')"
AUDIT_CTES = [
    *DEPS,
    TRACKED,
    f"""yaml AS (SELECT project, path || '.yaml' AS path, content, size, mtime_epoch FROM doc),
scan AS (SELECT * FROM visible WHERE {CODE_EXT} OR {CONF_EXT} UNION ALL SELECT * FROM yaml),
code_only AS (SELECT * FROM visible WHERE {CODE_EXT}),
every AS (SELECT * FROM code UNION ALL SELECT * FROM yaml)""",
]
AUDIT_PARTS = [
    dups_sql("code_only", "src/dup.py", "py"),
    dups_sql("code_only", "src/dup.js", "js"),
    prefix_sql("scan"),
    secret_sql("scan", [*R.SECRET_RULES, USER_SECRET]),
    first_sql("code_only", R.INSECURE_RULES),
    required_sql("every", "every"),
    imports_sql("code_only"),
    unused_fn_sql("code_only"),
    exports_sql("code_only"),
    stale_sql("code_only"),
    sprawl_sql("code_only", R.CLIENT_PATTERN, 3),
    counterpart_sql("code"),
    mismatch_sql("tracked"),
    sprawl_global_sql("code_only"),
    wrapper_global_sql("code_only"),
    manifest_sql(),
    advisory_sql(),
    pre_release_sql(),
    lock_sql(),
    unpinned_sql(),
    no_manifest_sql("code"),
    perf_lines_sql("code_only"),
    absent_sql("code_only"),
    loop_sql("code_only"),
    fk_sql("code"),
]
AUDIT = "\nUNION ALL ".join(f"SELECT * FROM ({part})" for part in AUDIT_PARTS)


def over_audit(select: str) -> str:
    return query(select, *AUDIT_CTES, f"found AS ({AUDIT})", "scanned AS (SELECT DISTINCT project FROM every)")


COUNTS = (
    "count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, "
    "count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info"
)
SUMMARY = (
    "SELECT s.project, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, "
    f"coalesce(info, 0) AS info FROM scanned s LEFT JOIN (SELECT project, {COUNTS} FROM found WHERE project <> '' GROUP BY project) c "
    "ON s.project = c.project"
)
TOTALS = f"SELECT (SELECT count(*) FROM scanned) AS projects_scanned, {COUNTS} FROM found"
TOP = 'SELECT * FROM found WHERE severity = \'critical\' ORDER BY project, file, line, "check", message LIMIT '


def top_lines(k: int, cut: int, lead: str, section: int) -> str:
    return (
        f"SELECT {section} AS section, row_number() OVER (ORDER BY project, file, line, \"check\", message) AS pos, "
        f"'{lead}- [' || \"check\" || '] ' || file || ': ' || left(message, {cut}) AS text FROM ({TOP}{k})"
    )


def section(number: int, text: str, source: str) -> str:
    return f"SELECT {number} AS section, 0 AS pos, {text} AS text FROM {source}"


CRITICALS = "(SELECT count(*) AS n FROM found WHERE severity = 'critical')"
ALERT = " UNION ALL ".join(
    f"({part})"
    for part in [
        section(0, f"'QA ALERT: ' || CAST(n AS VARCHAR) || ' critical issues found ({RUN_DATE})'", CRITICALS + " WHERE n > 0"),
        section(1, "''", CRITICALS + " WHERE n > 0"),
        top_lines(10, 100, "", 2),
        section(3, "'... and ' || CAST(n - 10 AS VARCHAR) || ' more'", CRITICALS + " WHERE n > 10"),
        section(4, f"chr(10) || 'Full report: /tmp/qa-report-{RUN_DATE}.json'", CRITICALS + " WHERE n > 0"),
    ]
)
DIGEST = " UNION ALL ".join(
    f"({part})"
    for part in [
        section(0, f"'Nightly audit report — {RUN_DATE}'", "(SELECT 1)"),
        section(
            1,
            "'Projects: ' || projects_scanned || ' | Findings: ' || total || ' (critical=' || critical || ', warning=' || warning || ', info=' || info || ')'",
            f"({TOTALS})",
        ),
        section(2, "'Duration: 0.0s'", "(SELECT 1)"),
        section(
            3,
            "'  ' || project || ': ' || critical || ' critical, ' || warning || ' warning, ' || info || ' info'",
            f"({SUMMARY}) WHERE critical > 0 OR warning > 0",
        ),
        section(4, "'Critical issues:'", f"({TOTALS}) WHERE critical > 0"),
        top_lines(5, 120, "  ", 5),
    ]
)

ORDERS = (
    "SELECT o_custkey, avg(o_totalprice) / 500000.0 AS score, CASE WHEN avg(o_totalprice) > 250000 THEN 'high' ELSE 'low' END AS label "
    "FROM orders WHERE CAST(o_orderdate AS DATE) {} DATE '1996-01-01' GROUP BY o_custkey"
)
BOTH_PRICES = "a.score IS NOT NULL AND b.score IS NOT NULL"
DRIFT = f"""SELECT compared, baseline_rows, changed_labels, round(mean_change, 6) AS mean_change, round(max_change, 6) AS max_change,
  moved_keys, round(changed_labels / compared, 6) AS label_share,
  CASE WHEN baseline_rows = 0 THEN 'no baseline' WHEN changed_labels / compared > 0.05 OR abs(mean_change) > 0.03 OR moved_keys > 0
    THEN 'drift' ELSE 'stable' END AS status
FROM (SELECT count(*) FILTER ({BOTH_PRICES}) AS compared, count(b.score) AS baseline_rows,
  count(*) FILTER ({BOTH_PRICES} AND a.label <> b.label) AS changed_labels,
  avg(a.score - b.score) AS mean_change, max(abs(a.score - b.score)) AS max_change,
  count(*) FILTER ({BOTH_PRICES} AND abs(a.score - b.score) > 0.15) AS moved_keys
  FROM ({ORDERS.format('>=')}) a FULL OUTER JOIN ({ORDERS.format('<')}) b ON a.o_custkey = b.o_custkey)"""

STALE_ORDERS = (
    "SELECT "
    + row(
        "CASE WHEN age > 365 THEN 'warning' ELSE 'info' END", "'dead_code'",
        "'Stale file: not modified in ' || CAST(age AS VARCHAR) || ' days'",
        file="'customers/' || CAST(o_custkey AS VARCHAR)", project="'customers'",
    )
    + " FROM (SELECT o_custkey, date_diff('day', max(CAST(o_orderdate AS DATE)), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS age"
    " FROM orders GROUP BY o_custkey) WHERE age > 180"
)

NOT_IGNORED = r"NOT regexp_matches(path, '(^|/)(node_modules|dist|[^/]*\.md)(/|$)') AND NOT regexp_matches(path, '^config/.*')"
EXT = r"regexp_matches(path, '\.(?:py|ts|tsx|json|yaml|yml|toml|xml|conf|cfg)$')"
QUOTED_TOKENS = "unnest(regexp_extract_all(content, '\"([^\"\n]+)\"', 1))"


def number(group: int) -> str:
    return f"coalesce(CAST(nullif(regexp_extract(clean, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', {group}), '') AS BIGINT), -1)"


QUARANTINE = f"""
WITH f AS (SELECT project, i, doc_id, project || '/' || path AS file, content FROM ({HOSTILE_SQL}))
SELECT project, file, 'dead_code' AS "check", 'warning' AS severity, 'skipped' AS reason FROM f WHERE i = 0
UNION ALL SELECT project, file, 'duplicate_code', 'warning', 'skipped' FROM f WHERE i = 1
UNION ALL SELECT project, file, 'duplicate_code', 'warning', 'failed' FROM f WHERE i IN (2, 3)
UNION ALL SELECT project, file, 'security_scan', 'info', 'not checked' FROM f WHERE i = 4 AND content IS NULL
UNION ALL SELECT project, file, 'security_scan', 'warning', 'skipped' FROM f WHERE i IN (0, 1, 5)
UNION ALL SELECT project, file, 'security_scan', 'warning', 'found' FROM f
  WHERE i > 5 AND regexp_matches(content, '"user-[0-9a-f]{{32}}"')
"""

ORACLE = {
    "q_corpus": query(
        "SELECT project, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, max(size) AS largest FROM doc GROUP BY project"
    ),
    "q_lines": query(
        "SELECT project, path, count(*) AS n_lines, count(*) FILTER (text = '') AS n_empty, CAST(sum(length(text)) AS BIGINT) AS n_chars "
        f"FROM ({lines_of('doc')}) GROUP BY project, path"
    ),
    "q_comments": query(
        "SELECT project, path, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars "
        f"FROM ({lines_of('both_files')}) WHERE {not_comment(False)} GROUP BY project, path"
    ),
    "q_ignore": query(f"SELECT project, path, size FROM code WHERE {NOT_IGNORED}"),
    "q_ext": query(
        "SELECT project, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN regexp_matches(path, '\\.(?:ts|tsx)$') "
        f"THEN 'javascript' ELSE 'unknown' END AS lang FROM code WHERE {EXT} AND string_split(path, '/')[-1] <> 'package.json'"
    ),
    "q_select": query("SELECT project, path, size FROM code WHERE project = 'p1'"),
    "q_absent": query("SELECT DISTINCT project FROM code"),
    "q_read_cap": query(
        f"SELECT project, path, size, length(content) AS n_chars FROM doc WHERE size <= {CAP} AND content <> ''"
    ),
    "q_large": query(f"SELECT project, path, size FROM doc WHERE size > {CAP}"),
    "q_entropy": query(
        f"SELECT *, round({entropy('token')}, 6) AS entropy FROM (SELECT project, path, {QUOTED_TOKENS} AS token FROM both_files)"
    ),
    "q_redact": query(
        f"SELECT project, path, line, {redact('text')} AS shown FROM ({lines_of('both_files')}) WHERE regexp_matches(text, '[\"'']')"
    ),
    "q_version": query(
        f"SELECT project, name, clean, {number(1)} AS major, {number(2)} AS minor, {number(3)} AS patch "
        f"FROM (SELECT project, name, {CLEAN} AS clean FROM js)",
        *DEPS,
    ),
    "q_pre_release": query(pre_release_sql(), *DEPS),
    "q_prefix": query(prefix_sql("both_files")),
    "q_secret": query(secret_sql("both_files", [*R.SECRET_RULES, USER_SECRET])),
    "q_downgrade": query(
        first_sql(
            "both_files",
            [USER_SECRET, *R.SECRET_RULES[2:3]],
            severity="CASE WHEN regexp_matches(lower(project || '/' || path), 'test|src1|keys\\.') THEN 'info' ELSE sev END",
        )
    ),
    "q_first": query(first_sql("doc", TEXT_RULES)),
    "q_insecure": query(first_sql("code", R.INSECURE_RULES)),
    "q_groups": query(
        first_sql("doc", TEXT_RULES[:2]) + "\nUNION ALL " + first_sql("doc", TEXT_RULES[2:]) + "\nUNION ALL " + perf_lines_sql("code")
    ),
    "q_multi": query(multi_sql("(SELECT * FROM code UNION ALL SELECT * FROM page)", PAGE_RULES)),
    "q_absent_within": query(absent_sql("code")),
    "q_loop": query(loop_sql("code")),
    "q_exports": query(exports_sql("code")),
    "q_exports_strict": query(exports_sql("code", strict=True)),
    "q_imports": query(imports_sql("code")),
    "q_unused_fn": query(unused_fn_sql("code")),
    "q_advisory": query(advisory_sql(), *DEPS),
    "q_fk": query(fk_sql("code")),
    "q_required": query(required_sql("code", "code")),
    "q_counterpart": query(counterpart_sql("code")),
    "q_lock": query(lock_sql(), *DEPS),
    "q_no_manifest": query(no_manifest_sql("code")),
    "q_manifest": query(manifest_sql(), *DEPS),
    "q_reqs": query("SELECT project, name, version, pos FROM reqs", *DEPS),
    "q_unpinned": query(unpinned_sql(), *DEPS),
    "q_tracked": query("SELECT project, name, version FROM tracked", *DEPS, TRACKED),
    "q_dups": query("SELECT fp, n, cross_project, file FROM groups", DOC_GROUPS),
    "q_dup_sites": query(
        "SELECT project, path, fp, n AS copies, cross_project FROM shaped JOIN groups USING (fp)", DOC_GROUPS
    ),
    "q_rules": query(
        "\nUNION ALL ".join(
            [multi_sql("scripts", R.N_PLUS_1_RULES), multi_sql("ruled", R.EXPENSIVE_RULES), *[absent_sql("ruled", i) for i in range(3)]]
        ),
        f"ruled AS ({RULES_SQL})",
        "scripts AS (SELECT * FROM ruled WHERE path LIKE '%.js')",
    ),
    "q_prefixes": query(prefix_sql("keyed"), f"keyed AS ({KEYS_SQL})"),
    "q_user_check": query(
        "SELECT " + row("'info'", "'long_lines'", "'Line of ' || CAST(length(text) AS VARCHAR) || ' characters'", line="line")
        + f" FROM ({lines_of('visible')}) WHERE path LIKE '%.ts' AND length(text) > 2000"
    ),
    "q_report": over_audit(
        """SELECT run_date, (SELECT count(*) FROM scanned) AS projects_scanned, n AS total, n AS n_findings,
  critical, warning, info FROM (
  SELECT '2024-01-02' AS run_date, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info
  FROM found WHERE "check" = 'security_scan'
  UNION ALL SELECT '2024-01-01', 0, 0, 0, 0)"""
    ),
    "q_stream": query(
        dups_sql("kept", "src/dup.py", "py") + "\nUNION ALL " + dups_sql("kept", "src/dup.js", "js"),
        "kept AS (SELECT * FROM code WHERE NOT (project LIKE '%3' AND path LIKE '%dup%'))",
    ),
    "q_dups_py": query(dups_sql("code", "src/dup.py", "py")),
    "q_dups_js": query(dups_sql("code", "src/dup.js", "js")),
    "q_sprawl": query(sprawl_sql("doc", LICENSE_PATTERN, 2)),
    "q_sprawl_global": query(sprawl_global_sql("code")),
    "q_sprawl_counts": query(
        f"SELECT project, count(*) AS n_files FROM code WHERE {matches('content', R.CLIENT_PATTERN)} GROUP BY project"
    ),
    "q_wrappers": query(wrappers_sql("code")),
    "q_wrapper_global": query(wrapper_global_sql("code")),
    "q_mismatch": PART_VERSIONS + mismatch_sql("v"),
    "q_mismatch_versions": PART_VERSIONS
    + "SELECT name, project, version FROM v WHERE name IN (SELECT name FROM v GROUP BY name HAVING count(DISTINCT version) > 1)",
    "q_stale": STALE_ORDERS,
    "q_stale_code": query(stale_sql("code")),
    "q_drift": DRIFT,
    "q_audit": over_audit("SELECT * FROM found"),
    "q_summary": over_audit(SUMMARY),
    "q_status": over_audit(
        "SELECT project, CASE WHEN total = 0 THEN 'CLEAN' WHEN critical > 0 THEN 'CRITICAL' WHEN warning > 0 THEN 'WARNINGS' "
        f"ELSE 'INFO' END AS status FROM ({SUMMARY})"
    ),
    "q_totals": over_audit(TOTALS),
    "q_check_counts": over_audit('SELECT project, "check", count(*) AS total FROM found WHERE project <> \'\' GROUP BY project, "check"'),
    "q_gate": over_audit("SELECT count(*) FILTER (severity = 'critical') > 0 AS failed FROM found"),
    "q_head": over_audit(
        'SELECT project, "check", rank, severity, file, message, greatest(n - 5, 0) AS more FROM (SELECT *, '
        'row_number() OVER (PARTITION BY project, "check" ORDER BY file, line, message, snippet, severity) AS rank, '
        'count(*) OVER (PARTITION BY project, "check") AS n FROM found WHERE project <> \'\') WHERE rank <= 5'
    ),
    "q_critical": over_audit(
        f"SELECT project, file, line, \"check\", message, greatest((SELECT n FROM {CRITICALS}) - 10, 0) AS more FROM ({TOP}10)"
    ),
    "q_alert": over_audit(ALERT),
    "q_digest": over_audit(DIGEST),
    "q_quarantine": QUARANTINE,
    "q_scan": f"SELECT project, path, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS digest "
    f"FROM ({TREE_SQL}) WHERE path NOT LIKE 'node\\_modules/%' ESCAPE '\\'",
}
