"""The same queries in standard SQL, to check results against another engine.

Regexes are those of the engine's tables.  Where the other engine's regex
dialect has no equal (look-ahead, Unicode word edges), the SQL says so.
"""

from __future__ import annotations

from lintlake.builtin.rules import RULES, SECRET_RULES
from lintlake.builtin.tables import (
    ADVISORIES,
    CWE_REMEDIATION,
    DEFAULT_REMEDIATION,
    DEPENDENCY_LANGUAGES,
    LANGUAGE_OF_EXTENSION,
    SHEBANGS,
    SUPPORTED_LANGUAGES,
)
from lintlake.functions.severity import CVSS, RANK
from lintlake.plans.catalogue import CREDENTIAL, LINK
from lintlake.plans.views import CORPUS, MANY_ADVISORIES, MANY_RULES, PACKAGE_JSON, PART_RULES, REQUIREMENTS, as_sql

_NL = "chr(10)"


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TPL = f"tpl AS ({as_sql(CORPUS, 'documents')})"
DOCS = "docs AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS file, text AS code FROM documents)"
MANIFESTS = f"mfs AS ({as_sql(REQUIREMENTS, 'part')} UNION ALL {as_sql(PACKAGE_JSON, 'part')})"
SUPPORTED = "(" + ", ".join(map(_q, SUPPORTED_LANGUAGES)) + ")"
TPL_OK = f"tpl_ok AS (SELECT * FROM tpl WHERE language IN {SUPPORTED})"

# Look-ahead rules in equal terms: an assignment whose value does not start with
# a quote, and (absent from the data) a route line without a later limiter.
_NO_LOOKAHEAD = {
    "javascript-xss-innerhtml": r"""\.innerHTML\s*=(?:\s+|[^\s"'])""",
    "owasp-api-no-rate-limit-py": r"""@app\.route\(["'].*login.*["']\)\n.*\ndef""",
}
_RANKED = "CASE {0} " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in RANK.items()) + " END"


def rank(col: str) -> str:
    return _RANKED.format(col)


def _places(base: str, name: str = "m") -> list[str]:
    """CTEs giving line, column and text of every match of `pat` in `code`."""
    before = (
        "left(code, CAST(list_sum(list_transform(segs[1:i], lambda x: length(x))) AS BIGINT) + "
        "CAST(coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT))"
    )
    return [
        f"{name}_s AS (SELECT *, regexp_split_to_array(code, pat) AS segs, regexp_extract_all(code, pat) AS hits FROM ({base}))",
        f"{name}_i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_s WHERE len(hits) > 0)",
        f"{name}_b AS (SELECT *, {before} AS pre, hits[i] AS mtext FROM {name}_i)",
        f"""{name} AS (SELECT *, CAST(length(pre) - length(replace(pre, {_NL}, '')) + 1 AS INTEGER) AS line,
            CAST(length(list_last(string_split(pre, {_NL}))) + 1 AS INTEGER) AS col FROM {name}_b)""",
    ]


def _lines(base: str, name: str = "ln") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (a), unnest(range(1, len(a) + 1)) AS n, unnest(a) AS txt
        FROM (SELECT *, string_split(code, {_NL}) AS a FROM ({base})))"""


_RULE_ROWS = [
    (r["id"], r["language"], r["severity"], "(?ms)" + _NO_LOOKAHEAD.get(r["id"], r["pattern"]), r["cwe"], r["owasp"],
     r["category"]) for r in RULES
]
RULE_CTE = _values("rules", "rule_id, language, severity, pat, cwe, owasp, category", _RULE_ROWS)
_JOINED = "SELECT t.file, t.code, r.* FROM tpl t JOIN rules r ON t.language = r.language"
# The matched text of the look-ahead rule is shorter than its stand-in.
_SHOWN = r"CASE WHEN rule_id = 'javascript-xss-innerhtml' THEN regexp_extract(mtext, '\.innerHTML\s*=\s*') ELSE mtext END"
SAST = [TPL, RULE_CTE, *_places(_JOINED)]

_SECRET_ROWS = [(r["id"], r["severity"], "(?ms)" + r["pattern"]) for r in SECRET_RULES]
SECRET_CTE = _values("secret_rules", "rule_id, severity, pat", _SECRET_ROWS)


def _secrets(base: str) -> list[str]:
    return [SECRET_CTE, *_places(f"SELECT d.file, d.code, r.* FROM {base} d, secret_rules r", "sm")]


# The comment detectors.
_TODO_ROWS = [
    (0, r"(?i)#\s*(TODO|FIXME|HACK|XXX|BUG)[\s:](.*)"),
    (1, r"(?i)//\s*(TODO|FIXME|HACK|XXX|BUG)[\s:](.*)"),
    (2, r"(?i)/\*\s*(TODO|FIXME|HACK|XXX|BUG)[\s:](.*)"),
]
_COMMENTED_ROWS = [
    (0, r"#\s*(if |for |while |def |class |import |return |print)"),
    (1, r"//\s*(if |for |while |function |const |let |var |return)"),
]


def _todos(base: str) -> list[str]:
    kind = r"upper(regexp_extract(mtext, '(?i)(TODO|FIXME|HACK|XXX|BUG)[\s:]', 1))"
    said = r"trim(regexp_replace(mtext, '(?is)^(#|//|/\*)\s*(TODO|FIXME|HACK|XXX|BUG)[\s:]', ''))"
    return [
        _values("todo_pats", "style, pat", _TODO_ROWS),
        *_places(f"SELECT d.file, d.code, p.* FROM {base} d, todo_pats p", "tm"),
        f"""todo AS (SELECT file, line, CAST(1 AS INTEGER) AS col, concat('quality_todo_', lower({kind})) AS rule_id,
            CASE WHEN {kind} IN ('FIXME', 'BUG') THEN 'MEDIUM' ELSE 'LOW' END AS severity, style, i,
            concat({kind}, ' found: ', left({said}, 50)) AS message,
            trim(string_split(code, {_NL})[line]) AS snippet FROM tm)""",
    ]


def _commented(base: str) -> list[str]:
    return [
        _values("com_pats", "style, pat", _COMMENTED_ROWS),
        *_places(f"SELECT d.file, d.code, p.* FROM {base} d, com_pats p", "cm"),
        f"""commented AS (SELECT file, line, CAST(1 AS INTEGER) AS col, 'quality_commented_code' AS rule_id,
            'LOW' AS severity, style, i, trim(string_split(code, {_NL})[line]) AS snippet FROM cm)""",
    ]


def _long_lines(base: str, limit: int = 120, name: str = "longline") -> list[str]:
    return [
        _lines(f"SELECT file, code FROM {base}", f"{name}_l"),
        f"""{name} AS (SELECT file, CAST(n AS INTEGER) AS line, CAST({limit + 1} AS INTEGER) AS col,
            'quality_long_line' AS rule_id, 'INFO' AS severity,
            concat('Line too long (', length(txt), ' characters, maximum {limit})') AS message,
            CASE WHEN length(txt) > 100 THEN concat(left(txt, 100), '...') ELSE txt END AS snippet
            FROM {name}_l WHERE length(txt) > {limit})""",
    ]


# Word edges next to accented letters: other letters become `x`, other signs a blank.
def _ascii(col: str) -> str:
    blanked = rf"regexp_replace({col}, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]', ' ', 'g')"
    return rf"regexp_replace({blanked}, '[^\x00-\x7F]', 'x', 'g')"


# Headers and branch words.
_START = r"'^\s*(def|function|public|private|protected)\s+\S'"
_BRANCH = r"'\b(if|for|while|case|catch|elif|else)\b'"


def _complexity(base: str) -> list[str]:
    return [
        _lines(f"SELECT file, code FROM {base}", "cx_l"),
        f"cx_s AS (SELECT file, n, txt, CASE WHEN regexp_matches(txt, {_START}) THEN 1 ELSE 0 END AS st FROM cx_l)",
        "cx_g AS (SELECT *, sum(st) OVER (PARTITION BY file ORDER BY n) AS g FROM cx_s)",
        f"""cx_a AS (SELECT file, min(n) AS n, arg_min(txt, n) AS head,
            1 + sum(CASE WHEN st = 1 THEN 0 ELSE len(regexp_extract_all({_ascii("txt")}, {_BRANCH})) END) AS score
            FROM cx_g WHERE g > 0 GROUP BY file, g)""",
        """complexity AS (SELECT file, CAST(n AS INTEGER) AS line, CAST(1 AS INTEGER) AS col,
            'quality_high_complexity' AS rule_id, 'MEDIUM' AS severity,
            concat('High complexity in ''', split_part(trim(head), '(', 1), ''' (score ', CAST(score AS BIGINT),
                ', maximum 10)') AS message FROM cx_a WHERE score > 10)""",
    ]


# Function headers by language.
_HEADERS = r"""CASE language WHEN 'python' THEN '^\s*def\s+(\w+)\s*\(' WHEN 'javascript' THEN '^\s*function\s+(\w+)\s*\('
    WHEN 'java' THEN '^\s*(public|private|protected)?\s*(static)?\s*\w+\s+(\w+)\s*\(' END"""
_INDENT = r"length(regexp_extract({0}, '^\s*'))"


def _long_functions(base: str) -> list[str]:
    return [
        _lines(f"SELECT file, code, {_HEADERS} AS hd FROM {base} WHERE language IN ('python', 'javascript', 'java')", "lf_l"),
        "lf_s AS (SELECT file, n, txt, hd, CASE WHEN regexp_matches(txt, hd) THEN 1 ELSE 0 END AS st FROM lf_l)",
        "lf_g AS (SELECT *, sum(st) OVER (PARTITION BY file ORDER BY n) AS g, max(n) OVER (PARTITION BY file) AS total, "
        "sum(st) OVER (PARTITION BY file) AS heads FROM lf_s)",
        f"""lf_h AS (SELECT *, first_value(txt) OVER w AS head, first_value(n) OVER w AS head_n FROM lf_g WHERE g > 0
            WINDOW w AS (PARTITION BY file, g ORDER BY n))""",
        f"""lf_a AS (SELECT file, head_n, any_value(head) AS head, any_value(hd) AS hd,
            min(CASE WHEN st = 0 AND trim(txt) <> '' AND NOT starts_with(txt, '#')
                AND {_INDENT.format("txt")} <= {_INDENT.format("head")} THEN n END) AS closed,
            max(CASE WHEN g = heads THEN total END) AS to_end FROM lf_h GROUP BY file, head_n)""",
        """lf AS (SELECT file, head_n, regexp_extract(head, hd, 1) AS name,
            coalesce(closed - head_n, to_end - head_n + 1) AS len FROM lf_a)""",
        """longfunc AS (SELECT file, CAST(head_n AS INTEGER) AS line, CAST(1 AS INTEGER) AS col,
            'quality_long_function' AS rule_id, 'MEDIUM' AS severity,
            concat('Function ''', name, ''' too long (', len, ' lines, maximum 50)') AS message
            FROM lf WHERE len > 50 AND name <> '')""",
    ]


# All findings of the corpus, in arrival order.
_COLS = "file, line, col, rule_id, severity"
_SAST_ROWS = f"SELECT {_COLS}, 'vulnerability' AS finding_type, 0 AS a, 0 AS style, i FROM m"
_QUALITY_ROWS = " UNION ALL ".join(
    f"SELECT {_COLS}, 'quality' AS finding_type, 2 AS a, {order} FROM {name}"
    for name, order in (
        ("todo", "style, i"), ("longline", "0, 0"), ("longfunc", "0, 0"), ("commented", "style, i"), ("complexity", "0, 0"),
    )
)
QUALITY = [*_todos("tpl_ok"), *_long_lines("tpl_ok"), *_long_functions("tpl_ok"), *_commented("tpl_ok"), *_complexity("tpl_ok")]
BAG = [TPL, TPL_OK, RULE_CTE, *_places(_JOINED), *QUALITY]
_FIRST = "QUALIFY row_number() OVER (PARTITION BY file, line, rule_id ORDER BY a, style, i, col) = 1"
SCAN = [
    *BAG,
    *_secrets("tpl_ok"),
    f"""scan AS (SELECT * FROM ({_SAST_ROWS} UNION ALL {_QUALITY_ROWS} UNION ALL
        SELECT {_COLS}, 'secret' AS finding_type, 1 AS a, 0, i FROM sm) {_FIRST})""",
]

# Three versions of files over time, each scanned; what is in the last one of a file that is there is open.
_VERSIONS = f"""versions AS (SELECT 1 AS v, b.* FROM ({as_sql(CORPUS, 'documents')}) b
    UNION ALL BY NAME SELECT 2 AS v, * REPLACE (concat('x = eval(y)', {_NL}, code) AS code) FROM ({as_sql(CORPUS, 'documents')})
        WHERE doc_id % 5 = 1 AND doc_id % 3 <> 2
    UNION ALL BY NAME SELECT 3 AS v, * REPLACE (concat(code, {_NL}, 'z = eval(w)') AS code) FROM ({as_sql(CORPUS, 'documents')})
        WHERE doc_id % 5 = 2 AND doc_id % 4 <> 3)"""
TRACKED = [
    _VERSIONS,
    "tpl AS (SELECT doc_id, concat(CAST(v AS VARCHAR), '|', file) AS file, language, code FROM versions)",
    *[part for part in SCAN if part != TPL],
    "lasts AS (SELECT file, CASE WHEN any_value(doc_id) % 4 = 3 THEN 0 ELSE max(v) END AS last FROM versions GROUP BY file)",
    """seen AS (SELECT substr(file, 3) AS file, CAST(left(file, 1) AS INTEGER) AS v, line, col, rule_id, severity FROM scan)""",
]

_VERSION_KEY = r"""list_transform(string_split(regexp_replace({0}, '(\.0*)+$', ''), '.'),
    lambda p: CAST(concat('0', regexp_extract(p, '^[0-9]+')) AS BIGINT))"""
REQ = [
    MANIFESTS,
    _lines("SELECT file, code FROM mfs WHERE file LIKE '%requirements.txt'", "rq_l"),
    r"""req AS (SELECT file, lower(regexp_extract(trim(txt), '^([a-zA-Z0-9\-_]+)\s*([=><~!]+)\s*([0-9.]+)', 1)) AS name,
        regexp_extract(trim(txt), '^([a-zA-Z0-9\-_]+)\s*([=><~!]+)\s*([0-9.]+)', 3) AS version, 'python' AS language,
        regexp_extract(trim(txt), '^([a-zA-Z0-9\-_]+)\s*([=><~!]+)\s*([0-9.]+)', 2) AS operator,
        CAST(n AS INTEGER) AS line FROM rq_l
        WHERE regexp_matches(trim(txt), '^([a-zA-Z0-9\-_]+)\s*([=><~!]+)\s*([0-9.]+)'))""",
]
_JSON_KEYS = " UNION ALL ".join(
    f"SELECT file, unnest(json_keys(code::JSON, '$.{member}')) AS name, {order} AS o, '{member}' AS member, code FROM mfs "
    "WHERE file LIKE '%package.json'"
    for order, member in enumerate(("dependencies", "devDependencies"))
)
NPM = [
    f"npm_k AS ({_JSON_KEYS})",
    """npm AS (SELECT file, name, translate(json_extract_string(code::JSON, concat('$.', member, '."', name, '"')), '^~><=', '')
        AS version, 'javascript' AS language, CAST(1 AS INTEGER) AS line FROM npm_k
        QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY o DESC) = 1)""",
]
DEPS = [*REQ, *NPM, "deps AS (SELECT file, name, version, language, line FROM req UNION ALL SELECT * FROM npm)"]
ADV = _values("adv", "language, package, spec, cve, severity", ADVISORIES)
_KEYS_LT = f"{_VERSION_KEY.format('version')} < {_VERSION_KEY.format('substr(spec, 2)')}"


def _matched(condition: str) -> list[str]:
    return [
        *DEPS, ADV,
        f"""hit AS (SELECT d.*, a.cve, a.severity FROM deps d JOIN adv a ON d.language = a.language
            AND lower(d.name) = a.package WHERE {condition})""",
    ]


DEP_HITS = _matched(_KEYS_LT)
# The corpus without the texts of some files, and without files over 5,242 characters.
OBSERVED = [
    f"""whole AS (SELECT doc_id, file, language, CASE WHEN NOT ends_with(file, '7.py') THEN code END AS code
        FROM ({as_sql(CORPUS, 'documents')}))""",
    "tpl AS (SELECT * FROM whole WHERE length(code) <= 5242)",
    *[part for part in [*SCAN, *DEP_HITS] if part != TPL],
    """every AS (SELECT severity, finding_type FROM scan UNION ALL
        SELECT severity, 'dependency' FROM (SELECT DISTINCT file, line, cve, severity FROM hit))""",
    f"""counts AS (SELECT (SELECT count(*) FROM whole) + (SELECT count(*) FROM mfs) AS files,
        (SELECT count(*) FROM whole WHERE code IS NULL AND language IN {SUPPORTED}) AS unreadable,
        (SELECT count(*) FROM whole WHERE length(code) > 5242 AND language IN {SUPPORTED}) AS too_large)""",
]
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def _uuid(name: str) -> str:
    d = f"sha1(unhex('{NAMESPACE}') || encode({name}))"
    variant = f"translate(substr({d}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"concat(substr({d}, 1, 8), '-', substr({d}, 9, 4), '-5', substr({d}, 14, 3), '-', {variant}, "
        f"substr({d}, 18, 3), '-', substr({d}, 21, 12))"
    )


_RULE_TABLE = f"""prs AS (SELECT id, name, upper(severity) AS severity, lower(language) AS language, description, pattern,
    coalesce(description, description) AS message_template, enabled, category, tag FROM ({as_sql(PART_RULES, "part")}))"""
_REASON = """CASE WHEN description IS NULL THEN 'missing description'
    WHEN severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') THEN 'unknown severity'
    WHEN pattern = '(open' THEN 'pattern does not compile' WHEN pattern = 'x*' THEN 'pattern can match nothing' END"""
RULE_CHECK = [
    _RULE_TABLE,
    f"judged AS (SELECT *, {_REASON} AS own FROM prs)",
    """checked AS (SELECT *, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY own IS NOT NULL, name, pattern)
        > 1 THEN 'duplicate id' END) AS reason FROM judged)""",
]
_PATH = "regexp_replace(url, '[?#].*$', '')"
_SUFFIX = r"lower(regexp_extract(split_part({0}, '/', -1), '^.+(\.[^.]+)$', 1))"
EXT = _values("exts", "ext, lang", list(LANGUAGE_OF_EXTENSION.items()))
_SHEBANG = "CASE " + " ".join(f"WHEN starts_with(ltrim(first), {_q(p)}) THEN {_q(v)}" for p, v in SHEBANGS) + " END"
_PRIORITY = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM'
    WHEN '4' THEN 'LOW' ELSE 'INFO' END"""
_WEIGHTS = "sum(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 5 ELSE 0 END)"
_FILES = "greatest((SELECT count(*) FROM tpl), 1)"
_RISK = f"round(least(CAST({_WEIGHTS} AS DOUBLE) / {_FILES}, 100.0), 2)"


def _stats(source: str, counted: dict[str, str], distinct: dict[str, str]) -> str:
    parts = [
        f"SELECT '{stat}' AS stat, {key} AS key, count(*) AS findings FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"
        for stat, key in counted.items()
    ]
    parts += [f"SELECT '{stat}', NULL, count(DISTINCT {key}) FROM {source}" for stat, key in distinct.items()]
    parts.append(f"SELECT 'total', NULL, count(*) FROM {source}")
    return " UNION ALL ".join(parts)


_CVSS_ROWS = [(s, score, vector) for s, (score, vector) in CVSS.items()]
_SNIPPET = f"""(SELECT string_agg(concat(CASE WHEN k = line THEN '>>> ' ELSE '    ' END, string_split(code, {_NL})[k]), {_NL} ORDER BY k)
    FROM unnest(range(greatest(line - 2, 1), least(line + 2, len(string_split(code, {_NL}))) + 1)) AS u(k))"""
_PLACES = 'file, line, col AS "column", rule_id'
_CRED = "SELECT doc_id, text AS code, " + _q("(?ms)" + CREDENTIAL) + " AS pat FROM documents"
_IMPORTS = [
    ("python", "pickle", r"(?ms)^\s*import\s+pickle\b"),
    ("python", "pickle", r"(?ms)^\s*from\s+pickle\s+import\b"),
    ("python", "fs", r"(?ms)^\s*import\s+fs\b"),
    ("python", "fs", r"(?ms)^\s*from\s+fs\s+import\b"),
    ("python", "java.util", r"(?ms)^\s*import\s+java\.util\b"),
    ("python", "java.util", r"(?ms)^\s*from\s+java\.util\s+import\b"),
    ("java", "pickle", r"(?ms)^\s*import\s+pickle\b"),
    ("java", "fs", r"(?ms)^\s*import\s+fs\b"),
    ("java", "java.util", r"(?ms)^\s*import\s+java\.util\b"),
    *[
        ("javascript", name, pattern)
        for name, esc in (("pickle", "pickle"), ("fs", "fs"), ("java.util", r"java\.util"))
        for pattern in (
            rf"""(?ms)^\s*import\s+.*\s+from\s+['"]{esc}['"]""",
            rf"""(?ms)^\s*require\s*\(\s*['"]{esc}\s*['"]""",
        )
    ],
]
_LONG_BEFORE = _long_lines("docs", 120, "before")
_LONG_NOW = _long_lines("docs", 400, "now_long")
_SUMMARY = """SELECT 'severity' AS stat, severity AS key, count(*) AS findings FROM scan GROUP BY severity
    UNION ALL SELECT 'finding_type', finding_type, count(*) FROM scan GROUP BY finding_type
    UNION ALL SELECT 'total', NULL, count(*) FROM scan"""


def oracle_sql() -> dict[str, str]:
    squeezed = rf"trim(regexp_replace(txt, '\s+', ' ', 'g'))"
    cwe_rows = [(cwe, "|".join(texts)) for cwe, texts in CWE_REMEDIATION.items()]
    return {
        "credential_hits": _with(*_places(_CRED))
        + 'SELECT doc_id, line, col AS "column", mtext AS matched_text FROM m',
        "credential_hits_in_sql": _with(*_places(_CRED))
        + 'SELECT doc_id, line, col AS "column", mtext AS matched_text FROM m',
        "findings_in_sql": _with(*_places(
            "SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS file, text AS code, '(?ms)^[A-Z][a-z ]+[.]$' AS pat FROM documents"))
        + f"""SELECT file, line, col AS "column", {_uuid("concat(file, ':', CAST(line AS VARCHAR), ':sentence')")} AS id,
            {_SNIPPET} AS snippet, CAST(len(regexp_extract_all(mtext, '[a-z]+')) AS INTEGER) AS words FROM m""",
        "word_positions": _with(*_places(r"SELECT doc_id, text AS code, '(?ms)[a-z]\.\s+[A-Z]' AS pat FROM documents"))
        + 'SELECT doc_id, line, col AS "column", mtext AS matched_text FROM m',
        "pattern_count": "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?ims)the [a-z]+')) AS INTEGER) AS matches FROM documents",
        "has_pattern": """SELECT page_id, regexp_matches(html, '(?ms)class="ad".*</footer>') AS found FROM pages""",
        "match_line": _with(_lines("SELECT conv_id, turn, text AS code FROM conversations"))
        + r"SELECT conv_id, turn, CAST(n AS INTEGER) AS line_no, regexp_matches(txt, '^[A-Z][a-z]+ .*\.$') AS matched FROM ln",
        "capture_groups": f"""SELECT page_id, unnest(regexp_extract_all(html, {_q(LINK)}, 1)) AS g1,
            unnest(regexp_extract_all(html, {_q(LINK)}, 2)) AS g2 FROM pages""",
        "function_calls": _with(*_places(r"SELECT page_id, html AS code, '(?ms)\btrack\s*\(' AS pat FROM pages"))
        + 'SELECT page_id, line, col AS "column", mtext AS text FROM m',
        "imports": _with(TPL, _values("imp", "language, module, pat", _IMPORTS),
            *_places("SELECT t.file, t.code, i.module, i.pat FROM tpl t JOIN imp i ON t.language = i.language"))
        + 'SELECT file, module, line, col AS "column", mtext AS text FROM m',
        "line_and_column": f"""SELECT doc_id, CAST(length(pre) - length(replace(pre, {_NL}, '')) + 1 AS INTEGER) AS line,
            CAST(length(list_last(string_split(pre, {_NL}))) + 1 AS INTEGER) AS "column"
            FROM (SELECT doc_id, left(text, instr(text, ', ') - 1) AS pre FROM documents WHERE instr(text, ', ') > 0)""",
        "snippet_context": _with(*_places(_CRED)) + f"SELECT doc_id, line, {_SNIPPET} AS snippet FROM m",
        "finding_ids": f"""SELECT doc_id, {_uuid("concat(source, ':', CAST(n_chars AS VARCHAR), ':', lang)")} AS id FROM documents""",
        "message_templates": "SELECT doc_id, replace('found {match} ({match})', '{match}', lang) AS message FROM documents",
        "severity_scales": f"""SELECT o_orderkey, CAST({rank("s")} AS INTEGER) AS rank,
            CASE WHEN s IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END AS level
            FROM (SELECT o_orderkey, {_PRIORITY} AS s FROM orders)""",
        "decoded_text": f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest
            FROM (SELECT doc_id, concat('(', text, {_NL}) AS t FROM documents)""",
        "language_of_url": _with(EXT) + f"""SELECT page_id, suffix, coalesce(lang, 'unknown') AS language
            FROM (SELECT page_id, {_SUFFIX.format(_PATH)} AS suffix FROM pages) LEFT JOIN exts ON suffix = ext""",
        "language_by_first_line": f"""SELECT doc_id, coalesce({_SHEBANG}, 'unknown') AS language, {_SHEBANG} AS named
            FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '#!/usr/bin/env python3' WHEN 'fr' THEN '#!/bin/sh -e'
                WHEN 'de' THEN ' #!/usr/bin/env node' ELSE string_split(text, {_NL})[1] END AS first FROM documents)""",
        "extension_lookup": _with(EXT) + f"""SELECT page_id, lang AS language FROM
            (SELECT page_id, concat('.', lower(regexp_extract({_PATH}, '([A-Za-z0-9]+)$', 1))) AS e FROM pages)
            LEFT JOIN exts ON e = ext""",
        "files_by_language": _with(TPL) + "SELECT language, file FROM tpl WHERE language IN ('python', 'java', 'markdown')",
        "language_counts": _with(TPL) + "SELECT language, count(*) AS files FROM tpl GROUP BY language",
        "language_info": _with(TPL) + f"""SELECT language AS name,
            string_agg(DISTINCT {_SUFFIX.format("file")}, ' ' ORDER BY {_SUFFIX.format("file")}) AS extensions,
            language IN {SUPPORTED} AS supported,
            language IN ({", ".join(map(_q, DEPENDENCY_LANGUAGES))}) AS has_dependency_analysis FROM tpl GROUP BY language""",
        "exclude_paths": """SELECT page_id FROM pages WHERE NOT (url GLOB '**.html*' OR url GLOB '*/en/***'
            OR url GLOB '*utm_*=feed*' OR url GLOB '*[mw]ww.*')""",
        "size_limit": _with(DOCS) + "SELECT file FROM docs WHERE length(code) <= 2097",
        "supported_only": _with(TPL, TPL_OK) + "SELECT file, language FROM tpl_ok",
        "relative_paths": _with(TPL) + "SELECT doc_id, replace(file, 'src/', '') AS file FROM tpl",
        "rule_hits_by_rule": _with(*SAST) + "SELECT rule_id, severity, count(*) AS findings FROM m GROUP BY ALL",
        "sast_places": _with(*SAST) + f"SELECT {_PLACES}, {_SHOWN} AS matched_text FROM m",
        "sast_details": _with(*SAST) + f"""SELECT {_uuid("concat(file, ':', CAST(line AS VARCHAR), ':', rule_id)")} AS id,
            {_PLACES}, severity, CAST({rank("severity")} AS INTEGER) AS severity_rank, 'vulnerability' AS finding_type, cwe,
            owasp, category, 'open' AS status, {_SNIPPET} AS code_snippet FROM m""",
        "enrich_cvss": _with(*SAST, _values("scores", "sev, cvss, vector", _CVSS_ROWS))
        + f"""SELECT {_uuid("concat(file, ':', CAST(line AS VARCHAR), ':', rule_id)")} AS id, col AS "column", rule_id,
            CAST(cvss AS DOUBLE) AS cvss, vector AS cvss_vector FROM m LEFT JOIN scores ON severity = sev""",
        "own_rules": _with(DOCS, *_places("""SELECT d.file, d.code, concat('passage-', CAST(b.item_id AS VARCHAR)) AS rule_id,
            concat('(?ms)', b.text) AS pat FROM docs d, benchmark b"""))
        + f"SELECT {_PLACES}, 'A passage of the benchmark' AS message FROM m",
        "many_rules": _with(DOCS, f"many AS ({as_sql(MANY_RULES, 'part')})", *_places("""SELECT d.file, d.code, r.id AS rule_id, r.severity,
            concat('(?ms)', r.pattern) AS pat FROM docs d JOIN many r ON contains(lower(d.code), r.word)"""))
        + f"SELECT {_PLACES}, severity FROM m",
        "enrich_remediation": _with(_RULE_TABLE, _values("texts", "cwe, advice", cwe_rows)) + f"""SELECT name,
            coalesce(nullif(concat_ws('|', CASE WHEN enabled THEN nullif(description, '') END, advice), ''),
                {_q(DEFAULT_REMEDIATION)}) AS remediations
            FROM (SELECT *, concat('CWE-', CASE length(name) % 4 WHEN 0 THEN '89' WHEN 1 THEN '79' WHEN 2 THEN '22'
                ELSE '1' END) AS c FROM prs) LEFT JOIN texts ON c = cwe""",
        "rules_normalised": _with(_RULE_TABLE) + """SELECT id, name, severity, language, message_template, enabled, category,
            CAST(0 AS INTEGER) AS "references", replace(tag, ' ', ',') AS tags FROM prs""",
        "rules_valid": _with(*RULE_CHECK) + "SELECT id, name, severity, language FROM checked WHERE reason IS NULL",
        "rules_rejected": _with(*RULE_CHECK) + "SELECT id, name, reason FROM checked WHERE reason IS NOT NULL",
        "rules_filtered": _with(_RULE_TABLE) + """SELECT id, name FROM prs WHERE enabled AND language IN ('python', 'java')
            AND severity IN ('CRITICAL', 'LOW') AND category IN ('economy', 'promo')
            AND list_has_any(string_split(lower(tag), ' '), ['widget', 'cold'])""",
        "rules_of_language": _with(_RULE_TABLE) + "SELECT id, name FROM prs WHERE language = 'java'",
        "rules_switched": _with(_RULE_TABLE)
        + "SELECT id, name, enabled AND id NOT IN ('rule-1', 'rule-5', 'rule-8') AS enabled FROM prs",
        "rule_by_id": _with(_RULE_TABLE) + "SELECT id, name FROM prs WHERE id = 'rule-8'",
        "rule_stats": _with(_RULE_TABLE) + """SELECT 'language' AS stat, language AS key, count(*) AS rules FROM prs GROUP BY language
            UNION ALL SELECT 'severity', severity, count(*) FROM prs GROUP BY severity
            UNION ALL SELECT 'category', category, count(*) FROM prs GROUP BY category
            UNION ALL SELECT CASE WHEN enabled THEN 'enabled' ELSE 'disabled' END, NULL, count(*) FROM prs GROUP BY enabled
            UNION ALL SELECT 'total', NULL, count(*) FROM prs""",
        "todos": _with(TPL, *_todos("tpl")) + f"SELECT {_PLACES}, severity, message, snippet AS code_snippet FROM todo",
        "commented_code": _with(TPL, *_commented("tpl")) + f"SELECT {_PLACES}, snippet AS code_snippet FROM commented",
        "long_lines": _with(DOCS, *_long_lines("docs"))
        + f"SELECT {_PLACES}, message, snippet AS code_snippet FROM longline",
        "complexity": _with(TPL, *_complexity("tpl")) + f"SELECT {_PLACES}, message FROM complexity",
        "long_functions": _with(TPL, *_long_functions("tpl")) + f"SELECT {_PLACES}, message FROM longfunc",
        "quality_stats": _with(TPL, TPL_OK, *QUALITY, f"q AS ({_QUALITY_ROWS})")
        + _stats("q", {"rule": "rule_id"}, {"files_affected": "file"}),
        "secret_places": _with(DOCS, *_secrets("docs")) + f"""SELECT {_PLACES}, severity,
            trim(replace(string_split(code, {_NL})[line], mtext, concat(left(mtext, 4), '****'))) AS code_snippet FROM sm""",
        "duplicated_blocks": _with(DOCS, _lines("SELECT file, code FROM docs"),
            f"sq AS (SELECT file, n, {squeezed} AS t FROM ln)",
            f"""bl AS (SELECT file, n, concat(t, {_NL}, lead(t, 1) OVER w, {_NL}, lead(t, 2) OVER w) AS b, lead(t, 2) OVER w AS last
                FROM sq WINDOW w AS (PARTITION BY file ORDER BY n))""",
            f"cp AS (SELECT *, count(*) OVER (PARTITION BY b) AS copies FROM bl WHERE last IS NOT NULL AND replace(b, {_NL}, '') <> '')")
        + "SELECT file, CAST(n AS INTEGER) AS line, copies FROM cp WHERE copies > 1",
        "maximal_blocks": _with(DOCS, TPL, _lines("SELECT file, code FROM docs UNION ALL SELECT file, code FROM tpl"),
            f"sq AS (SELECT file, n, {squeezed} AS t FROM ln)",
            f"""bl AS (SELECT file, n, concat(t, {_NL}, lead(t, 1) OVER w, {_NL}, lead(t, 2) OVER w) AS b, lead(t, 2) OVER w AS last
                FROM sq WINDOW w AS (PARTITION BY file ORDER BY n))""",
            f"runs AS (SELECT file, n, b, count(*) OVER (PARTITION BY b) AS copies FROM bl WHERE last IS NOT NULL AND replace(b, {_NL}, '') <> '')",
            """nx AS (SELECT r.*, x.b AS nb, x.copies AS ncopies FROM runs r LEFT JOIN runs x ON x.file = r.file AND x.n = r.n + 1)""",
            "pr AS (SELECT *, count(*) OVER (PARTITION BY b, nb) AS pairs FROM nx)",
            "lk AS (SELECT *, nb IS NOT NULL AND pairs = copies AND copies = ncopies AS linked FROM pr WHERE copies > 1)",
            """bg AS (SELECT l.*, CASE WHEN p.linked THEN 0 ELSE 1 END AS begins
                FROM lk l LEFT JOIN lk p ON p.file = l.file AND p.n = l.n - 1)""",
            "gr AS (SELECT *, sum(begins) OVER (PARTITION BY file ORDER BY n) AS g FROM bg)")
        + """SELECT file, CAST(min(n) AS INTEGER) AS line, CAST(count(*) + 2 AS INTEGER) AS lines, any_value(copies) AS copies
            FROM gr GROUP BY file, g""",
        "manifests": _with(MANIFESTS) + "SELECT file, split_part(file, '/', -1) AS base_name FROM mfs",
        "requirements_parse": _with(*REQ) + "SELECT * FROM req",
        "package_json_parse": _with(MANIFESTS, *NPM) + "SELECT * FROM npm",
        "advisory_join": _with(*DEP_HITS) + "SELECT file, line, name, version, cve, severity FROM hit",
        "advisory_join_by_text": _with(*_matched("version < substr(spec, 2)"))
        + "SELECT file, line, name, version, cve, severity FROM hit",
        "many_advisories": _with(*DEPS, f"many AS ({as_sql(MANY_ADVISORIES, 'part')})",
            f"""ranges AS (SELECT *, {_VERSION_KEY.format("trim(regexp_replace(version_spec, '^(<=|==|<)', ''))")} AS bound
                FROM many WHERE version_spec <> '<latest')""",
            f"used AS (SELECT DISTINCT language, name, version, {_VERSION_KEY.format('version')} AS have FROM deps)")
        + """SELECT name, version, count(*) AS advisories, min(cve) AS first_cve, max(cve) AS last_cve
            FROM used u JOIN ranges r ON u.language = r.language AND lower(u.name) = lower(r.package)
            WHERE CASE WHEN version_spec LIKE '<=%' THEN have <= bound WHEN version_spec LIKE '<%' THEN have < bound
                ELSE have = bound END GROUP BY name, version""",
        "dependency_findings": _with(*DEP_HITS) + f"""SELECT file, line, CAST(1 AS INTEGER) AS "column",
            concat('dependency_', cve) AS rule_id, {_uuid("concat(file, ':', CAST(line AS VARCHAR), ':dep_', cve)")} AS id,
            severity, 'CWE-1035' AS cwe, 'A06:2021 - Vulnerable and Outdated Components' AS owasp, name AS package, cve,
            concat(name, '==', version) AS code_snippet FROM hit""",
        "dep_stats": _with(*DEP_HITS)
        + _stats("hit", {"severity": "severity", "cve": "cve"}, {"packages_affected": "name"}),
        "vulnerable_dependencies": _with(*DEP_HITS) + """SELECT file, line, name, version, string_agg(cve, ',' ORDER BY cve) AS cves
            FROM hit GROUP BY file, line, name, version""",
        "outdated": _with(*DEPS, f"keyed AS (SELECT *, {_VERSION_KEY.format('version')} AS k FROM deps)",
            """newest AS (SELECT language, name, version AS latest, k AS lk FROM keyed
                QUALIFY row_number() OVER (PARTITION BY language, name ORDER BY k DESC, version DESC) = 1)""")
        + """SELECT d.file, d.line, d.name, d.version, w.latest FROM keyed d JOIN newest w
            ON d.language = w.language AND d.name = w.name WHERE d.k < w.lk""",
        "scanned": _with(*SCAN) + f"SELECT {_PLACES}, severity, finding_type FROM scan",
        "scanned_project": _with(*SCAN, *DEP_HITS) + f"""SELECT {_PLACES}, severity, finding_type FROM scan UNION ALL
            SELECT DISTINCT file, line, CAST(1 AS INTEGER), concat('dependency_', cve), severity, 'dependency' FROM hit""",
        "observed_metrics": _with(*OBSERVED) + """SELECT count(*) AS total_findings,
            round(least(CAST(sum(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 5
                ELSE 0 END) AS DOUBLE) / any_value(files), 100.0), 2) AS risk_score,
            any_value(files) AS files_scanned, round(count(*) / CAST(any_value(files) AS DOUBLE), 2) AS findings_per_file,
            CAST(any_value(unreadable) AS INTEGER) AS errors, any_value(unreadable) AS unreadable, any_value(too_large) AS too_large,
            count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
            count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
            count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (finding_type = 'vulnerability') AS vulnerability,
            count(*) FILTER (finding_type = 'secret') AS secret, count(*) FILTER (finding_type = 'quality') AS quality,
            count(*) FILTER (finding_type = 'dependency') AS dependency FROM every, counts""",
        "csv_report": _with(*SCAN) + "SELECT rule_id, severity, finding_type, file, line FROM scan",
        "sarif_document": _with(*SCAN) + """SELECT rule_id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error'
            ELSE 'warning' END AS level, file AS uri, line AS start_line, col AS start_column FROM scan""",
        "lifecycle_in_scope": _with(DOCS, *_LONG_BEFORE, *_LONG_NOW,
            "scope AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS file FROM documents WHERE lang = 'en')",
            "cur AS (SELECT file, line, rule_id FROM now_long WHERE file IN (SELECT file FROM scope))",
            """prev AS (SELECT file, line, rule_id, ['open', 'ignored', 'false_positive', 'in_progress'][CAST(line % 4 AS INT) + 1]
                AS st FROM before)""")
        + """SELECT coalesce(c.file, p.file) AS file, coalesce(c.line, p.line) AS line, coalesce(c.rule_id, p.rule_id) AS rule_id,
            CASE WHEN p.st IS NULL THEN 'open' WHEN p.st IN ('ignored', 'false_positive') THEN p.st
                WHEN c.file IS NULL AND p.file NOT IN (SELECT file FROM scope) THEN p.st
                WHEN c.file IS NULL THEN 'fixed' ELSE p.st END AS status,
            CASE WHEN p.st IS NULL THEN '2024' ELSE '2023' END AS first_year,
            CASE WHEN c.file IS NULL THEN '2023' ELSE '2024' END AS last_year
            FROM prev p FULL OUTER JOIN cur c ON p.file = c.file AND p.line = c.line AND p.rule_id = c.rule_id""",
        "scanned_unique_files": _with(*SCAN) + f"SELECT {_PLACES}, severity, finding_type FROM scan",
        "severity_filter": _with(*SCAN)
        + f"SELECT {_PLACES}, severity FROM scan WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')",
        "by_severity": _with(*SCAN) + f"SELECT {_PLACES} FROM scan WHERE severity = 'HIGH'",
        "by_type": _with(*SCAN) + f"SELECT {_PLACES} FROM scan WHERE finding_type = 'vulnerability'",
        "has_critical": _with(*SCAN) + "SELECT coalesce(bool_or(severity = 'CRITICAL'), false) AS has_critical FROM scan",
        "union_all": _with(*BAG) + f"SELECT {_PLACES}, finding_type FROM ({_SAST_ROWS} UNION ALL {_QUALITY_ROWS})",
        "dedup": _with(*BAG) + f"SELECT {_PLACES} FROM (SELECT * FROM ({_SAST_ROWS} UNION ALL {_QUALITY_ROWS}) {_FIRST})",
        "ordered": _with(*SCAN)
        + f"SELECT {_PLACES}, severity FROM scan ORDER BY {rank('severity')} DESC, file, line, rule_id, col",
        "count_by_severity": _with(*SCAN) + "SELECT severity, count(*) AS findings FROM scan GROUP BY severity",
        "count_by_type": _with(*SCAN) + "SELECT finding_type, count(*) AS findings FROM scan GROUP BY finding_type",
        "risk_score": _with(*SCAN) + f"SELECT {_RISK} AS risk_score FROM scan",
        "run_metrics": _with(*SCAN) + f"""SELECT count(*) AS total_findings, {_RISK} AS risk_score,
            CAST({_FILES} AS BIGINT) AS files_scanned, round(count(*) / CAST({_FILES} AS DOUBLE), 2) AS findings_per_file,
            CAST(0 AS INTEGER) AS errors, count(*) FILTER (severity = 'CRITICAL') AS critical,
            count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
            count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info,
            count(*) FILTER (finding_type = 'vulnerability') AS vulnerability,
            count(*) FILTER (finding_type = 'secret') AS secret,
            count(*) FILTER (finding_type = 'quality') AS quality FROM scan""",
        "summary": _with(*SCAN) + _SUMMARY,
        "vuln_stats": _with(*SAST) + _stats("m", {"severity": "severity", "cwe": "cwe", "owasp": "owasp", "category": "category"},
            {"files_affected": "file"}),
        "merged_vuln_stats": _with(*SAST) + _stats("m", {"severity": "severity", "cwe": "cwe", "owasp": "owasp", "category": "category"},
            {"files_affected": "file"}),
        "sarif_results": _with(*SCAN) + """SELECT rule_id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error'
            ELSE 'warning' END AS level, file AS uri, line AS start_line, col AS start_column FROM scan""",
        "sarif_rules": _with(*SCAN) + """SELECT rule_id, file, line FROM scan
            QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY file, line, col) = 1""",
        "text_lines": _with(*SCAN) + "SELECT concat('[', severity, '] ', rule_id, ' - ', file, ':', line) AS short_text FROM scan",
        "written_report": _with(*SCAN) + "SELECT rule_id, severity, file, line FROM scan",
        "lifecycle": _with(DOCS, *_LONG_BEFORE, *_LONG_NOW, *_secrets("docs"),
            "cur AS (SELECT file, line, rule_id FROM now_long UNION SELECT file, line, rule_id FROM sm)",
            """prev AS (SELECT file, line, rule_id, ['open', 'ignored', 'false_positive', 'in_progress'][CAST(line % 4 AS INT) + 1]
                AS st FROM before)""")
        + """SELECT coalesce(c.file, p.file) AS file, coalesce(c.line, p.line) AS line, coalesce(c.rule_id, p.rule_id) AS rule_id,
            CASE WHEN p.st IS NULL THEN 'open' WHEN p.st IN ('ignored', 'false_positive') THEN p.st
                WHEN c.file IS NULL THEN 'fixed' ELSE p.st END AS status,
            CASE WHEN p.st IS NULL THEN '2024' ELSE '2023' END AS first_year,
            CASE WHEN c.file IS NULL THEN '2023' ELSE '2024' END AS last_year
            FROM prev p FULL OUTER JOIN cur c ON p.file = c.file AND p.line = c.line AND p.rule_id = c.rule_id""",
        **_streaming(),
    }


def _streaming() -> dict[str, str]:
    """The documents as Python files, once as findings and once as their ids."""
    rows = f"SELECT file, line, col, rule_id, severity, 0 AS a, 0 AS style, i FROM m UNION ALL SELECT {_COLS}, 1, 0, i FROM sm"
    base = [
        "pydocs AS (SELECT file, code, 'python' AS language FROM docs)",
        RULE_CTE,
        *_places("SELECT t.file, t.code, r.* FROM pydocs t JOIN rules r ON t.language = r.language"),
        *_todos("pydocs"), *_long_lines("pydocs"), *_long_functions("pydocs"), *_commented("pydocs"),
        *_complexity("pydocs"), *_secrets("pydocs"),
        f"found AS (SELECT * FROM ({rows} UNION ALL {_QUALITY_ROWS.replace("'quality' AS finding_type, ", "")}) {_FIRST})",
    ]
    name = "concat(file, ':', CAST(line AS VARCHAR), ':', regexp_replace(rule_id, '^quality_', ''))"
    return {
        "tracked_files": _with(*TRACKED) + """SELECT s.file, line, arg_max(col, v) AS "column", rule_id,
            CASE WHEN max(v) = any_value(last) THEN 'open' ELSE 'fixed' END AS status, any_value(severity) AS severity
            FROM seen s JOIN lasts l ON s.file = l.file GROUP BY s.file, line, rule_id""",
        "incremental": _with(DOCS, *base) + "SELECT rule_id, severity, count(*) AS findings FROM found GROUP BY ALL",
        "streamed_sightings": _with(DOCS, *base) + f"SELECT DISTINCT {_uuid(name)} AS id, true AS once FROM found",
    }
