"""Engine tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"
_Q = "chr(34)"


def _lines(*lines: str) -> str:
    """A SQL text of fixed lines; `~` stands for a double quote."""
    parts: list[str] = []
    for line in lines:
        pieces = line.split("~")
        for i, piece in enumerate(pieces):
            parts += [f"'{piece}'"] + ([_Q] if i < len(pieces) - 1 else [])
        parts.append(_NL)
    return f"concat({', '.join(parts)})"


# (suffix, language, text in front of the document), chosen by doc_id % 12.  The
# expressions are valid in Spark and in standard SQL.
TEMPLATES = [
    (".py", "python", _lines("os.system(cmd)", "import pickle", "obj = pickle.loads(data)")),
    (".py", "python", _lines("a = eval(x) + eval(y)", "import os")),
    (".py", "python", _lines("h = hashlib.md5(data)", "DEBUG = True")),
    (".js", "javascript", _lines("document.write(a)", "var r = Math.random()", "x.__proto__ = y")),
    (".js", "javascript", _lines("import fs from ~fs~", "x.innerHTML = y")),
    (".java", "java", _lines("import java.util.List;", "password = ~abcdefgh1~")),
    (".py", "python", _lines("# TODO: a", "# FIXME: b", "// hack c")),
    (".js", "javascript", _lines("// return x", "# if y")),
    (
        ".py",
        "python",
        f"concat('def f(x):', {_NL}, repeat(concat('    if x: pass', {_NL}), CAST(5 + doc_id % 20 AS INT)))",
    ),
    (
        ".py",
        "python",
        f"concat('def g(x):', {_NL}, repeat(concat('    y = 1', {_NL}), CAST(40 + doc_id % 25 AS INT)), 'z = 0', {_NL})",
    ),
    (".ts", "typescript", _lines("eval(a)", "document.write(b)")),
    (".md", "markdown", _lines("some words")),
]


def _pick(values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE CAST(doc_id % {len(values)} AS INT) {cases} END"


CORPUS = {
    "doc_id": "doc_id",
    "file": f"""concat('src/', source, '/f', CAST(doc_id AS VARCHAR(20)), {_pick([f"'{t[0]}'" for t in TEMPLATES])})""",
    "language": _pick([f"'{t[1]}'" for t in TEMPLATES]),
    "code": f"concat({_pick([t[2] for t in TEMPLATES])}, text)",
}


def _num(expression: str) -> str:
    return f"CAST(CAST({expression} AS BIGINT) AS VARCHAR(20))"


def _json(text: str) -> str:
    """A SQL text with `~` for double quotes and `<...>` for numbers."""
    parts = []
    for piece in text.replace(">", "<").split("<"):
        parts.append(_num(piece) if len(parts) % 2 else f"replace('{piece}', '~', {_Q})")
    return f"concat({', '.join(parts)})"


# One requirements.txt and one package.json per part.
REQUIREMENTS = {
    "file": f"concat('repo', {_num('p_partkey')}, '/requirements.txt')",
    "code": f"""concat('django==', {_num("p_size % 5")}, '.', {_num("p_partkey % 30")}, '.', {_num("p_partkey % 40")},
        {_NL}, 'Flask >= ', {_num("p_size % 3")}, '.0.0', {_NL}, '# pinned', {_NL},
        'requests==2.', {_num("p_partkey % 40")}, '.0', {_NL})""",
}
PACKAGE_JSON = {
    "file": f"concat('repo', {_num('p_partkey')}, '/package.json')",
    "code": f"""concat({_json("{~dependencies~: {~lodash~: ~^4.<p_partkey % 20>.<p_size>~, ~axios~: ~^0.")},
        {_json("<p_partkey % 30>.1~}, ~devDependencies~: {")},
        CASE WHEN p_partkey % 2 = 0 THEN {_json("~lodash~: ~4.<p_partkey % 25>.0~")} ELSE '' END, '}}}}')""",
}

# A rule table of any size: one rule per part, some of them unusable.
PART_RULES = {
    "id": f"concat('rule-', {_num('p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END')})",
    "name": f"concat(p_name, ' ', {_num('p_partkey')})",
    "description": "CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE p_type END",
    "pattern": "CASE WHEN p_size % 11 = 5 THEN '(open' WHEN p_size % 11 = 6 THEN 'x*' ELSE p_brand END",
    "severity": """CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'MEDIUM'
        WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'fatal' END""",
    "language": "CASE p_partkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'java' ELSE 'javascript' END",
    "enabled": "p_partkey % 5 <> 0",
    "category": "lower(p_type)",
    "tag": "p_name",
}


# A usable rule for every part: a word of three syllables, chosen by the key, in one of four kinds of patterns.
_SYLLABLES = "er on th in re ea nd st ha es or nt ed an at is he en ou le".split()


def _syllable(place: str) -> str:
    return f"CASE {place} % {len(_SYLLABLES)} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SYLLABLES)) + " END"


MANY_WORD = f"concat({_syllable('p_partkey')}, {_syllable('p_size')}, {_syllable('CAST(floor(p_partkey / 20.0) AS BIGINT)')})"
MANY_RULES = {
    "id": f"concat('many-', {_num('p_partkey')})",
    "name": "p_name",
    "description": "p_type",
    "word": MANY_WORD,
    "pattern": f"""CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN {MANY_WORD} WHEN 1 THEN concat({MANY_WORD}, '[a-z]+')
        WHEN 2 THEN concat('(?i)', {MANY_WORD}, 's?') ELSE concat('[A-Z][a-z]*', {MANY_WORD}, '[.]') END""",
    "severity": "CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END",
    "language": "'unknown'",
}


# An advisory for every part, of three packages, with ranges of all kinds.
_BOUND = f"concat({_num('p_size % 6')}, '.', {_num('p_partkey % 30')}, '.', {_num('p_partkey % 7')})"
MANY_ADVISORIES = {
    "language": "'python'",
    "package": "CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'Django' WHEN 1 THEN 'flask' ELSE 'requests' END",
    "version_spec": f"""CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN concat('<', {_BOUND}) WHEN 1 THEN concat('<=', {_BOUND})
        WHEN 2 THEN concat('== ', {_BOUND}) WHEN 3 THEN {_BOUND} ELSE '<latest' END""",
    "cve": f"concat('CVE-', {_num('p_partkey')})",
    "severity": "'HIGH'",
}


def as_sql(columns: dict[str, str], name: str) -> str:
    """The derived table as a query on a given table."""
    return "SELECT " + ", ".join(f"{e} AS {a}" for a, e in columns.items()) + f" FROM {name}"


def _select(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    return table.selectExpr(*[f"{e} AS {a}" for a, e in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, language, code): the documents as source files."""
    return _select(table(spark, sf_dir, "documents"), CORPUS)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, code): the manifests of the parts."""
    part = table(spark, sf_dir, "part")
    return _select(part, REQUIREMENTS).unionByName(_select(part, PACKAGE_JSON))


def many_part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "part"), MANY_RULES).drop("word")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _select(table(spark, sf_dir, "part"), PART_RULES)
    return raw.selectExpr("*", "split(tag, ' ') AS tags").drop("tag")
