"""Positions against Python's own regex engine."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lintlake.builtin.rules import RULES, SECRET_RULES
from lintlake.functions import matching as M
from lintlake.functions.identity import finding_id
from lintlake.functions.patterns import contains_sql, java_pattern, matches_empty, required_literals

PIECES = [
    "eval (", "eval(", "\n", "\n\n", "é", "ß", "x ", "open(a + b)", "os.system(c)", '"', "\t", " ", "(", ")", "{", "}",
    'PassWord = "abcdefgh1"', "toKen='12345678'", "query(`", "`", "${", "pickle.loads(", "yaml.load(f)", "DEBUG = True",
    "__proto__ [", "new RegExp(x+*", "import a\n", "def login():\n", "@app.route('/login')\n", " ", " ", "\r",
]


def _random_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def _expected(pattern, code, flags=re.M | re.S):
    found = []
    for m in re.finditer(pattern, code, flags):
        before = code[: m.start()]
        found.append((before.count("\n") + 1, m.start() - before.rfind("\n"), m.group(0)))
    return found


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(_random_texts(150) + ["", "eval(", "a eval(" * 700 + "\n" + "eval(" * 300]))
    frame = spark.createDataFrame(rows, "i int, code string").coalesce(2).cache()
    return rows, frame


def test_every_builtin_pattern_matches_like_python(texts):
    rows, frame = texts
    patterns = [r["pattern"] for r in RULES + SECRET_RULES]
    hits = 0
    for start in range(0, len(patterns), 9):
        part = patterns[start : start + 9]
        columns = [M.find_matches("code", p).alias(f"m{k}") for k, p in enumerate(part)]
        got = {r["i"]: r for r in frame.select("i", *columns).collect()}
        for i, code in rows:
            for k, p in enumerate(part):
                assert [tuple(m) for m in got[i][f"m{k}"]] == _expected(p, code), p
                hits += len(got[i][f"m{k}"])
    assert hits > 1000


@pytest.mark.parametrize("pattern", [r"\n+", r"a|\n", r"[({]", r"(?P<a_b>eval)\s*\((?P=a_b)?"])
def test_other_patterns(texts, pattern):
    rows, frame = texts
    got = {r["i"]: r["m"] for r in frame.select("i", M.find_matches("code", pattern).alias("m")).collect()}
    assert all([tuple(m) for m in got[i]] == _expected(pattern, code) for i, code in rows)


def test_options_and_column_arguments(texts):
    rows, frame = texts
    got = frame.select(
        "i",
        M.find_matches("code", r"PASSWORD.*", case_sensitive=False, multiline=False).alias("folded"),
        M.find_matches(F.col("code"), F.lit(java_pattern(r"eval\("))).alias("as_columns"),
        M.count_matches("code", "EVAL", case_sensitive=False).alias("n"),
        M.extract_groups("code", r"(\w+)\.(\w+)\(").alias("groups"),
        M.extract_groups("code", r"eval").alias("no_groups"),
    ).collect()
    for row in got:
        code = rows[row["i"]][1]
        assert [tuple(m) for m in row["folded"]] == _expected("PASSWORD.*", code, re.I)
        assert [tuple(m) for m in row["as_columns"]] == _expected(r"eval\(", code)
        assert row["n"] == len(re.findall("EVAL", code, re.I))
        assert [tuple(g) for g in row["groups"]] == re.findall(r"(\w+)\.(\w+)\(", code)
        assert row["no_groups"] == []


def test_calls_and_imports(spark):
    code = "\n\n  import os\nfrom os import path\nx = os(1); os  (2)\nosx(3)\n"
    js = "import a from 'fs'\nrequire('fs')\nx = require('fs')\n"
    frame = spark.createDataFrame([(code, "python"), (js, "javascript"), (js, "go")], "code string, language string")
    rows = frame.select(
        M.function_calls("code", "os").alias("calls"),
        M.imports("code", "os", "language").alias("os"),
        M.imports("code", "fs", F.col("language")).alias("fs"),
    ).collect()
    assert [(m.line, m.column) for m in rows[0]["calls"]] == [(5, 5), (5, 12)]
    # Leading blank lines belong to the match.
    assert [(m.line, m.column) for m in rows[0]["os"]] == [(1, 1), (4, 1)]
    assert [(m.line, m.text) for m in rows[1]["fs"]] == [(1, "import a from 'fs'"), (2, "require('fs'")]
    assert rows[2]["fs"] == []


def test_snippet_marks_the_line(spark):
    frame = spark.createDataFrame([("a\nb\nc\nd\ne\nf",)], "code string").withColumn("ls", F.split("code", "\n"))
    row = frame.select(
        M.snippet("ls", F.lit(1)).alias("first"), M.snippet("ls", F.lit(3)).alias("mid"), M.snippet("ls", F.lit(6)).alias("last")
    ).first()
    assert row["first"] == ">>> a\n    b\n    c"
    assert row["mid"] == "    a\n    b\n>>> c\n    d\n    e"
    assert row["last"] == "    d\n    e\n>>> f"


def test_finding_id_is_a_name_based_uuid(spark):
    rows = [("src/é.py", 3, "rule"), ("", 1, "x:y")]
    frame = spark.createDataFrame(rows, "file string, line int, seed string")
    got = [r[0] for r in frame.select(finding_id("file", F.col("line"), "seed")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{f}:{n}:{s}")) for f, n, s in rows]


def test_prefilter_never_loses_a_match(texts):
    rows, frame = texts
    for pattern in ["(?i)(password|token)=?", r"os\.system|(?:pickle|yaml)\.load"]:
        test = contains_sql("code", pattern)
        assert test
        kept = {r["i"] for r in frame.filter(test).select("i").collect()}
        assert {i for i, code in rows if re.search(pattern, code)} <= kept


def test_required_literals():
    assert required_literals(r"\beval\s*\(") == ["eval"]
    assert required_literals(r"a|bcd") == []
    assert required_literals(r"(?:abc)?def+") == []
    assert matches_empty("x*") and not matches_empty("x+")
