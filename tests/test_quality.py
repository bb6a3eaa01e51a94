"""Quality detectors against a plain restatement of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.operators import quality as Q
from lintlake.operators.findings import dedup

LINES = [
    "def f(x):", "    def g(y):", "function h(z) {", "public static void m(", "  private int n(", "public void", "int k(a)",
    "    if a: for b", "        while c else", "", "   ", "# note", "  # note", "x = 1", "    y = 2", "return f(", "else if (b) (",
    "# TODO: one", "# todo two", "// FIXME", "/* HACK: x */ # BUG: y", "//if a", "# import os", "é = 'if' # XXX:\tend ",
]

def _texts(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 30)):
            lines += [rng.choice(LINES)] * rng.choice([1, 1, 1, 2, 12])
        rows.append((f"f{i}", ["python", "javascript", "java", "go"][i % 4], "\n".join(lines)))
    return rows


def _comments(code, patterns, flags=0):
    return [
        (code[: m.start()].count("\n") + 1, m) for p in patterns for m in re.finditer(p, code, flags)
    ]


@pytest.fixture(scope="module")
def sample(make_files):
    rows = _texts(160)
    return rows, make_files(rows).coalesce(2).cache()


def _got(frame, *columns):
    result = {}
    for r in frame.select("file", *columns).collect():
        result.setdefault(r["file"], []).append(tuple(r)[1:])
    return result


# (text, {line: score} over 2), worked out by hand.
COMPLEX = [
    ("def f(x):\n    if a:\n        for b in c:\n            pass\nx = 1", {1: 3}),
    ("def f(x):\n    if a: pass\n", {}),
    ("function h(z) {\n  if (a) {} else if (b) {} else {}\n}", {1: 5}),
    ("x\npublic void m() {\n  switch (x) { case 1: case 2: }\n}\nprivate int n() {\n  while (c) {}\n}", {2: 3}),
    ("if a: pass\nfor b in c: pass\nwhile d: pass", {}),
    ("def f():\n  # if for while\ndef g():\n  iffy = forward", {1: 4}),
    ("", {}),
]


def test_complexity(make_files):
    files = make_files([(str(i), "python", code) for i, (code, _) in enumerate(COMPLEX)])
    score = F.regexp_extract("message", r"score (\d+)", 1).cast("int")
    got = _got(Q.high_complexity(files, 2), "line", score)
    assert {int(f): dict(v) for f, v in got.items()} == {i: e for i, (_, e) in enumerate(COMPLEX) if e}


# (language, text, {line: lines} over 3), worked out by hand.
LONG = [
    ("python", "def f():\n    a\n    b\n    c\nd", {1: 4}),
    ("python", "def f():\n    a\n    b\nd\n    e", {}),
    ("python", "def f():\n    a\n    b\n    c", {1: 4}),
    ("python", "def f():\n    a\n\n# note\n    b\n    c\nd", {1: 6}),
    ("python", "def f():\n    a\n    b\n    c\n    def g():\n        d", {}),
    ("javascript", "x\n  function h(z) {\n    a\n    b\n    c\n    d\n  }\ny", {2: 5}),
    ("java", "public static void m(\n  a\n  b\n  c\n}", {1: 4}),
    ("go", "def f():\n    a\n    b\n    c\nd", {}),
]


def test_long_functions(make_files):
    files = make_files([(str(i), language, code) for i, (language, code, _) in enumerate(LONG)])
    size = F.regexp_extract("message", r"\((\d+) lines", 1).cast("int")
    got = _got(Q.long_functions(files, max_lines=3), "line", size)
    assert {int(f): dict(v) for f, v in got.items()} == {i: e for i, (_, _, e) in enumerate(LONG) if e}


def test_todos_and_commented_code(sample):
    rows, files = sample
    # The comment styles and the beginnings of code.
    styles = [rf"{o}\s*(TODO|FIXME|HACK|XXX|BUG)[\s:](.*)" for o in ("#", "//", r"/\*")]
    got = _got(Q.todos(files), "line", "rule_id", "message")
    for file, _, code in rows:
        expected = [
            (n, f"quality_todo_{m[1].lower()}", f"{m[1].upper()} found: {m[2].strip()[:50]}")
            for n, m in _comments(code, styles, re.I)
        ]
        assert sorted(got.get(file, [])) == sorted(expected)
    starts = [
        r"#\s*(if |for |while |def |class |import |return |print)",
        r"//\s*(if |for |while |function |const |let |var |return)",
    ]
    got = _got(Q.commented_code(files), "line")
    for file, _, code in rows:
        assert sorted(got.get(file, [])) == sorted((n,) for n, _ in _comments(code, starts))


def test_todo_text_can_be_the_next_line(make_files):
    files = make_files([("a", "python", "# TODO\nnext one\n# TODO: b // TODO: c")])
    assert {(r.line, r.message) for r in Q.todos(files).collect()} == {
        (1, "TODO found: next one"), (3, "TODO found: b // TODO: c"), (3, "TODO found: c"),
    }
    # The first comment style arrives first, whatever the texts are.
    assert {(r.line, r.message) for r in dedup(Q.todos(files)).collect()} == {
        (1, "TODO found: next one"), (3, "TODO found: b // TODO: c"),
    }


def test_long_lines(make_files):
    files = make_files([("a", "python", "x" * 120 + "\n" + "é" * 121), ("b", "go", "")])
    [row] = Q.long_lines(files).collect()
    assert (row.line, row.column, row.code_snippet) == (2, 121, "é" * 100 + "...")
    assert row.severity == "INFO" and "121" in row.message
