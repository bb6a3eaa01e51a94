"""Reading trees and operators on file tables."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from lintlake.functions.language import language_of
from lintlake.operators import files as P
from lintlake.sources.files import decode_text, read_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    texts = {
        "a.py": b"a = 1", "pkg/b.py": b"eval(x)", "pkg/m.py": b"\xef\xbb\xbfx\r\ny\rz\xff\xc3(", "pkg/sp ace.js": b"x", "pkg/empty.py": b"",
        "__init__.py": b"x", ".github/ci.yml": b"a: b", "tests/deep/t.ts": b"let a", "UPPER.JS": b"x", "script": b"#!/bin/sh\nls", "big.py": b"x" * 50_000,
    }
    for name, content in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root, texts


def test_tree_scan(spark, tree):
    root, texts = tree
    rows = {r.file.removeprefix(f"{root}/"): r for r in read_files(spark, str(root), max_mb=0.01).collect()}
    passed_over = {"pkg/empty.py", "__init__.py", ".github/ci.yml"}
    assert set(rows) == set(texts) - {"UPPER.JS", "script", "big.py"} - passed_over
    assert rows["pkg/m.py"].code == "\ufeffx\ny\nz("
    assert rows["pkg/b.py"].language == "python" and rows["pkg/b.py"].size == 7
    assert rows["tests/deep/t.ts"].mtime is not None


def test_single_files_bypass_the_suffix_filter(spark, tree):
    root, _ = tree
    assert read_files(spark, f"{root}/script").first().language == "shell"
    assert read_files(spark, f"{root}/UPPER.JS").first().language == "javascript"
    assert read_files(spark, f"{root}/pkg/b.py").first().code == "eval(x)"


def test_size_limit_reaches_the_scan(spark, tree):
    frame = read_files(spark, str(tree[0]))
    assert "LessThanOrEqual(length" in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("raw", [b"", b"a\r\r\nb", b"ok \xe2\x82", "é\ufffd".encode(), b"\xff\xef\xbf\xbd\xed\xa0\x80", b"\xf0\x9f\x98\x80\x80"])
def test_decoding_is_tolerant(spark, raw):
    expected = raw.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
    frame = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert decode_text(frame).first().code == expected


def test_exclusion_is_a_glob_anywhere(spark):
    paths = ["a/latest/x.py", "a/x.min.js", "a/x.minXjs", "src/b.py", "node_modules/c.js", "A/TEST/y.py", "é/dist/\n.js"]
    frame = spark.createDataFrame([(p,) for p in paths], "file string")
    patterns = ["test/**", "*.min.js", "node_modules/**", "dist/**"]
    kept = [r.file for r in P.exclude_paths(frame, patterns).collect()]
    assert kept == [p for p in paths if not any(fnmatch.fnmatchcase(p, f"*{x}*") for x in patterns)]
    assert "src/b.py" in kept and "a/latest/x.py" not in kept


def test_language_of(spark):
    rows = [
        ("a/b.PY", "#!/bin/sh", "python"), ("run", " #!/usr/bin/env node x\n", "javascript"), ("run", "x\n#!/bin/sh", "unknown"),
        ("a.d/run", "", "unknown"), (".py", "", "unknown"), ("x.tar.rs", "", "rust"), ("x.", "#!/usr/bin/perl", "perl"),
    ]
    frame = spark.createDataFrame(rows, "file string, code string, expected string")
    assert [r.l for r in frame.select(language_of("file", "code").alias("l")).collect()] == [r[2] for r in rows]


def test_size_and_support(make_files):
    files = make_files([("a", "Python", "x" * 1048577), ("b", "go", "é" * 1048576), ("c", "yaml", "")])
    assert sorted(r.file for r in P.limit_size(files, 1).collect()) == ["b", "c"]
    assert sorted(r.file for r in P.supported_only(files).collect()) == ["a", "b"]
    assert [r.file for r in P.files_by_language(files, ["go"]).collect()] == ["b"]
    assert P.relative_paths(files, "a").filter(F.col("file") == "").count() == 1
