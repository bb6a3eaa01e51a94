"""Rule tables in which very many rules share their patterns."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintlake.functions import matching as M
from lintlake.functions.patterns import begins_with_literal, java_pattern, portable
from lintlake.operators import rule_index, rules, sast
from lintlake.operators.sast import sast_findings
from lintlake.sources.tables import load_rules

NOW = "2024-01-01 00:00:00"
COLUMNS = "id string, name string, description string, pattern string, severity string, language string"
TEXTS = [
    "abcabcABC\n\nxabcs abc.\nAbc.abc.", "\n\nabc", "KKiss kiſs kıss KİSS", "\U0001f600abc \U0001f600\nabcd\U0001f600abc", "abababab", "",
    "İabc ABC Σabc", "line one\r\nabc abc", "a+b [x] a+b", None,
]
PATTERNS = [
    "abc", "abc[a-z]+", "(?i)abcs?", "[A-Z][a-z]*bc[.]", "(?i)kiss", "(?i)ABC", "abab", "(?:abc|abd){2}", "[^a]bc", "a.*?c", "a[+]b", r"\[x\]", "(abc)+", "ab(c|C)",
    r"\babc\b", r"abc\s", "^abc", "abc$", "(?i)[a-c]bc", "(?i)kıss", "(?=abc)abc", "abc(?i:d)?", "ab++c", r"(abc)\1",
]


def _files(spark):
    rows = [(f"f{i}", "unknown", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "file string, language string, code string")


def test_a_pattern_is_tried_once_whatever_number_of_rules_have_it(spark, monkeypatch):
    table = spark.createDataFrame([(f"r{i}", "n", "d", "abc" if i % 2 else "(?i)abcs?", "HIGH", "unknown") for i in range(50)], COLUMNS)
    tried = []
    monkeypatch.setattr(sast, "rule_blocks", lambda rules: [tried.extend(b) or b for b in rule_index.rule_blocks(rules)])
    found = sast_findings(_files(spark), load_rules(spark, table), NOW).groupBy("rule_id").count().collect()
    assert sorted(r.pattern for r in tried) == ["(?i)abcs?", "abc"]
    plain = sum(len(re.findall("abc", t or "")) for t in TEXTS)
    folded = sum(len(re.findall("(?i)abcs?", t or "")) for t in TEXTS)
    assert {r.rule_id: r["count"] for r in found} == {f"r{i}": plain if i % 2 else folded for i in range(50)}


def test_matches_are_those_of_the_jvm(spark):
    table = spark.createDataFrame([(f"r{i}", "n", "d", p, "HIGH", "unknown") for i, p in enumerate(PATTERNS)], COLUMNS)
    files = _files(spark)
    found = sast_findings(files, load_rules(spark, table), NOW)
    got = sorted((r.rule_id, r.file, r.line, r.column, r.seq, r.text) for r in found.withColumn("text", F.col("context")["matched_text"]).collect())
    places = F.array(*[F.struct(F.lit(f"r{i}").alias("rule_id"), M.find_matches("code", p).alias("found")) for i, p in enumerate(PATTERNS)])
    want = files.select("file", F.inline(places)).select("file", "rule_id", F.posexplode("found").alias("seq", "m"))
    assert got == sorted((r.rule_id, r.file, r.m.line, r.m.column, r.seq, r.m.text) for r in want.collect())
    assert len({r[0] for r in got}) > 20


def test_rules_with_one_id_and_rules_without_language(spark):
    """A table that was not validated: every rule has its hits, and what is known of its id."""
    rows = [("a", "n1", "d", "abc", "HIGH", "unknown"), ("a", "n2", "d", "abcd", "LOW", "unknown"), ("b", "n", "d", "abc", "LOW", None), (None, "n", "d", "abc", "LOW", "unknown")]
    full = rules.normalise_rules(spark.createDataFrame(rows, COLUMNS))
    files = spark.createDataFrame([("f", "unknown", "abcd"), ("g", None, "abc")], "file string, language string, code string")
    got = sorted((r.file, r.rule_id, r.severity) for r in sast_findings(files, full, NOW).collect())
    assert got == [("f", "a", "HIGH"), ("f", "a", "HIGH"), ("f", "a", "LOW"), ("f", "a", "LOW"), ("g", "b", "LOW")]


def test_many_hits_come_in_parts(spark):
    files = spark.createDataFrame([(f"f{i}", "unknown", "abc\n" * 30_000) for i in range(9)], "file string, language string, code string").coalesce(1)
    table = spark.createDataFrame([("r", "n", "d", "abc", "HIGH", "unknown")], COLUMNS)
    found = sast_findings(files, load_rules(spark, table), NOW)
    rows = found.groupBy("file").agg(F.countDistinct("line").alias("lines"), F.max("line").alias("last"), F.max("column").alias("column")).collect()
    assert sorted(tuple(r) for r in rows) == [(f"f{i}", 30_000, 30_000, 1) for i in range(9)]


def test_what_is_portable():
    assert [p for p in PATTERNS if not portable(p)] == PATTERNS[14:]
    assert not any(map(portable, ["a*", r"\d\d\d", "(?x)a b", "(a*b*)+c", "(?i)ä", "a|", "("]))
    assert [p for p in PATTERNS[:14] if begins_with_literal(p)] == ["abc", "abc[a-z]+", "(?i)abcs?", "(?i)kiss", "(?i)ABC", "abab", "a[+]b", r"\[x\]"]


def test_letters_without_case_are_those_of_the_jvm(spark):
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000)]))
    letters = "abcdefghijklmnopqrstuvwxyz"
    row = spark.createDataFrame([(every,)], "t string").select(
        *[F.regexp_extract_all("t", F.lit(java_pattern(f"(?i){c}")), F.lit(0)).alias(c) for c in letters]
    ).first()
    for c in letters:
        assert row[c] == re.findall(f"(?i){c}", every)


def test_a_worker_looks_at_a_pattern_once(monkeypatch):
    seen = []
    monkeypatch.setattr(rules, "_problem", lambda pattern: seen.append(pattern))
    names = [f"only here {i}" for i in range(3)]
    found = rules._translated.func(pd.Series(names * 100 + [None]))
    assert seen == [*names, None] or seen == names
    assert found["java"].tolist() == [java_pattern(n) for n in names] * 100 + [None]
    rules._judged.cache_clear()
