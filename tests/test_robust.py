"""Odd inputs that must neither end a scan nor lose findings."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lintlake.builtin.rules import RULES
from lintlake.functions.versions import version_lt, version_matches
from lintlake.operators.duplicates import duplicate_blocks
from lintlake.operators.sast import sast_findings
from lintlake.plans.scan import scan
from lintlake.sources.tables import load_rules
from lintlake.streaming.incremental import run_available, scan_stream, stream_files
from lintlake.streaming.lifecycle import merge_lifecycle
from lintlake.support import checkpoint_root

NOW = "2024-01-01 00:00:00"


def _rule(id, pattern):
    return dict(id=id, name="n", description="d", severity="high", language="python", pattern=pattern)


def test_patterns_without_a_counterpart_are_left_out(spark, make_files):
    rules = [
        _rule("conditional", r"(a)?(?(1)b|c)x"), _rule("named", r"\N{BULLET}x"), _rule("ascii", r"(?a)\w+"), _rule("long", r"\U0001F600"),
        _rule("groups", r"(?P<a_b>x)(?P<ab>y)(?P=a_b)"),
    ]
    usable = load_rules(spark, rules)
    assert [r.id for r in usable.collect()] == ["groups"]
    found = scan(make_files([("a.py", "python", "xyx xyy")]), usable, now=NOW).collect()
    assert [(r.rule_id, r.column) for r in found] == [("groups", 1)]


def test_a_table_of_rules_that_was_not_validated_does_not_end_the_scan(spark, make_files):
    rules = load_rules(spark, [_rule("good", "abc")])
    bad = rules.withColumn("id", F.lit("bad")).withColumn("pattern", F.lit(r"(a)?(?(1)b|c)x"))
    found = scan(make_files([("a.py", "python", "abc")]), rules.union(bad), now=NOW).collect()
    assert [r.rule_id for r in found] == ["good"]


def test_the_case_of_a_language_is_of_no_account(spark, make_files):
    files = make_files([("a.py", "Python", "eval(x)"), ("b.py", "PYTHON", "eval(x)")])
    assert {r.file for r in scan(files, now=NOW, languages=("python",)).collect()} == {"a.py", "b.py"}
    assert sast_findings(files, load_rules(spark)).count() == 2


def test_many_rules_keep_extra_columns(spark, make_files):
    from lintlake.plans.scan import file_findings

    rules = load_rules(spark, [_rule(f"r{i}", f"word{i}x") for i in range(250)])
    files = make_files([("a.py", "python", "word7x word249x")]).withColumn("mtime", F.lit(5))
    found = file_findings(files, rules, keep=["mtime"]).collect()
    assert {(r.rule_id, r.mtime) for r in found} == {("r7", 5), ("r249", 5)}


def test_one_line_with_very_many_hits(spark, make_files):
    files = make_files([("a.py", "python", "eval(x);" * 20_000)])
    eval_rule = [r for r in RULES if r["id"] == "python-eval-usage"]
    found = sast_findings(files, load_rules(spark, eval_rule))
    row = found.agg(F.count("*"), F.min(F.length("code_snippet")), F.max("column")).first()
    assert tuple(row) == (20_000, 20_000 * 8 + 4, 19_999 * 8 + 1)


def test_blank_lines_are_no_duplicates(make_files):
    files = make_files([("a", "go", "\n" * 8), ("b", "go", "x\n\n\ny\nx\n\n\ny")])
    assert {(r.file, r.line) for r in duplicate_blocks(files, k=4).collect()} == {("b", 1), ("b", 5)}


@pytest.mark.parametrize(
    "low,high", [("1" * 38 + "1", "1" * 38 + "2"), ("9" * 39, "1" + "0" * 39), ("1.9", "1.10"), ("0001", "2"), ("1.0.0", "1.0.1"), ("1", "1.0.0.1")]
)
def test_versions_of_any_length(spark, low, high):
    [row] = spark.createDataFrame([(low, high)], "low string, high string").select(
        version_lt("low", "high"), version_lt("high", "low"), version_matches("low", F.concat(F.lit("<"), "high"))
    ).collect()
    assert tuple(row) == (True, False, True)


def test_findings_of_files_that_were_not_scanned_stay(spark):
    columns = "id string, file string, first_seen timestamp, last_seen timestamp, status string"
    then = "CAST('2023-01-01' AS TIMESTAMP)"
    rows = [("1", "a", "open"), ("2", "a", "in_progress"), ("3", "b", "open"), ("4", "b", "in_progress"), ("5", "b", "ignored")]
    previous = spark.createDataFrame(rows, "id string, file string, status string").selectExpr(
        "id", "file", f"{then} AS first_seen", f"{then} AS last_seen", "status"
    )
    current = spark.createDataFrame([("1", "a", None, None, "open")], columns)
    scanned = spark.createDataFrame([("a",), ("a",), ("c",)], "file string")
    merged = merge_lifecycle(previous, current, NOW, scanned)
    assert {(r.id, r.status, r.last_seen.year) for r in merged.collect()} == {
        ("1", "open", 2024), ("2", "fixed", 2023), ("3", "open", 2023), ("4", "in_progress", 2023), ("5", "ignored", 2023),
    }
    assert merged.columns == current.columns
    everything = {r.id: r.status for r in merge_lifecycle(previous, current, NOW).collect()}
    assert everything["3"] == "fixed"


def test_old_files_and_manifests_that_arrive_late(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    arrivals = [
        [("new.py", "eval(a)", 0)], [("old.py", "eval(b)", 3), ("older.py", "eval(c)", 30)], [("requirements.txt", "django==1.0", 400)],
    ]
    for files in arrivals:
        for name, text, days in files:
            (inbox / name).write_text(text)
            os.utime(inbox / name, (time.time() - days * 86_400,) * 2)
        run_available(scan_stream(stream_files(spark, str(inbox)), now=NOW), out, state)
    found = spark.read.parquet(out)
    assert {(os.path.basename(r.file), r.finding_type) for r in found.collect()} == {
        ("new.py", "vulnerability"), ("old.py", "vulnerability"), ("older.py", "vulnerability"), ("requirements.txt", "dependency"),
    }


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Cluster)
