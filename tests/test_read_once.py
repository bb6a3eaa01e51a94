"""Tables that are folders, and scans that work on each text once."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import rollups as A
from lintlake.operators.dependencies import match_advisories
from lintlake.operators.sast import sast_findings
from lintlake.plans.catalogue import queries
from lintlake.plans.scan import scan
from lintlake.sources import sinks
from lintlake.sources.tables import load_rules

NOW = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents as a folder of three files."""
    top = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"x{i} = eval(a)\n# TODO: {i}\n" + "long " * 30, "en", "s", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    return top


def test_incremental_reads_a_table_that_is_a_folder(spark, folder):
    got = {(r.rule_id, r.findings) for r in queries()["incremental"](spark, folder).collect()}
    assert {("python-eval-usage", 9), ("quality_todo_todo", 9), ("quality_long_line", 9)} <= got


def test_streamed_sightings_read_a_table_that_is_a_folder(spark, folder):
    rows = queries()["streamed_sightings"](spark, folder).collect()
    assert len(rows) >= 27 and all(r.once for r in rows)


def _counting(spark, reads):
    files = spark.createDataFrame(
        [("a.py", "python", "a = eval(x)"), ("requirements.txt", "unknown", "django==1.0")], "file string, language string, code string"
    )

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return files.mapInArrow(counted, files.schema)


def test_a_rollup_of_few_columns_makes_hits_once(spark):
    reads = spark.sparkContext.accumulator(0)
    found = scan(_counting(spark, reads), severity="INFO", order=False, now=NOW)
    assert {r.finding_type for r in A.count_by(found, "finding_type").collect()} == {"vulnerability", "dependency"}
    assert reads.value == 2


def test_sarif_of_a_scan_makes_hits_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    sinks.write_sarif(scan(_counting(spark, reads), severity="INFO", order=False, now=NOW), str(tmp_path / "log"))
    assert reads.value == 2


def test_unique_files_are_matched_once(spark):
    """Beside the manifests, no text meets the patterns a second time."""
    files = spark.createDataFrame(
        [("a.py", "python", "a = eval(x)"), ("requirements.txt", "unknown", "django==1.0")], "file string, language string, code string"
    )
    found = scan(files, severity="INFO", order=False, unique_files=True, now=NOW)
    assert {r.finding_type for r in A.count_by(found, "finding_type").collect()} == {"vulnerability", "dependency"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The projection of the marks, once.
    assert plan.count("AS _marks#") == 1


def test_a_text_is_searched_once_for_a_pattern_of_many_rules(spark):
    """Rules that share a pattern each have their findings, in order; the plan locates distinct patterns."""
    rows = [(f"r{i}", f"n{i}", "d", "b+" if i % 2 else "[ab]c", "HIGH", "unknown") for i in range(6)]
    rules = spark.createDataFrame(rows, "id string, name string, description string, pattern string, severity string, language string")
    files = spark.createDataFrame([("x", "unknown", "abb\n bcé b"), ("y", "unknown", "zz")], "file string, language string, code string")
    found = sast_findings(files, load_rules(spark, rules), NOW)
    got = sorted((r.rule_id, r.line, r.column) for r in found.collect())
    odd, even = [(1, 2), (2, 2), (2, 6)], [(2, 2)]
    assert got == sorted((f"r{i}", *at) for i in range(6) for at in (odd if i % 2 else even))
    assert "array_distinct" in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_advisories_hold_the_pairs(spark):
    deps = spark.createDataFrame([("python", "a", f"1.{i}") for i in range(9)], "language string, name string, version string")
    spec = F.when(F.col("id") % 3 == 0, F.concat(F.lit("=="), F.col("v"))).otherwise(F.concat(F.lit("<"), F.col("v")))
    known = spark.range(700).withColumn("v", F.expr("concat('1.', id % 12)")).select(
        F.lit("python").alias("language"), F.lit("A").alias("package"), spec.alias("version_spec"),
        F.concat(F.lit("CVE-"), "id").alias("cve"), F.lit("HIGH").alias("severity"),
    )
    pairs = match_advisories(deps, known)
    lists = match_advisories(deps, known, lists=True).select("*", F.explode("found").alias("f"))
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(pairs) == rows(lists.select(*deps.columns, "f.version_spec", "f.cve", "f.severity")) and pairs.count() > 700
