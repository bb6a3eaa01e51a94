"""Manifests, versions and advisories."""

import random

import pytest

from lintlake.functions.versions import clean_version, version_matches
from lintlake.operators import dependencies as D
from lintlake.sources.tables import builtin_advisories


@pytest.fixture(scope="module")
def manifests(spark):
    rows = [
        ("p/requirements-dev.txt", "  Django == 2.1 # x\nflask>=2.0.0\nreq[extra]==1\nA.b==1\n\nrequests~=2.4.0"),
        ("p/Pipfile", "x==1"),
        ("p/package.json", '{"dependencies": {"lodash": "^4.2.0", "a": "1"}, "devDependencies": {"Lodash": "1", "a": "~2"}}'),
        ("q/package.json", "not json"),
        ("q/sub/x.csproj", ""),
        ("q/sub/go.mod", ""),
        ("q/readme.txt", ""),
    ]
    return spark.createDataFrame(rows, "file string, code string")


def test_discovery(manifests):
    assert D.manifests(manifests).count() == 6
    assert sorted(r.file for r in D.manifests(manifests, root="q").collect()) == ["q/package.json", "q/sub/x.csproj"]


def test_parsing(manifests):
    found = D.manifests(manifests)
    rows = D.requirements_deps(found).collect()
    assert {(r.name, r.operator, r.version, r.line) for r in rows} == {
        ("django", "==", "2.1", 1), ("flask", ">=", "2.0.0", 2), ("requests", "~=", "2.4.0", 6), ("x", "==", "1", 1),
    }
    rows = D.package_json_deps(found).collect()
    assert {(r.name, r.version, r.line) for r in rows} == {("lodash", "4.2.0", 1), ("Lodash", "1", 1), ("a", "2", 1)}


@pytest.mark.parametrize(
    "version, spec, semantic, string",
    [
        ("2.4.0", "<2.31.0", True, False),
        ("2.31", "<2.31.0", False, True),
        ("2.31.0", "<=2.31", True, True),
        ("2.31.0", "==2.31", True, False),
        ("1.10", "1.10", True, True),
        ("*", "<9", False, True),
        ("1.0-beta", "<1.0.1", True, True),
        ("20240101000000000000", "<20240101000000000001", True, True),
    ],
)
def test_version_ranges(spark, version, spec, semantic, string):
    frame = spark.createDataFrame([(version, spec)], "v string, s string")
    row = frame.select(version_matches("v", "s").alias("a"), version_matches("v", "s", "string").alias("b")).first()
    assert (row["a"], row["b"]) == (semantic, string)


def test_clean_version(spark):
    assert spark.createDataFrame([("^>=1.~2",)], "v string").select(clean_version("v")).first()[0] == "1.2"


def test_findings_and_vulnerability_lists(spark, manifests):
    deps = D.dependencies(D.manifests(manifests))
    advisories = builtin_advisories(spark)
    found = D.dependency_findings(D.match_advisories(deps, advisories)).collect()
    assert {(r.package, r.cve) for r in found} == {
        ("django", "CVE-2022-34265"), ("django", "CVE-2022-28346"), ("requests", "CVE-2023-32681"),
        ("lodash", "CVE-2021-23337"), ("Lodash", "CVE-2021-23337"),
    }
    listed = D.vulnerabilities_of(deps, advisories)
    assert listed.count() == deps.count()
    assert {r.name: r.vulnerabilities for r in D.with_vulnerabilities(listed).collect()}["django"] == [
        "CVE-2022-28346",
        "CVE-2022-34265",
    ]


def test_small_advisories_are_broadcast(spark, manifests):
    plan = D.match_advisories(D.dependencies(D.manifests(manifests)), builtin_advisories(spark))
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["semantic", "string"])
def test_many_ranges_of_one_package(spark, mode):
    rng = random.Random(3)
    version = lambda: ".".join(str(rng.randint(0, 12)) for _ in range(rng.randint(1, 3)))
    specs = [rng.choice(["<", "<=", "==", "== ", "", "< "]) + version() for _ in range(1500)] + ["<latest", "", "<", "==", "1.0", "1.0"]
    advisories = spark.createDataFrame(
        [("python", rng.choice(["P", "p"]), spec, f"CVE-{i}", "HIGH") for i, spec in enumerate(specs)]
        + [("java", "p", "<99", "CVE-java", "LOW"), ("python", "q", "<99", "CVE-q", "LOW")],
        "language string, package string, version_spec string, cve string, severity string",
    )
    used = [version() for _ in range(150)] + ["1.0", "1.0", "v1.0", "latest", "", None, "13"]
    deps = spark.createDataFrame([(i, "p", v, "python") for i, v in enumerate(used)], "line int, name string, version string, language string")
    found = {(r.line, r.cve) for r in D.match_advisories(deps, advisories, mode).collect()}
    known = advisories.filter("language = 'python' AND lower(package) = 'p'")
    want = deps.crossJoin(known.drop("language", "package")).filter(version_matches("version", "version_spec", mode))
    assert found == {(r.line, r.cve) for r in want.collect()} and len(found) > 10_000


def test_very_many_advisories_make_no_rows_that_do_not_match(spark):
    advisories = spark.range(100_000).selectExpr("'python' AS language", "'p' AS package", "concat('<1.', id) AS version_spec",
                                                 "concat('CVE-', id) AS cve", "'LOW' AS severity")
    deps = spark.range(200).selectExpr("'python' AS language", "'p' AS name", "concat('1.', 100000 - id % 20) AS version", "CAST(id AS INT) AS line")
    found = D.match_advisories(deps, advisories)
    assert found.count() == 10 * sum(max(0, i - 1) for i in range(20))
