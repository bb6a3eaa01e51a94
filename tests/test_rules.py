"""Rule tables and their application."""

import re

import pytest
from pyspark.sql import functions as F

from lintlake.builtin.rules import RULES
from lintlake.functions.patterns import java_pattern
from lintlake.operators import rule_index, sast
from lintlake.operators import rules as R
from lintlake.schema import RULES as RULE_SCHEMA
from lintlake.sources.tables import builtin_rules, load_rules, read_packs
from lintlake.support import small_table

# rule -> (text with a hit, text without).
EXAMPLES = {
    "python-sql-injection": ('cursor.execute("select %s" "x" % a', "cursor.execute(q, (a,))"),
    "python-command-injection-os-system": ("os.system (c)", "os.systems(c)"),
    "python-command-injection-subprocess-shell": ("subprocess.run(a,\n shell = True)", "subprocess.run(a)"),
    "python-eval-usage": ("x = eval (y)", "medieval(y)"),
    "python-exec-usage": ("exec(y)", "myexec(y)"),
    "python-pickle-unsafe": ("pickle.load(f)", "pickle.dump(f)"),
    "python-path-traversal": ('open(base + name, "r")', 'open(name, "r")'),
    "python-weak-hash-md5": ("hashlib.md5 (b)", "hashlib.md4(b)"),
    "python-weak-hash-sha1": ("hashlib.sha1(b)", "hashlib.sha256(b)"),
    "python-weak-random": ("random.choice(a)", "secrets.choice(a)"),
    "python-flask-debug-true": ("app.run(port=1, debug = True)", "app.run(port=1)"),
    "python-django-debug-true": ("DEBUG = True", "DEBUG = False"),
    "python-yaml-unsafe-load": ("yaml.load(f)", "yaml.load(f, Loader=L)"),
    "javascript-xss-innerhtml": ("a.innerHTML = b", 'a.innerHTML="b"'),
    "javascript-xss-document-write": ("document.write(a)", "document.writeln(a)"),
    "javascript-xss-eval": ("eval(a)", "retrieval(a)"),
    "javascript-sql-injection": ("db.query(`select ${a} from t`)", "db.query(`select 1`)"),
    "javascript-command-injection": ("exec(`ls ${a}`)", "exec('ls')"),
    "javascript-weak-hash-md5": ("createHash('md5')", "createHash('sha256')"),
    "javascript-weak-random": ("Math.random()", "Math.round(a)"),
    "javascript-regex-dos": ("new RegExp('a+*')", "new RegExp('a+')"),
    "javascript-prototype-pollution": ("a.__proto__ = b", "a.__proto__.c"),
    "javascript-path-traversal": ("fs.readFile(req.query.a)", "fs.readFile(a)"),
    "javascript-cors-misconfiguration": ("'Access-Control-Allow-Origin', '*'", "'Access-Control-Allow-Origin', a"),
    "javascript-jwt-no-verify": ("jwt.decode(t)", "jwt.decode(t, k)"),
    "owasp-a01-injection-sql-py": ('execute(f"select {a}")', 'execute("select 1")'),
    "owasp-a01-injection-cmd-py": ('os.system(f"ls {a}", shell=True', 'os.system("ls")'),
    "owasp-a02-broken-auth-hardcoded-py": ('ApiKey = "abcdefgh"', 'apikey = "short"'),
    "owasp-a01-injection-sql-js": ("query(`a {b}`)", "query('a')"),
    "owasp-a03-xss-js": ("dangerouslySetInnerHTML", "innerHTML;"),
    "owasp-a05-security-misconfig-debug-py": ("DEBUG=True", "DEBUG=0"),
    "owasp-a07-auth-failure-weak-hash-py": ("hashlib.sha1(b)", "hashlib.sha1 (b)"),
    "owasp-a04-insecure-design-pickle-py": ("pickle.loads(b)", "pickle.loads (b)"),
    "owasp-a01-injection-sql-java": ('createStatement("a" + b + "c")', 'createStatement("a")'),
    "owasp-a02-broken-auth-hardcoded-java": ('Key = "abcdefgh"', 'key = abcdefgh'),
    "owasp-api-bola-py": ("objects.get(id=request.GET.get('id'))", "objects.get(id=1)"),
    "owasp-api-mass-assignment-js": ("User.create( req.body )", "User.create(a)"),
    "owasp-api-data-exposure-py": ("return jsonify( user.__dict__ )", "return jsonify(user.name)"),
    "owasp-api-no-rate-limit-py": ("@app.route('/login')\n@x\ndef f", "@app.route('/login')\n@limiter\ndef f"),
}


def _example_files(make_files):
    language = {r["id"]: r["language"] for r in RULES}
    rows = []
    for rule, (hit, miss) in EXAMPLES.items():
        rows += [(f"{rule}/hit", language[rule], f"é\n {hit}"), (f"{rule}/miss", language[rule], f"é\n {miss}")]
    return make_files(rows).coalesce(2)


def test_each_rule_hits_and_misses(spark, make_files):
    assert set(EXAMPLES) == {r["id"] for r in RULES}
    files = _example_files(make_files)
    got = {(r.file, r.rule_id) for r in sast.sast_findings(files, builtin_rules(spark)).collect()}
    for rule in EXAMPLES:
        assert (f"{rule}/hit", rule) in got, rule
        assert (f"{rule}/miss", rule) not in got, rule


def test_indexed_and_compiled_rules_agree(spark, make_files, monkeypatch):
    files = _example_files(make_files)
    rules = builtin_rules(spark)
    columns = ["id", "rule_id", "file", "line", "column", "message", "code_snippet", "severity", "cwe", "cvss",
               "remediations", "references", "context"]
    key = lambda r: (r.file, r.rule_id, r.line, r.column)
    found = lambda *a, **o: sorted(sast.sast_findings(files, *a, **o).select(columns).collect(), key=key)
    compiled, plain, indexed = found(), found(prefilter=False), found(rules)
    monkeypatch.setattr(rule_index, "BLOCK", 500)
    assert len(list(rule_index.rule_blocks(rules))) > 5
    assert compiled == plain == indexed == found(rules) and len(compiled) >= 39


def _rows(*patterns, language="python"):
    return [(f"r{i}", language, p, java_pattern(p)) for i, p in enumerate(patterns)]


def test_candidates_are_all_rules_that_can_match():
    texts = [
        "eval(x) os.system(y)", "EVAL(x)", "the K\u212aLMN \u017fecret", "", "abcabd ab", "password = 'x'", "ﬁ ıjk", "x" * 50 + "needle",
        "aws AWS Aws", "line1\nline2\n", "\u0130jk",
    ]
    patterns = [
        r"eval\(", r"(?i)eval\(", r"(?i)klmn", r"(?i)secret", r"ab[cd]ab", r"(abc|abd) ab", r"\w+ = '", r"needle$", r"(?i)ijk", r"^line2",
        r"[A-Z]{3}", r"(?i:aws) Aws", r"(?:foo)?bar|baz", r"(?i)(aws|eval)", r"aa?bc",
    ]
    index = rule_index.Index(_rows(*patterns) + _rows("eval", language="java"))
    for text in texts:
        found = index.candidates(text, "python")
        matching = [i for i, p in enumerate(patterns) if re.search(p, text, re.M | re.S)]
        assert set(matching) <= set(found), text
        assert all(i < len(patterns) for i in found)
    assert index.candidates("eval", "java") == [len(patterns)]
    assert index.candidates(None, "python") == index.candidates("eval", None) == []
    assert index.candidates("zzz", "python") == [4, 10, 14]


def test_thousands_of_rules_try_few_candidates(spark, make_files):
    rules = [dict(id=f"r{i}", name="n", description="d", severity="high", language="python", pattern=f"w{i}x+") for i in range(5000)]
    files = make_files([(f"{i}.py", "python", f"w{i}x w{i + 1}xx\nw{i}") for i in range(0, 5000, 50)])
    found = sast.sast_findings(files, load_rules(spark, rules))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "code" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    want = {(f"{i}.py", f"r{j}", 1) for i in range(0, 5000, 50) for j in (i, i + 1)}
    assert {(r.file, r.rule_id, r.line) for r in found.collect()} == want


def test_patterns_that_only_python_takes_are_rejected(spark, make_files):
    patterns = ["(?#c)a", r"\0x", r"[\b]x", "fine"]
    rules = [dict(id=p, name="n", description="d", severity="high", language="python", pattern=p) for p in patterns]
    good, bad = R.validate_rules(R.normalise_rules(builtin_rules(spark).limit(0).unionByName(load_table(spark, rules))))
    assert [r.id for r in good.collect()] == ["fine"]
    assert {(r.id, r.reason) for r in bad.collect()} == {(p, "pattern has a construct without a counterpart") for p in patterns[:3]}
    many = [dict(r, id=f"{r['id']}{i}") for i in range(80) for r in rules]
    found = sast.sast_findings(make_files([("a.py", "python", "fine a x")]), load_table(spark, many)).collect()
    assert {r.rule_id for r in found} == {f"fine{i}" for i in range(80)}


def load_table(spark, rules):
    return small_table(spark, map(R.with_defaults, rules), RULE_SCHEMA)


def test_findings_carry_rule_data(spark, make_files):
    files = make_files([("a.py", "python", "os.system(x)"), ("a.ts", "typescript", "eval(x)")])
    [row] = sast.sast_findings(files, builtin_rules(spark), "2024-01-01").collect()
    assert row.finding_type == "vulnerability" and row.status == "open" and row.severity_rank == 5
    assert row.cvss == 9.0 and row.cvss_vector.endswith("C:H/I:H/A:H")
    assert len(row.remediations) == 2 and row.context["rule_tags"] == "command-injection,os,shell"
    assert str(row.first_seen) == "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def own_rules():
    base = dict(name="n", description="d", severity="high", language="Python")
    return [
        dict(base, id="good", pattern="a+b", message_template="saw {match}"),
        dict(base, id="good", pattern="zz"),
        dict(base, id="empty", pattern="a*"),
        dict(base, id="broken", pattern="(a"),
        dict(base, id="grave", pattern="a", severity="grave"),
        dict(base, id="nameless", pattern="a", name=None),
        dict(base, id="off", pattern="a", enabled=False, tags=["X"], category="other"),
    ]


def test_validation_keeps_the_usable_rules(spark, own_rules):
    frame = R.normalise_rules(spark.createDataFrame(own_rules, load_rules(spark).schema))
    ok, bad = R.validate_rules(frame)
    assert sorted(r.id for r in ok.collect()) == ["good", "off"]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [
        ("broken", "pattern does not compile"), ("empty", "pattern can match nothing"), ("good", "duplicate id"),
        ("grave", "unknown severity"), ("nameless", "missing name"),
    ]


def test_own_rules_and_selection(spark, make_files, own_rules):
    rules = load_rules(spark, own_rules)
    files = make_files([("f", "python", "x aab a")])
    assert [r.message for r in sast.sast_findings(files, rules).collect()] == ["saw aab"]
    everything = R.set_enabled(rules, ["off"], True)
    assert sast.sast_findings(files, everything).count() == 4
    assert [r.id for r in R.filter_rules(everything, tags=["x"], categories=["OTHER"]).collect()] == ["off"]
    assert R.filter_rules(rules, languages=["PYTHON"], severities=["High"]).count() == 1


def test_rules_from_files(spark, own_rules, tmp_path):
    frame = spark.createDataFrame(own_rules, load_rules(spark).schema)
    frame.write.json(str(tmp_path / "rules.json"))
    frame.write.parquet(str(tmp_path / "rules"))
    pack = tmp_path / "pack.yaml"
    pack.write_text("rules:\n  - {id: y, name: n, description: d, pattern: 'q\\d', severity: low, language: go}\n")
    for source in ("rules.json", "rules"):
        assert sorted(r.id for r in load_rules(spark, str(tmp_path / source)).collect()) == ["good", "off"]
    [row] = load_rules(spark, str(pack)).collect()
    assert (row.id, row.severity, row.message_template, row.category) == ("y", "LOW", "d", "security")


def test_bad_packs_and_members_cost_themselves(spark, tmp_path):
    packs = {
        "a.yaml": "rules:\n  - {id: x, name: n, description: d, pattern: 'q', severity: low, language: go}\n  - nothing\n"
                  "  - {id: 3, name: n}\n  - {id: z, name: n, description: d, pattern: q, severity: low, language: go, tags: [1]}\n",
        "b.yaml": "rules: [", "c.yaml": "other: 1", "e.yaml": "rules: []",
        "d.yaml": '{"rules": [{"id": "j", "name": "n", "description": "d", "pattern": "q+", "severity": "HIGH", "language": "Go", "enabled": false}]}',
    }
    for name, text in packs.items():
        (tmp_path / name).write_text(text)
    rules, problems = read_packs(spark, str(tmp_path / "*.yaml"))
    assert {(r.id, r.language, r.enabled) for r in rules.collect()} == {("x", "go", True), ("j", "go", False)}
    assert {(r.pack.rsplit("/", 1)[1], r.problem) for r in problems.collect()} == {
        ("a.yaml", "rule 2: is no mapping"), ("a.yaml", "rule 3: id is of another type"), ("a.yaml", "rule 4: tags is of another type"),
        ("b.yaml", "cannot be read"), ("c.yaml", "has no list of rules"),
    }
    assert sorted(r.id for r in load_rules(spark, str(tmp_path / "*.yaml")).collect()) == ["j", "x"]


def test_large_rule_tables_are_not_compiled(spark, make_files):
    rules = spark.range(500).select(
        F.format_string("r%d", "id").alias("id"), F.lit("n").alias("name"), F.lit("d").alias("description"),
        F.format_string("w%dx", "id").alias("pattern"), F.lit("LOW").alias("severity"), F.lit("go").alias("language"),
    )
    files = make_files([("f", "go", "w3x w44x\nw499x w500x")])
    found = sast.sast_findings(files, load_rules(spark, rules))
    assert sorted((r.rule_id, r.line, r.column) for r in found.collect()) == [("r3", 1, 1), ("r44", 1, 5), ("r499", 2, 1)]
