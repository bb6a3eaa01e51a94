"""Security rules applied to files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lintlake.builtin.tables import CWE_REMEDIATION, DEFAULT_REMEDIATION
from lintlake.functions.matching import locate_sql, strip_sql
from lintlake.functions.patterns import contains_sql, java_pattern
from lintlake.functions.sqltext import chain, let, quote
from lintlake.operators.hits import (
    NO_HITS,
    SAST,
    explode_hits,
    findings_of,
    first_per_line_sql,
    hit_sql,
    info_table,
    union_hits,
)
from lintlake.operators.rule_index import matching_sql, rule_blocks, tried
from lintlake.operators.rules import builtin_rule_rows
from lintlake.support import spread

# Name of the column with the text in lower case; patterns that ignore case share it.
FOLDED = "_folded"

# A mark says that a pattern occurs in a text: the analyzer and rule it belongs
# to, its place in the arrival order, and the pattern to locate it with.
MARKS = "ARRAY<STRUCT<analyzer: INT, id: STRING, rank: INT, pattern: STRING>>"
NO_MARKS = f"CAST(array() AS {MARKS})"

# Marks with this id find their rule in the matched text.
TODO = "quality_todo"


def with_folded(texts: DataFrame) -> DataFrame:
    return texts.withColumn(FOLDED, F.lower("code"))


def occurs_sql(code: str, pattern: str, prefilter: bool = True) -> str:
    """Whether a pattern occurs: a plain search for its fixed text, then the regex."""
    found = f"{code} RLIKE {quote(java_pattern(pattern))}"
    possible = contains_sql(code, pattern, FOLDED) if prefilter else None
    return f"{possible} AND {found}" if possible else found


def mark_sql(analyzer: int, rule_id: str, java: str, rank: int = 0) -> str:
    return (
        f"named_struct('analyzer', {analyzer}, 'id', {quote(rule_id)}, 'rank', {rank}, 'pattern', {quote(java)})"
    )


def marks_sql(tests: list[tuple[str, str]]) -> str:
    """The marks whose condition holds, from (condition, mark) pairs."""
    if not tests:
        return NO_MARKS
    return "array_compact(array(" + ", ".join(f"IF({c}, {m}, NULL)" for c, m in tests) + "))"


def pattern_marks_sql(code: str, rules: list, analyzer: int, prefilter: bool = True) -> str:
    return marks_sql(
        [
            (occurs_sql(code, r["pattern"], prefilter), mark_sql(analyzer, r["id"], java_pattern(r["pattern"])))
            for r in rules
        ]
    )


def rule_marks_sql(code: str, language: str, rules: list, prefilter: bool = True) -> str:
    """Marks of the rules of the file's language."""
    cases = []
    for name in sorted({r["language"] for r in rules}):
        own = [r for r in rules if r["language"] == name]
        cases.append((f"{language} = {quote(name)}", pattern_marks_sql(code, own, SAST, prefilter)))
    return chain(cases, NO_MARKS)


def marked_hits_sql(code: str, marks: str) -> str:
    """Every match of every mark, in order.  A text is searched once for a pattern, whatever number of marks have it."""
    is_todo = f"mark.id = '{TODO}'"
    kind = "regexp_extract(m.text, mark.pattern, 1)"
    said = strip_sql("regexp_extract(m.text, mark.pattern, 2)")
    hit = hit_sql(
        "m.line",
        f"IF({is_todo}, concat('{TODO}_', lower({kind})), mark.id)",
        "mark.analyzer",
        "mark.rank * 4294967296L + i",
        f"IF(mark.analyzer <= 1, m.column, 1)",
        f"IF({is_todo}, {said}, m.text)",
    )
    own = "get(places, CAST(array_position(patterns, mark.pattern) - 1 AS INT))"
    found = f"flatten(transform({marks}, mark -> transform({own}, (m, i) -> {hit})))"
    places = f"transform(patterns, pattern -> {locate_sql(code, 'pattern')})"
    located = let(f"array_distinct({marks}.pattern)", "patterns", let(places, "places", found))
    return f"IF(size({marks}) = 0, {NO_HITS}, {located})"


def rule_info(rules: DataFrame) -> DataFrame:
    """What findings need to know about their rule."""
    cases = [
        (f"upper(cwe) = {quote(cwe)}", f"array({', '.join(map(quote, texts))})")
        for cwe, texts in CWE_REMEDIATION.items()
    ]
    advice = f"concat(IF(length(remediation) > 0, array(remediation), array()), {chain(cases, 'array()')})"
    return rules.selectExpr(
        f"{SAST} AS analyzer",
        "id AS rule_id",
        "name",
        "severity",
        "IF(length(message_template) > 0, message_template, concat_ws(': ', name, description)) AS message_template",
        "cwe",
        "owasp",
        "category",
        "array_join(tags, ',') AS tags",
        f"IF(size({advice}) > 0, {advice}, array({quote(DEFAULT_REMEDIATION)})) AS remediations",
        "references",
    )


def rule_info_rows(rules: list) -> list[dict]:
    """`rule_info` of rules that are already on the driver."""
    rows = []
    for r in rules:
        advice = [r["remediation"]] if r["remediation"] else []
        advice += CWE_REMEDIATION.get((r["cwe"] or "").upper(), [])
        rows.append(
            dict(
                analyzer=SAST,
                rule_id=r["id"],
                name=r["name"],
                severity=r["severity"],
                message_template=r["message_template"] or f"{r['name']}: {r['description']}",
                cwe=r["cwe"],
                owasp=r["owasp"],
                category=r["category"],
                tags=",".join(r["tags"] or []),
                remediations=advice or [DEFAULT_REMEDIATION],
                references=r["references"] or [],
            )
        )
    return rows


def indexed_hits(
    files: DataFrame, rules: list[Row], dedup_rows: bool = True, *keep: str, analyzer: int = SAST, language: Column | str = "language"
) -> DataFrame:
    """Exploded hits of one block of a rule table; `files` has (file, code) and the language."""
    found = files.withColumn("_tried", tried(rules, analyzer, files)("code", language))
    marked = found.select("file", "code", *keep, "_tried.hits", F.expr(matching_sql("code", "_tried.marks")).alias("_marks"))
    hits = f"IF(size(_marks) = 0, hits, concat(hits, {marked_hits_sql('code', '_marks')}))"
    return explode_hits(marked, first_per_line_sql(hits) if dedup_rows else hits, *keep)


def compiled_hits(files: DataFrame, rules: list, prefilter: bool = True) -> DataFrame:
    """Exploded hits of a few rules on the driver, all of them tested by expressions of one projection."""
    marks = rule_marks_sql("code", "language", rules, prefilter)
    marked = with_folded(files).select("file", "code", F.expr(marks).alias("_marks"))
    return explode_hits(marked, marked_hits_sql("code", "_marks"))


def sast_findings(
    files: DataFrame,
    rules: DataFrame | None = None,
    now: datetime | str | None = None,
    prefilter: bool = True,
) -> DataFrame:
    """One finding per match of every enabled rule of the file's language.

    The built-in rules, of which there is a fixed number, are compiled into one projection; the patterns of a table are
    looked up in an index, block by block, each once whatever number of rules have it.  What is found is then joined
    with the rules.
    """
    texts = spread(files.select("file", "code", F.lower("language").alias("language")))
    if rules is None:
        own = builtin_rule_rows()
        return findings_of(compiled_hits(texts, own, prefilter), info_table(files.sparkSession, rule_info_rows(own)), now)
    enabled = rules.filter("enabled")
    # A null and a text differ as JSON.
    key = F.md5(F.to_json(F.struct("language", "pattern")).cast("binary"))
    patterns = enabled.select("language", "pattern").distinct().select("*", key.alias("id"), F.lit(True).alias("enabled"))
    tables = [indexed_hits(texts, block, False) for block in rule_blocks(patterns)]
    info = rule_info(enabled).join(enabled.select(F.col("id").alias("rule_id"), key.alias("pattern_id")), "rule_id")
    hits = union_hits(files.sparkSession, tables).withColumnRenamed("rule_id", "pattern_id")
    return findings_of(hits, info, now, by="pattern_id")
