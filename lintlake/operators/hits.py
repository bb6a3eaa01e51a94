"""From detector hits to finding rows.

A detector is an expression over one file's text that gives an array of light
hits.  Any number of detectors can be concatenated, so a scan reads each file
once whatever is switched on.  The text is dropped before the hits are exploded;
messages, advice and scores are attached afterwards, from small tables.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions.identity import finding_id_sql
from lintlake.functions.matching import snippet_sql, strip_sql
from lintlake.functions.severity import cvss_score_sql, cvss_vector_sql, rank_sql
from lintlake.functions.sqltext import let
from lintlake.schema import FINDINGS
from lintlake.support import small_table

# Arrival order of the analyzers.
SAST, SECRET, QUALITY, DEPENDENCY = range(4)
# Rows beside the hits: what went wrong with a file.
ERROR = 4
TYPE_OF = {SAST: "vulnerability", SECRET: "secret", QUALITY: "quality", DEPENDENCY: "dependency"}

# Sorting an array of hits puts those of one (line, rule_id) next to each other,
# the one that arrived first in front.
HITS = (
    "ARRAY<STRUCT<line: INT, rule_id: STRING, analyzer: INT, seq: BIGINT, "
    "column: INT, text: STRING, amount: INT, limit: INT>>"
)
NO_HITS = f"CAST(array() AS {HITS})"
_FIELDS = "line rule_id analyzer seq column text amount limit".split()

RULE_INFO = T.StructType(
    [
        T.StructField("analyzer", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message_template", T.StringType()),
        T.StructField("cwe", T.StringType()),
        T.StructField("owasp", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("remediations", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
    ]
)


def hit_sql(
    line: str,
    rule_id: str,
    analyzer: int | str,
    seq: str,
    at: int | str = 1,
    text: str = "CAST(NULL AS STRING)",
    amount: str = "CAST(NULL AS INT)",
    limit: int | None = None,
) -> str:
    most = "CAST(NULL AS INT)" if limit is None else str(limit)
    return (
        f"named_struct('line', CAST({line} AS INT), 'rule_id', {rule_id}, 'analyzer', {analyzer}, "
        f"'seq', CAST({seq} AS BIGINT), 'column', CAST({at} AS INT), 'text', {text}, "
        f"'amount', CAST({amount} AS INT), 'limit', {most})"
    )


def concat_sql(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else NO_HITS


def first_per_line_sql(hits: str) -> str:
    """Keep the first hit of every (line, rule_id) within one file."""
    before = "get(sorted, i - 1)"
    is_first = f"i = 0 OR {before}.line != h.line OR {before}.rule_id != h.rule_id"
    return let(f"sort_array({hits})", "sorted", f"filter(sorted, (h, i) -> {is_first})")


def _snippet_sql(lines: str, h: str) -> str:
    line = f"get({lines}, {h}.line - 1)"
    masked = f"replace({line}, {h}.text, concat(left({h}.text, 4), '****'))"
    return f"""CASE
        WHEN {h}.analyzer = {SAST} THEN {snippet_sql(lines, f"{h}.line")}
        WHEN {h}.analyzer = {SECRET} THEN {strip_sql(masked)}
        WHEN {h}.rule_id = 'quality_long_line' THEN
            IF(length({line}) > 100, concat(left({line}, 100), '...'), {line})
        WHEN {h}.rule_id IN ('quality_long_function', 'quality_high_complexity') THEN {line}
        ELSE {strip_sql(line)} END"""


def explode_hits(files: DataFrame, hits: str, *keep: str) -> DataFrame:
    """One row per hit: file, the `keep` columns, the fields of the hit, a snippet.

    The text is split into lines only for files with hits.  The array of hits holds no snippets: each is cut from
    the lines in its own output row, so a long line with many hits is in memory once.
    """
    found = files.select("file", "code", *keep, F.expr(hits).alias("_found"))
    lines = F.expr("IF(size(_found) = 0, CAST(array() AS ARRAY<STRING>), split(code, chr(10), -1))")
    lined = found.select("file", *keep, "_found", lines.alias("_lines"))
    # An outer explode, then the filter: a plain one would test the size of the array, and make it twice.  Generated
    # code gathers all rows of an explode, each with a copy of the lines; with a lambda in it, Spark takes the plain
    # operator, which hands on row after row.
    one_by_one = F.explode_outer(F.expr("transform(_found, h -> h)"))
    rows = lined.select("file", *keep, "_lines", one_by_one.alias("_hit")).filter("_hit IS NOT NULL")
    snippet = F.expr(_snippet_sql("_lines", "_hit")).alias("snippet")
    return rows.select("file", *keep, *[F.col(f"_hit.{f}") for f in _FIELDS], snippet)


def union_hits(spark: SparkSession, tables: list[DataFrame], *keep: T.StructField) -> DataFrame:
    """All exploded hits; without a table an empty one."""
    if tables:
        return reduce(DataFrame.unionByName, tables)
    fields = [T.StructField(n, T.StringType()) for n in ("file",)] + list(keep)
    hit = spark.range(0).select(F.expr(f"get({NO_HITS}, 0)").alias("h"))
    empty = hit.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "h.*", F.lit("").alias("snippet"))
    return empty.select("file", *[f.name for f in keep], *_FIELDS, "snippet")


def dedup_hits(hits: DataFrame) -> DataFrame:
    """One hit per (file, line, rule_id): the first by analyzer and match order.

    Hits are slim: messages, advice and scores are attached to what is left.
    """
    # All hits have a rule; said here, it need not be concluded by one of two joins that follow, which could then not
    # share the shuffle.
    hits = hits.filter(F.col("rule_id").isNotNull())
    first = F.row_number().over(Window.partitionBy("file", "line", "rule_id").orderBy("analyzer", "seq", "column"))
    return hits.withColumn("_rank", first).filter(F.col("_rank") == 1).drop("_rank")


def timestamp(now: datetime | str | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


_QUALITY_MESSAGE = """replace(replace(replace(replace(message_template,
    '{short}', left(coalesce(text, ''), 50)), '{amount}', coalesce(string(amount), '')),
    '{limit}', coalesce(string(limit), '')), '{match}', coalesce(text, ''))"""


def findings_of(
    hits: DataFrame, info: DataFrame, now: datetime | str | Column | None = None, *keep: str, by: str = "rule_id"
) -> DataFrame:
    """Attach rule data to exploded hits and shape them as findings.

    `by` is the column that tells which rules a hit is of.

    `seq`, the arrival order within a file, stays on as an extra column until
    duplicates are removed.
    """
    types = " ".join(f"WHEN {analyzer} THEN '{name}'" for analyzer, name in TYPE_OF.items())
    seed = "regexp_replace(rule_id, '^quality_', '')"
    joined = hits.join(info, ["analyzer", by]).withColumn("_now", timestamp(now))
    return joined.selectExpr(
        f"{finding_id_sql('file', 'line', seed)} AS id",
        "rule_id",
        f"CASE analyzer {types} END AS finding_type",
        "severity",
        f"{rank_sql('severity')} AS severity_rank",
        "file",
        "line",
        "column",
        f"""CASE analyzer WHEN {QUALITY} THEN {_QUALITY_MESSAGE}
            WHEN {SAST} THEN replace(message_template, '{{match}}', coalesce(text, ''))
            ELSE message_template END AS message""",
        "snippet AS code_snippet",
        "cwe",
        f"IF(analyzer = {SAST}, {cvss_score_sql('severity')}, NULL) AS cvss",
        f"IF(analyzer = {SAST}, {cvss_vector_sql('severity')}, NULL) AS cvss_vector",
        "owasp",
        "category",
        "CAST(NULL AS STRING) AS package",
        "CAST(NULL AS STRING) AS cve",
        f"""IF(analyzer = {QUALITY},
            transform(remediations, r -> replace(r, '{{match}}', coalesce(text, ''))),
            remediations) AS remediations""",
        "references",
        "'open' AS status",
        "_now AS first_seen",
        "_now AS last_seen",
        f"""IF(analyzer = {SAST},
            map('matched_text', text, 'rule_name', name, 'rule_category', category, 'rule_tags', tags),
            CAST(map() AS MAP<STRING, STRING>)) AS context""",
        "seq",
        *keep,
    )


def canonical(findings: DataFrame) -> DataFrame:
    return findings.select(*FINDINGS.fieldNames())


def info_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return small_table(spark, rows, RULE_INFO)
