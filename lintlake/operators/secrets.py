"""Exposed credentials, in files of any language."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lintlake.builtin.rules import SECRET_RULES
from lintlake.operators.hits import RULE_INFO, SECRET, explode_hits, findings_of, info_table, union_hits
from lintlake.operators.rule_index import rule_blocks
from lintlake.operators.sast import indexed_hits, marked_hits_sql, pattern_marks_sql, with_folded
from lintlake.support import spread


# The language of a pattern that is looked for in files of any.
ANY = "*"


def secret_marks_sql(code: str, rows: list) -> str:
    return pattern_marks_sql(code, rows, SECRET)


def secret_blocks(patterns: DataFrame) -> Iterator[list[Row]]:
    """A table of patterns (id, name, severity, pattern) in blocks of bounded size, as those of rules."""
    return rule_blocks(patterns.select("id", "pattern", F.lit(ANY).alias("language"), F.lit(True).alias("enabled")))


def secret_info_rows(rows: list) -> list[dict]:
    return [
        dict(
            analyzer=SECRET,
            rule_id=r["id"],
            name=r["name"],
            severity=r["severity"],
            message_template=f"Possible {r['name']} exposed",
            cwe="CWE-798",
            category="secret",
            remediations=["Revoke the credential", "Move it to a secret store", "Remove it from the history"],
            references=[],
        )
        for r in rows
    ]


def secret_info(patterns: DataFrame) -> DataFrame:
    """`secret_info_rows` of a table of patterns."""
    [like] = secret_info_rows([{"id": "", "name": "{name}", "severity": ""}])
    columns = {name: F.lit(value) for name, value in like.items() if isinstance(value, (str, int))}
    columns |= {
        "rule_id": F.col("id"), "name": F.lit(None).cast("string"), "severity": F.col("severity"),
        "message_template": F.replace(F.lit(like["message_template"]), F.lit("{name}"), F.col("name")),
        "remediations": F.array(*map(F.lit, like["remediations"])), "references": F.array().cast("array<string>"),
    }
    return patterns.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RULE_INFO])


def secrets(
    files: DataFrame, patterns: DataFrame | None = None, now: datetime | str | None = None
) -> DataFrame:
    """One finding per exposed credential; the snippet shows it masked."""
    texts = spread(files.select("file", "code"))
    if patterns is None:
        marked = with_folded(texts).select("file", "code", F.expr(secret_marks_sql("code", SECRET_RULES)).alias("_marks"))
        hits = explode_hits(marked, marked_hits_sql("code", "_marks"))
        return findings_of(hits, info_table(files.sparkSession, secret_info_rows(SECRET_RULES)), now)
    tables = [indexed_hits(texts, block, False, analyzer=SECRET, language=F.lit(ANY)) for block in secret_blocks(patterns)]
    return findings_of(union_hits(files.sparkSession, tables), secret_info(patterns), now)
