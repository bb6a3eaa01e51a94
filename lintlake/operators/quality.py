"""Code quality detectors.

Each works on the text of one file inside its row: a file is never spread over
several rows, so nothing is shuffled however large or uneven the files are.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.builtin.rules import QUALITY_RULES
from lintlake.functions.matching import strip_sql
from lintlake.functions.patterns import SPACE
from lintlake.functions.sqltext import chain, let, quote
from lintlake.operators.hits import (
    NO_HITS,
    QUALITY,
    concat_sql,
    explode_hits,
    findings_of,
    hit_sql,
    info_table,
)
from lintlake.operators.sast import NO_MARKS, TODO, mark_sql, marked_hits_sql, marks_sql
from lintlake.schema import SEVERITIES
from lintlake.support import spread

MAX_FUNCTION_LINES = 50
MAX_LINE_LENGTH = 120
MAX_COMPLEXITY = 10

# What the detectors look for.
TODO_PATTERNS = {
    "#": r"#[\s\x1c-\x1f]*(TODO|FIXME|HACK|XXX|BUG)[\s\x1c-\x1f:](.*)",
    "//": r"//[\s\x1c-\x1f]*(TODO|FIXME|HACK|XXX|BUG)[\s\x1c-\x1f:](.*)",
    "/*": r"/\*[\s\x1c-\x1f]*(TODO|FIXME|HACK|XXX|BUG)[\s\x1c-\x1f:](.*)",
}
COMMENTED_PATTERNS = {
    "#": r"#[\s\x1c-\x1f]*(if |for |while |def |class |import |return |print)",
    "//": r"//[\s\x1c-\x1f]*(if |for |while |function |const |let |var |return)",
}
BRANCH_PATTERN = r"\b(if|for|while|case|catch|elif|else)\b"
BLOCK_WORDS = ("def", "function", "public", "private", "protected")
BLOCK_START_PATTERN = r"^[\s\x1c-\x1f]*(def|function|public|private|protected)[\s\x1c-\x1f]+[^\s\x1c-\x1f]"
FUNCTION_PATTERNS = {
    "python": r"^[\s\x1c-\x1f]*def[\s\x1c-\x1f]+(\w+)[\s\x1c-\x1f]*\(",
    "javascript": r"^[\s\x1c-\x1f]*function[\s\x1c-\x1f]+(\w+)[\s\x1c-\x1f]*\(",
    "java": r"^[\s\x1c-\x1f]*(public|private|protected)?[\s\x1c-\x1f]*(static)?[\s\x1c-\x1f]*\w+[\s\x1c-\x1f]+(\w+)[\s\x1c-\x1f]*\(",
}
FUNCTION_WORDS = {"python": "def", "javascript": "function", "java": "("}


def _comment_marks(code: str, patterns: dict[str, str], rule_id: str, flags: str) -> str:
    tests = []
    for rank, (opening, pattern) in enumerate(patterns.items()):
        java = f"(?{flags}){pattern}"
        test = f"contains({code}, {quote(opening)}) AND {code} RLIKE {quote(java)}"
        tests.append((test, mark_sql(QUALITY, rule_id, java, rank)))
    return marks_sql(tests)


def todo_marks_sql(code: str) -> str:
    """Marks of TODO-like comments in the three comment styles."""
    return _comment_marks(code, TODO_PATTERNS, TODO, "diU")


def commented_marks_sql(code: str) -> str:
    """Marks of comments that start like a statement."""
    return _comment_marks(code, COMMENTED_PATTERNS, "quality_commented_code", "dU")


def long_line_hits_sql(code: str, max_len: int = MAX_LINE_LENGTH) -> str:
    lengths = f"transform(split({code}, chr(10), -1), (text, i) -> named_struct('line', i + 1, 'size', length(text)))"
    hit = hit_sql("x.line", "'quality_long_line'", QUALITY, "i", max_len + 1, amount="x.size", limit=max_len)
    found = f"transform(filter({lengths}, x -> x.size > {max_len}), (x, i) -> {hit})"
    # A text shorter than the limit has no longer line.
    return f"IF(length({code}) > {max_len}, {found}, {NO_HITS})"


def _with_lines(code: str, header: str, words: Iterable[str], body: str) -> str:
    """`body` over `lines` and `starts`, the 0-based positions of header lines.

    Runs only for texts in which a header can occur at all.
    """
    starts = f"filter(transform(lines, (text, i) -> IF(text RLIKE {quote('(?dU)' + header)}, i, NULL)), i -> i IS NOT NULL)"
    possible = " OR ".join(f"contains({code}, {quote(word)})" for word in words)
    gate = f"({possible}) AND {code} RLIKE {quote('(?dmU)' + header)}"
    found = let(f"split({code}, chr(10), -1)", "lines", let(starts, "starts", body))
    return f"IF({gate}, {found}, {NO_HITS})"


# The lines between the k-th header and the next one, or the end.
_BODY = "slice(lines, start + 2, coalesce(get(starts, k + 1), size(lines)) - start - 1)"


def complexity_hits_sql(code: str, max_score: int = MAX_COMPLEXITY) -> str:
    """Functions whose branch keywords, plus one, exceed the maximum."""
    hit = hit_sql(
        "start + 1",
        "'quality_high_complexity'",
        QUALITY,
        "k",
        text=f"substring_index({strip_sql('lines[start]')}, '(', 1)",
        amount=f"1 + regexp_count(array_join({_BODY}, chr(10)), {quote('(?dU)' + BRANCH_PATTERN)})",
        limit=max_score,
    )
    body = f"filter(transform(starts, (start, k) -> {hit}), h -> h.amount > {max_score})"
    return _with_lines(code, BLOCK_START_PATTERN, BLOCK_WORDS, body)


def _indent(text: str) -> str:
    return f"length(regexp_extract({text}, {quote(f'(?U)^{SPACE}*')}, 0))"


def long_function_hits_sql(code: str, language: str, max_lines: int = MAX_FUNCTION_LINES) -> str:
    """Functions with too many lines, in the languages with a header pattern.

    A function ends at the first line indented no deeper than its header.  A
    header that comes before that end replaces the open function, which is then
    never reported; a header whose first group is empty opens nothing.
    """
    cases = []
    for name, header in FUNCTION_PATTERNS.items():
        # Not blank, no comment in the first column, not indented deeper.
        ends = (
            f"text RLIKE {quote('(?U)[^' + SPACE[1:-1] + ']')} AND NOT startswith(text, '#') "
            f"AND {_indent('text')} <= indent"
        )
        closed = f"filter(transform({_BODY}, (text, i) -> IF({ends}, i + 1, NULL)), i -> i IS NOT NULL)"
        to_the_end = "IF(get(starts, k + 1) IS NULL, size(lines) - start, NULL)"
        opened = f"regexp_extract(lines[start], {quote('(?dU)' + header)}, 1)"
        length = let(_indent("lines[start]"), "indent", f"coalesce(get({closed}, 0), {to_the_end})")
        hit = hit_sql(
            "start + 1",
            "'quality_long_function'",
            QUALITY,
            "k",
            text=opened,
            amount=f"IF({opened} = '', NULL, {length})",
            limit=max_lines,
        )
        body = f"filter(transform(starts, (start, k) -> {hit}), h -> h.amount > {max_lines})"
        cases.append((f"{language} = '{name}'", _with_lines(code, header, [FUNCTION_WORDS[name]], body)))
    return chain(cases, NO_HITS)


def quality_marks_sql(code: str, severities: Iterable[str] = SEVERITIES) -> str:
    """Marks of the comment detectors."""
    wanted = set(severities)
    parts = []
    if wanted & {"MEDIUM", "LOW"}:
        parts.append(todo_marks_sql(code))
    if "LOW" in wanted:
        parts.append(commented_marks_sql(code))
    return f"concat({', '.join(parts)})" if parts else NO_MARKS


def quality_hits_sql(code: str, language: str, severities: Iterable[str] = SEVERITIES) -> list[str]:
    """The other detectors, those that report the given severities."""
    wanted = set(severities)
    parts = []
    if "INFO" in wanted:
        parts.append(long_line_hits_sql(code))
    if "MEDIUM" in wanted:
        parts += [long_function_hits_sql(code, language), complexity_hits_sql(code)]
    return parts


def quality_info_rows() -> list[dict]:
    return [
        dict(
            analyzer=QUALITY,
            rule_id=r["id"],
            severity=r["severity"],
            message_template=r["message_template"],
            remediations=r["remediations"],
            references=[],
        )
        for r in QUALITY_RULES
    ]


def quality_info(spark: SparkSession) -> DataFrame:
    return info_table(spark, quality_info_rows())


def _quality(files: DataFrame, marks: str, parts: list[str], now: datetime | str | None) -> DataFrame:
    texts = spread(files.select("file", "code", "language"))
    marked = texts.select("*", F.expr(marks).alias("_marks"))
    found = ([] if marks == NO_MARKS else [marked_hits_sql("code", "_marks")]) + parts
    return findings_of(explode_hits(marked, concat_sql(found)), quality_info(files.sparkSession), now)


def quality_findings(files: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return _quality(files, quality_marks_sql("code"), quality_hits_sql("code", "language"), now)


def _named(files: DataFrame) -> DataFrame:
    """Detectors that need no language also take tables without one."""
    return files if "language" in files.columns else files.withColumn("language", F.lit("unknown"))


def todos(files: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return _quality(_named(files), todo_marks_sql("code"), [], now)


def commented_code(files: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return _quality(_named(files), commented_marks_sql("code"), [], now)


def long_lines(
    files: DataFrame, max_len: int = MAX_LINE_LENGTH, now: datetime | str | None = None
) -> DataFrame:
    return _quality(_named(files), NO_MARKS, [long_line_hits_sql("code", max_len)], now)


def high_complexity(
    files: DataFrame, max_score: int = MAX_COMPLEXITY, now: datetime | str | None = None
) -> DataFrame:
    return _quality(_named(files), NO_MARKS, [complexity_hits_sql("code", max_score)], now)


def long_functions(
    files: DataFrame, max_lines: int = MAX_FUNCTION_LINES, now: datetime | str | None = None
) -> DataFrame:
    return _quality(files, NO_MARKS, [long_function_hits_sql("code", "language", max_lines)], now)
