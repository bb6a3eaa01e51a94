"""Regex matching with exact positions.

`find_matches` is the core: Spark can list the texts of all matches but not
where they are, so positions are rebuilt by walking the text between matches
(`split`) alongside the matches themselves (`regexp_extract_all`).

Texts and positions are given as Columns or column names, patterns as Python
regexes, or as Columns holding Java ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.patterns import SPACE, contains_sql, java_pattern
from lintlake.functions.sqltext import chain, evaluate, let, quote
from lintlake.support import column

MATCHES = "ARRAY<STRUCT<line: INT, column: INT, text: STRING>>"
NO_MATCHES = f"CAST(array() AS {MATCHES})"

# Positions are accumulated in blocks of this many matches, so that a file with
# very many matches costs n * _BLOCK array copies and not n * n.
_BLOCK = 256


def newlines_sql(text: str) -> str:
    # A newline is one byte; bytes need no counting.
    return f"(octet_length({text}) - octet_length(replace({text}, '\\n')))"


def last_line_sql(text: str) -> str:
    return f"length(substring_index({text}, '\\n', -1))"


def _after_gap(line: str, col: str) -> str:
    """Cursor at the match of piece `p`, from a cursor at its gap."""
    return (
        f"named_struct('line', {line} + p.gap_lines, "
        f"'col', IF(p.gap_lines > 0, p.gap_tail, {col} + p.gap_tail))"
    )


_AFTER_MATCH = "'line', at.line + p.hit_lines, 'col', IF(p.hit_lines > 0, p.hit_tail, at.col + p.hit_tail)"
_CURSOR = "STRUCT<line: INT, col: INT>"


def _block_end(block: str, start: str) -> str:
    step = let(_after_gap("s.line", "s.col"), "at", f"named_struct({_AFTER_MATCH})")
    return f"aggregate({block}, {start}, (s, p) -> {step})"


def _block_matches(block: str, start: str) -> str:
    match = "named_struct('line', at.line, 'column', at.col + 1, 'text', p.text)"
    step = let(
        _after_gap("s.line", "s.col"),
        "at",
        f"named_struct({_AFTER_MATCH}, 'found', concat(s.found, array({match})))",
    )
    zero = f"named_struct('line', {start}.line, 'col', {start}.col, 'found', {NO_MATCHES})"
    return f"aggregate({block}, {zero}, (s, p) -> {step}, s -> s.found)"


def locate_sql(code: str, regex: str) -> str:
    """All matches of a Java pattern in a text, as MATCHES."""
    piece = (
        f"named_struct('gap_lines', {newlines_sql('g')}, 'gap_tail', {last_line_sql('g')}, "
        f"'hit_lines', {newlines_sql('h')}, 'hit_tail', {last_line_sql('h')}, 'text', h)"
    )
    # The rest of the text after the last match is no piece.
    pieces = (
        f"filter(zip_with(split({code}, {regex}, -1), regexp_extract_all({code}, {regex}, 0), "
        f"(g, h) -> IF(h IS NULL, NULL, {piece})), p -> p IS NOT NULL)"
    )
    blocks = let(
        pieces,
        "ps",
        f"transform(sequence(0, (size(ps) - 1) DIV {_BLOCK}), b -> slice(ps, CAST(b * {_BLOCK} + 1 AS INT), {_BLOCK}))",
    )
    zero = "named_struct('line', 1, 'col', 0)"
    next_block = (
        f"named_struct('cursor', {_block_end('block', 'w.cursor')}, "
        "'starts', concat(w.starts, array(w.cursor)))"
    )
    starts = (
        f"IF(size(bs) = 1, array({zero}), aggregate(bs, named_struct('cursor', {zero}, "
        f"'starts', CAST(array() AS ARRAY<{_CURSOR}>)), (w, block) -> {next_block}, w -> w.starts))"
    )
    return let(
        blocks, "bs", f"flatten(zip_with({starts}, bs, (start, block) -> {_block_matches('block', 'start')}))"
    )


def find_sql(code: str, regex: str, possible: str | None = None) -> str:
    """`locate_sql` of texts that have a match; `possible` is a cheaper test before it."""
    found = f"{code} RLIKE {regex}"
    return f"IF({possible + ' AND ' if possible else ''}{found}, {locate_sql(code, regex)}, {NO_MATCHES})"


def _regex(
    pattern: str | Column, case_sensitive: bool = True, multiline: bool = True, unicode: bool = True
) -> str | Column:
    if isinstance(pattern, Column):
        return pattern
    return quote(java_pattern(pattern, case_sensitive, multiline, unicode))


def find_matches(
    code: Column | str,
    pattern: str | Column,
    case_sensitive: bool = True,
    multiline: bool = True,
    unicode: bool = True,
) -> Column:
    """array<struct<line, column, text>> of the leftmost non-overlapping matches."""
    regex = _regex(pattern, case_sensitive, multiline, unicode)
    if isinstance(regex, Column):
        return evaluate(find_sql, code=code, regex=regex)
    plain = pattern if case_sensitive else f"(?i){pattern}"
    return evaluate(lambda code: find_sql(code, regex, contains_sql(code, plain)), code=code)


def match_line(
    line: Column | str, pattern: str, case_sensitive: bool = True, unicode: bool = True
) -> Column:
    """Whether the pattern occurs anywhere in one line."""
    return F.rlike(column(line), F.lit(java_pattern(pattern, case_sensitive, False, unicode)))


def extract_groups(
    code: Column | str,
    pattern: str,
    groups: int | None = None,
    case_sensitive: bool = True,
    unicode: bool = True,
) -> Column:
    """array<struct<g1, g2, ...>>: the capture groups of every match."""
    n = re.compile(pattern).groups if groups is None else groups
    if n == 0:
        return F.expr("CAST(array() AS ARRAY<STRUCT<g1: STRING>>)")
    regex = F.lit(java_pattern(pattern, case_sensitive, False, unicode))
    found = [F.regexp_extract_all(column(code), regex, F.lit(i + 1)) for i in range(n)]
    names = ", ".join(f"g{i + 1}: STRING" for i in range(n))
    return F.arrays_zip(*found).cast(f"ARRAY<STRUCT<{names}>>")


def function_calls(code: Column | str, name: str, unicode: bool = True) -> Column:
    """Positions of `name(`; the same for every language."""
    return find_matches(code, rf"\b{re.escape(name)}\s*\(", unicode=unicode)


def _import_patterns(module: str) -> dict[str, list[str]]:
    name = re.escape(module)
    quotes = "['\"]"
    return {
        "python": [rf"^\s*import\s+{name}\b", rf"^\s*from\s+{name}\s+import\b"],
        "javascript": [
            rf"^\s*import\s+.*\s+from\s+{quotes}{name}{quotes}",
            rf"^\s*require\s*\(\s*{quotes}{name}\s*{quotes}",
        ],
        "java": [rf"^\s*import\s+{name}\b"],
    }


def imports(code: Column | str, module: str, language: Column | str, unicode: bool = True) -> Column:
    """Positions of the import statements for one module, by language."""

    def body(code: str, language: str) -> str:
        cases = []
        for name, patterns in _import_patterns(module).items():
            found = [find_sql(code, _regex(p, unicode=unicode)) for p in patterns]
            # A module name is a literal, so a plain search spares the regexes.
            cases.append((f"{language} = '{name}' AND contains({code}, {quote(module)})", f"concat({', '.join(found)})"))
        return chain(cases, NO_MATCHES)

    return evaluate(body, code=code, language=language)


def count_matches(
    code: Column | str, pattern: str, case_sensitive: bool = True, unicode: bool = True
) -> Column:
    return F.regexp_count(column(code), F.lit(java_pattern(pattern, case_sensitive, True, unicode)))


def has_pattern(
    code: Column | str, pattern: str, case_sensitive: bool = True, unicode: bool = True
) -> Column:
    return F.rlike(column(code), F.lit(java_pattern(pattern, case_sensitive, True, unicode)))


def line_of(code: Column | str, offset: Column | str) -> Column:
    """1-based line of a 0-based character offset."""
    return evaluate(
        lambda code, offset: f"{newlines_sql(f'left({code}, {offset})')} + 1", code=code, offset=offset
    )


def column_of(code: Column | str, offset: Column | str) -> Column:
    """1-based column of a 0-based character offset."""
    return evaluate(
        lambda code, offset: f"{last_line_sql(f'left({code}, {offset})')} + 1", code=code, offset=offset
    )


def snippet_sql(lines: str, line: str, context: int = 2) -> str:
    first = f"greatest({line} - {context}, 1)"
    kept = f"slice({lines}, {first}, least({line} + {context}, size({lines})) - {first} + 1)"
    marked = f"(text, i) -> concat(IF({first} + i = {line}, '>>> ', '    '), text)"
    return f"array_join(transform({kept}, {marked}), '\\n')"


def snippet(lines: Column | str, line: Column | str, context: int = 2) -> Column:
    """The hit line and its neighbours, the hit line marked with `>>> `."""
    return evaluate(lambda lines, line: snippet_sql(lines, line, context), lines=lines, line=line)


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {quote(f'(?U)^{SPACE}+|{SPACE}+' + chr(92) + 'z')}, '')"


def strip(text: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return evaluate(strip_sql, text=text)


def format_message(template: Column | str, match: Column | str) -> Column:
    """Fill the `{match}` placeholder of a rule's message."""
    return F.replace(column(template), F.lit("{match}"), column(match))
