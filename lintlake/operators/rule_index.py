"""Rule tables of any size: an index of the texts that the matches of each rule contain.

The rules of a table are not joined to files.  A block of rules, of bounded size, becomes an index that every worker
holds; a file is run through it once, beside its own row, and comes out with the few rules that can have a match.
Only those are matched, in the row, by the same regular expressions as built-in rules.
"""

from __future__ import annotations

import re
import sys
import uuid
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lintlake.functions.patterns import ODD_CASES, begins_with_literal, portable, required_literals
from lintlake.functions.sqltext import let
from lintlake.operators.hits import HITS
from lintlake.operators.rules import with_java
from lintlake.support import stored

# Bytes of patterns in one block.
BLOCK = 4 << 20

_CANDIDATES = "array<struct<analyzer: int, id: string, rank: int, pattern: string>>"
_ARROW = pa.struct([("analyzer", pa.int32()), ("id", pa.string()), ("rank", pa.int32()), ("pattern", pa.string())])


def rule_blocks(rules: DataFrame) -> Iterator[list[Row]]:
    """The enabled rules that can be run, in blocks: (id, language, pattern, java).

    Every block is a job of its own over the stored rules, dealt by a hash, so that no more than a block of rules is on
    the driver at a time.  Rules that cannot be run are those that `validate_rules` rejects for their pattern.
    """
    usable = with_java(rules.filter("enabled")).filter("java IS NOT NULL")
    usable = stored(usable.select("id", "language", "pattern", "java"), "rules")
    size = F.sum(F.octet_length("pattern") + F.octet_length("java") + F.octet_length("id"))
    blocks = (usable.agg(F.coalesce(size, F.lit(0))).first()[0]) // BLOCK + 1
    lot = F.pmod(F.xxhash64("id", "language", "pattern"), F.lit(blocks))
    for block in range(blocks):
        rows = usable.filter(lot == block).collect()
        if rows:
            yield sorted(rows, key=lambda r: (r["id"], r["language"], r["pattern"]))


class Index:
    """The rules whose required texts occur in a text, found in one walk over it."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        from ahocorasick import Automaton

        self.always: dict[str, list[int]] = defaultdict(list)
        self.folded_rules: dict[str, list[int]] = defaultdict(list)
        self.language = [language for _, language, _, _ in rules]
        self.patterns = [pattern for _, _, pattern, _ in rules]
        self.compiled: dict[str, tuple[re.Pattern, bool] | None] = {}
        self.single: set[int] = set()
        exact: dict[str, list[int]] = defaultdict(list)
        folded: dict[str, list[int]] = defaultdict(list)
        for i, (_, language, pattern, _) in enumerate(rules):
            plain, lower = required_literals(pattern), required_literals(pattern, folded=True)
            if len(plain or lower) == 1:
                self.single.add(i)
            for text in plain:
                exact[text].append(i)
            for text in lower:
                folded[text].append(i)
            if lower:
                self.folded_rules[language].append(i)
            elif not plain:
                self.always[language].append(i)
        self.exact, self.folded = (self._automaton(Automaton(), texts) for texts in (exact, folded))

    @staticmethod
    def _automaton(automaton, texts: dict[str, list[int]]):
        for text, rules in texts.items():
            automaton.add_word(text, (len(text), rules))
        automaton.make_automaton()
        return automaton if texts else None

    def regex(self, rule: int) -> tuple[re.Pattern, bool] | None:
        """The pattern of a rule, where the JVM would find the same matches, and whether each begins with its required text."""
        pattern = self.patterns[rule]
        if pattern not in self.compiled:
            regex = re.compile(pattern, re.MULTILINE | re.DOTALL) if portable(pattern) else None
            self.compiled[pattern] = (regex, begins_with_literal(pattern)) if regex else None
        return self.compiled[pattern]

    def candidates(self, code: str | None, language: str | None) -> list[int]:
        """Numbers of the rules of a language that may have a match in a text."""
        return sorted(self.places(code, language))

    def places(self, code: str | None, language: str | None) -> dict[int, list[int] | None]:
        """The candidates, each with all places where its only required text begins; None where they are not known."""
        if code is None:
            return {}
        found: dict[int, list[int] | None] = {}
        if self.exact:
            self._add(found, self.exact.iter(code), language)
        if self.folded:
            lower = code.lower()
            self._add(found, self.folded.iter(lower), language)
            # Letters that match an ASCII letter when case is ignored, but have another lower case.
            odd = any(odd in code for odd in ODD_CASES)
            if odd or len(lower) != len(code):
                found.update((i, None) for i in self.folded_rules.get(language, ()) if odd or i in found)
        found.update((i, None) for i in self.always.get(language, ()))
        return found

    def _add(self, found: dict[int, list[int] | None], occurrences: Iterator[tuple], language: str | None) -> None:
        starts: dict[int, tuple[list[int], list[int]]] = {}
        for end, (length, rules) in occurrences:
            starts.setdefault(id(rules), (rules, []))[1].append(end - length + 1)
        for rules, places in starts.values():
            for i in rules:
                if self.language[i] == language:
                    found[i] = places if i in self.single else None


def candidates(rules: list[Row], analyzer: int, files: DataFrame) -> Callable[[str, str], Column]:
    """Function of a text's and its language's column that gives the marks of the rules to try on it."""
    shared = files.sparkSession.sparkContext.broadcast([(r["id"], r["language"], r["pattern"], r["java"]) for r in rules])
    name = uuid.uuid4().hex

    @F.arrow_udf(_CANDIDATES)
    def find(code: pa.Array, language: pa.Array) -> pa.Array:
        index, marks = _held(name, shared, analyzer)
        found = [index.candidates(c.as_py(), x.as_py()) for c, x in zip(code, language, strict=True)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        every = np.fromiter((i for some in found for i in some), np.int64, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), marks.take(pa.array(every)))

    return find


def _marks_of(rows: list[tuple], analyzer: int) -> pa.Array:
    ids, _, _, patterns = zip(*rows, strict=True)
    n = len(rows)
    columns = [pa.array([analyzer] * n, pa.int32()), pa.array(ids), pa.array([0] * n, pa.int32()), pa.array(patterns)]
    return pa.StructArray.from_arrays(columns, fields=list(_ARROW))


def _held(key: str, rows, analyzer: int) -> tuple[Index, pa.Array]:
    """A worker builds the index once, and keeps that of the latest block only."""
    kept = vars(sys).setdefault("_lintlake_rules", {})
    if key not in kept:
        kept.clear()
        kept[key] = (Index(rows.value), _marks_of(rows.value, analyzer))
    return kept[key]


# Hits after which a worker hands on the rows it has.
_MANY = 100_000
_PLACE = pa.struct(
    [
        ("line", pa.int32()), ("rule_id", pa.string()), ("analyzer", pa.int32()), ("seq", pa.int64()), ("column", pa.int32()),
        ("text", pa.string()), ("amount", pa.int32()), ("limit", pa.int32()),
    ]
)


def tried(rules: list[Row], analyzer: int, files: DataFrame) -> Callable[[str, str], Column]:
    """Function of a text's and its language's column that gives the `hits` of the candidates whose patterns are the same
    to Python and the JVM, found where the index is, and the `marks` of the candidates to try in the JVM."""
    shared = files.sparkSession.sparkContext.broadcast([(r["id"], r["language"], r["pattern"], r["java"]) for r in rules])
    name = uuid.uuid4().hex

    @F.arrow_udf(f"struct<marks: {_CANDIDATES}, hits: {HITS}>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index, marks = _held(name, shared, analyzer)
        for codes, languages in batches:
            found = _Found()
            for code, language in zip(codes, languages, strict=True):
                found.add(code.as_py(), index, language.as_py())
                if len(found.rules) > _MANY:
                    yield found.rows(marks, analyzer)
                    found = _Found()
            if found.texts or not len(codes):
                yield found.rows(marks, analyzer)

    return find


class _Found:
    """What was found in some texts, as flat arrays."""

    def __init__(self):
        self.texts = 0
        self.mark_ends, self.marks = array("i", [0]), array("q")
        self.ends, self.rules = array("i", [0]), array("q")
        self.lines, self.columns, self.seq = array("i"), array("i"), array("q")
        self.matched: list[str] = []

    def add(self, code: str | None, index: Index, language: str | None) -> None:
        places: dict[str, list[tuple[int, int, str]]] = {}
        newlines: list[int] | None = None
        for i, starts in sorted(index.places(code, language).items()):
            known = index.regex(i)
            if known is None:
                self.marks.append(i)
                continue
            regex, begins = known
            if regex.pattern not in places:
                every = _matches_at(regex, code, starts) if begins and starts is not None else regex.finditer(code)
                matches = [(m.start(), m.group()) for m in every]
                if matches and newlines is None:
                    newlines = [-1, *(m.start() for m in _NEWLINE.finditer(code))]
                # The line of a place is the number of newlines before it, counted from the one before the text.
                lines = [bisect_right(newlines, at - 1) for at, _ in matches]
                places[regex.pattern] = [(n, at - newlines[n - 1], t) for n, (at, t) in zip(lines, matches, strict=True)]
            for seq, (line, column, text) in enumerate(places[regex.pattern]):
                self.rules.append(i)
                self.lines.append(line)
                self.columns.append(column)
                self.seq.append(seq)
                self.matched.append(text)
        self.texts += 1
        self.mark_ends.append(len(self.marks))
        self.ends.append(len(self.rules))

    def rows(self, marks: pa.Array, analyzer: int) -> pa.Array:
        n = len(self.rules)
        none = pa.nulls(n, pa.int32())
        columns = [
            pa.array(self.lines, pa.int32()), marks.field("id").take(pa.array(self.rules, pa.int64())), pa.array([analyzer] * n, pa.int32()),
            pa.array(self.seq, pa.int64()), pa.array(self.columns, pa.int32()), pa.array(self.matched, pa.string()), none, none,
        ]
        hits = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_PLACE)))
        tried = pa.ListArray.from_arrays(pa.array(self.mark_ends, pa.int32()), marks.take(pa.array(self.marks, pa.int64())))
        return pa.StructArray.from_arrays([tried, hits], ["marks", "hits"])


def _matches_at(regex: re.Pattern, code: str, starts: list[int]) -> Iterator[re.Match]:
    """The matches of a pattern that can begin at `starts` only, in ascending order, as `finditer` has them."""
    done = 0
    for at in starts:
        if at >= done and (match := regex.match(code, at)):
            yield match
            done = match.end()


_NEWLINE = re.compile("\n")


def matching_sql(code: str, candidates: str) -> str:
    """The candidates that do occur; each pattern is tested once."""
    occurring = f"filter(array_distinct({candidates}.pattern), p -> {code} RLIKE p)"
    return let(occurring, "occurring", f"filter({candidates}, m -> array_contains(occurring, m.pattern))")
