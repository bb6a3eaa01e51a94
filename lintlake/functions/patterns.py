"""Regex dialect: rule patterns are written for Python, matched by the JVM.

Everything here runs on the driver, once per pattern.
"""

from __future__ import annotations

import re

from re import _constants as sre
from re import _parser as sre_parse

from lintlake.functions.sqltext import quote

# Whitespace as Python's `str` patterns and `str.strip` see it.  Java's Unicode
# `\s` lacks the four information separators.
SPACE = r"[\s\x1c-\x1f]"

_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")


def java_pattern(
    pattern: str, case_sensitive: bool = True, multiline: bool = True, unicode: bool = True
) -> str:
    """Prefix and adapt a Python pattern so that Java finds the same matches."""
    flags = "d" + ("U" if unicode else "") + ("ms" if multiline else "") + ("" if case_sensitive else "i")
    return f"(?{flags})" + _adapt(pattern)


def _adapt(pattern: str) -> str:
    out: list[str] = []
    i, in_class, class_start = 0, False, -1
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            out.append(r"\z" if pair == r"\Z" and not in_class else pair)
            i += 2
            continue
        if in_class:
            if ch == "[" or (ch == "&" and pattern[i + 1 : i + 2] == "&"):
                out.append("\\")
            elif ch == "]" and i == class_start:
                out.append("\\")
            elif ch == "]":
                in_class = False
        elif ch == "[":
            in_class = True
            class_start = i + (2 if pattern[i + 1 : i + 2] == "^" else 1)
        elif ch == "{":
            found = _QUANTIFIER.match(pattern, i)
            if found is None or not (found[1] or found[3]):
                out.append("\\")
            elif not found[1]:
                out.append("{0")
                i += 1
                continue
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            out.append("(?<" + _group_name(pattern[i + 4 : end]) + ">")
            i = end + 1
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(r"\k<" + _group_name(pattern[i + 4 : end]) + ">")
            i = end + 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def _group_name(name: str) -> str:
    """Java names are letters and digits: every other character, and the escape Z itself, is written out."""
    return "g" + "".join(c if c.isascii() and c.isalnum() and c != "Z" else f"Z{ord(c):x}Z" for c in name)


# Written in Python only: conditional groups, characters by name or by eight digits, the flags a, L and u.
_UNTRANSLATABLE = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?\(|\\N\{|\\U[0-9A-Fa-f]{8}|\(\?[imsx]*[aLu])")


def translatable(pattern: str) -> bool:
    return _UNTRANSLATABLE.search(pattern) is None


def compiles(pattern: str | None) -> bool:
    try:
        re.compile(pattern)
    except (re.error, TypeError):
        return False
    return True


def matches_empty(pattern: str) -> bool:
    """Patterns that can match nothing have no usable positions."""
    return sre_parse.parse(pattern).getwidth()[0] == 0


def portable(pattern: str) -> bool:
    """Whether it is certain that Python and the JVM find the same matches: the pattern is made of characters, classes of
    characters written out, alternatives, groups and repeats of what cannot be empty.  When case is ignored, of ASCII
    letters without classes.
    """
    if _ESCAPED_NAME.search(pattern):
        return False
    try:
        tree = sre_parse.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    flags = tree.state.flags & ~(re.UNICODE | re.MULTILINE | re.DOTALL)
    if flags not in (0, re.IGNORECASE) or (flags and not pattern.isascii()):
        return False
    return tree.getwidth()[0] > 0 and _portable(tree, bool(flags))


# What is a class, a place, or a character by its code: Java has other rules for some of them.
_ESCAPED_NAME = re.compile(r"\\[0-9A-Za-z]")


def _portable(tree, folded: bool) -> bool:
    for op, arg in tree:
        if op in (sre.LITERAL, sre.ANY):
            continue
        if op in (sre.NOT_LITERAL, sre.IN):
            if folded or (op is sre.IN and any(kind not in (sre.LITERAL, sre.RANGE, sre.NEGATE) for kind, _ in arg)):
                return False
        elif op is sre.SUBPATTERN:
            if arg[1] or arg[2] or not _portable(arg[3], folded):
                return False
        elif op is sre.BRANCH:
            if not all(_portable(branch, folded) for branch in arg[1]):
                return False
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            if arg[2].getwidth()[0] == 0 or not _portable(arg[2], folded):
                return False
        else:
            return False
    return True


def required_literals(pattern: str, folded: bool = False) -> list[str]:
    """Texts of which at least one occurs in every match; empty if unknown.

    Used as a cheap `contains` test before the regex runs.  `folded` gives those
    of a pattern that ignores case, in lower case.
    """
    try:
        tree = sre_parse.parse(pattern)
    except re.error:
        return []
    if bool(tree.state.flags & re.IGNORECASE) != folded:
        return []
    best = _best_literals(tree)
    if folded:
        best = [text.lower() for text in best]
    if min(map(len, best), default=0) < 3 or (folded and not all(map(str.isascii, best))):
        return []
    return [text for text in best if not any(other != text and other in text for other in best)]


def begins_with_literal(pattern: str) -> bool:
    """Whether every match begins with the only text of `required_literals`."""
    tree = sre_parse.parse(pattern)
    folded = bool(tree.state.flags & re.IGNORECASE)
    texts = required_literals(pattern, folded)
    if len(texts) != 1:
        return False
    start = list(tree)[: len(texts[0])]
    found = "".join(chr(arg) if op is sre.LITERAL else "\0" for op, arg in start)
    return (found.lower() if folded else found) == texts[0]


# The letters that match an ASCII letter when case is ignored and that `lower`
# does not turn into it.
_ODD_CASES = {"s": "\u017f", "i": "\u0131\u0130", "k": "\u212a"}
ODD_CASES = "".join(_ODD_CASES.values())


def contains_sql(code: str, pattern: str, folded: str | None = None) -> str | None:
    """A test that is true of every text the pattern occurs in; None if unknown.

    `folded` names the text in lower case where that is at hand.
    """
    tests = [f"contains({code}, {quote(text)})" for text in required_literals(pattern)]
    texts = required_literals(pattern, folded=True)
    tests += [f"contains({folded or f'lower({code})'}, {quote(text)})" for text in texts]
    for letter, odd in _ODD_CASES.items():
        if any(letter in text for text in texts):
            tests += [f"contains({code}, '{ch}')" for ch in odd]
    return f"({' OR '.join(tests)})" if tests else None


def _best_literals(tree) -> list[str]:
    candidates: list[list[str]] = []
    run = ""
    for op, arg in list(tree) + [(None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run:
            candidates.append([run])
            run = ""
        if op is sre.SUBPATTERN and not (arg[1] or arg[2]):
            candidates.append(_best_literals(arg[3]))
        elif op is sre.BRANCH:
            branches = [_best_literals(branch) for branch in arg[1]]
            if all(branches):
                candidates.append(sorted({text for branch in branches for text in branch}))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            candidates.append(_best_literals(arg[2]))
    candidates = [c for c in candidates if c]
    return max(candidates, key=lambda c: min(map(len, c)), default=[])
