"""Language of a file, from its name or its first line."""

from __future__ import annotations

from pyspark.sql import Column

from lintlake.builtin.tables import LANGUAGE_OF_EXTENSION, SHEBANGS
from lintlake.functions.patterns import SPACE
from lintlake.functions.sqltext import chain, evaluate, let, quote


def suffix_sql(path: str) -> str:
    name = f"substring_index(regexp_replace({path}, '/+$', ''), '/', -1)"
    return f"lower(regexp_extract({name}, '(?s)^.+([.][^.]+)$', 1))"


def suffix_of(path: Column | str) -> Column:
    """Lower-cased last suffix with its dot; empty for `name`, `.name` and `name.`."""
    return evaluate(suffix_sql, path=path)


def _extension_sql(ext: str) -> str:
    pairs = ", ".join(f"'{e}', '{language}'" for e, language in LANGUAGE_OF_EXTENSION.items())
    return f"try_element_at(map({pairs}), {ext})"


def language_for_extension(ext: Column | str) -> Column:
    """Language of an extension, given with or without the dot; null if unknown."""

    def body(ext: str) -> str:
        return _extension_sql(f"lower(IF(startswith({ext}, '.'), {ext}, concat('.', {ext})))")

    return evaluate(body, ext=ext)


def _shebang_sql(code: str) -> str:
    cases = [(f"startswith(first, {quote(prefix)})", quote(language)) for prefix, language in SHEBANGS]
    first = f"regexp_replace(substring_index({code}, chr(10), 1), {quote(f'(?U)^{SPACE}+')}, '')"
    return let(first, "first", chain(cases, "NULL"))


def language_by_shebang(code: Column | str) -> Column:
    """Language named by the first line; null if it names none."""
    return evaluate(_shebang_sql, code=code)


def language_of(path: Column | str, code: Column | str | None = None) -> Column:
    """By suffix, else by first line, else `unknown`."""
    if code is None:
        return evaluate(lambda path: f"coalesce({_extension_sql(suffix_sql(path))}, 'unknown')", path=path)
    return evaluate(
        lambda path, code: f"coalesce({_extension_sql(suffix_sql(path))}, {_shebang_sql(code)}, 'unknown')",
        path=path,
        code=code,
    )
