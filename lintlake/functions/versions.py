"""Version texts and version predicates."""

from __future__ import annotations

from pyspark.sql import Column

from lintlake.functions.sqltext import evaluate


def clean_version(version: Column | str) -> Column:
    """Drop the range operators of a manifest version."""
    return evaluate(lambda version: f"translate({version}, '^~><=', '')", version=version)


def version_key_sql(version: str) -> str:
    text = f"regexp_replace({version}, '^[vV](?=[0-9])', '')"
    parts = f"split(regexp_replace({text}, '([.]0*)+$', ''), '[.]')"
    digits = "regexp_extract(part, '^0*([0-9]*)', 1)"
    # More digits make a larger number; of as many, the text decides.
    number = f"named_struct('size', length({digits}), 'digits', {digits})"
    return f"IF({text} RLIKE '^[0-9.]', transform({parts}, part -> {number}), NULL)"


def version_key(version: Column | str) -> Column:
    """Numeric parts of a version, comparable as an array.

    Trailing zero parts are dropped so that 2.0 and 2.0.0 are the same; a part
    counts by its leading digits, of which there may be any number.  Null when the text does not start like a
    version (`*`, `latest`, a URL).
    """
    return evaluate(version_key_sql, version=version)


def version_lt(left: Column | str, right: Column | str) -> Column:
    return evaluate(
        lambda left, right: f"{version_key_sql(left)} < {version_key_sql(right)}", left=left, right=right
    )


def _string_sql(version: str, spec: str) -> str:
    below = f"{version} < trim(substr({spec}, 2))"
    exact = f"IF(startswith({spec}, '=='), trim(substr({spec}, 3)), {spec})"
    return f"IF(startswith({spec}, '<'), {below}, {version} = {exact})"


def bound_sql(spec: str) -> str:
    """Numeric parts of the version an advisory range names."""
    return version_key_sql(f"trim(regexp_replace({spec}, '^(<=|==|<)', ''))")


def _semantic_sql(version: str, spec: str) -> str:
    return _within_sql(version_key_sql(version), spec, bound_sql(spec))


def _within_sql(have: str, spec: str, bound: str) -> str:
    """Whether the parts of a version are in a range with these bound parts."""
    return (
        f"coalesce(CASE WHEN startswith({spec}, '<=') THEN {have} <= {bound} "
        f"WHEN startswith({spec}, '<') THEN {have} < {bound} ELSE {have} = {bound} END, false)"
    )


def range_sql(spec: str, mode: str = "semantic") -> str:
    """An advisory range as a struct: `key`, comparable with `comparable_sql` of a version; `below`, whether it covers
    the versions below the key, or only the one; and `inclusive`, whether the key's own version is among them."""
    if mode == "semantic":
        return (
            f"named_struct('key', {bound_sql(spec)}, 'below', startswith({spec}, '<'), "
            f"'inclusive', startswith({spec}, '<='))"
        )
    exact = f"IF(startswith({spec}, '=='), trim(substr({spec}, 3)), {spec})"
    key = f"IF(startswith({spec}, '<'), trim(substr({spec}, 2)), {exact})"
    return f"named_struct('key', {key}, 'below', startswith({spec}, '<'), 'inclusive', false)"


def comparable_sql(version: str, mode: str = "semantic") -> str:
    return version_key_sql(version) if mode == "semantic" else version


def version_matches(version: Column | str, spec: Column | str, mode: str = "semantic") -> Column:
    """Whether a version falls under an advisory range (`<x`, `<=x`, `==x`, `x`).

    `semantic` compares the numeric parts.  `string` compares the texts by code
    point and reads everything after the first `<` as the bound.
    """
    modes = {"semantic": _semantic_sql, "string": _string_sql}
    if mode not in modes:
        raise ValueError(f"unknown version mode: {mode}")
    return evaluate(modes[mode], version=version, spec=spec)
