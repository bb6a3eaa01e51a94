"""Composing larger expressions as SQL text.

A nested expression of some hundred parts is much faster to hand to Spark as
one text than as one call per part, and lambdas read more plainly in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(text: str | None) -> str:
    """A SQL string literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chain(cases: list[tuple[str, str]], otherwise: str) -> str:
    """CASE WHEN over (condition, value) pairs."""
    if not cases:
        return otherwise
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def evaluate(body: Callable[..., str], **args: Column | str) -> Column:
    """The expression `body` over its arguments.

    Strings are column names (or SQL expressions) and are put into the text;
    Columns are bound to lambda variables.
    """
    columns = {name: value for name, value in args.items() if isinstance(value, Column)}
    if not columns:
        return F.expr(body(**args))
    text = body(**{name: f"args.{name}" if name in columns else value for name, value in args.items()})
    bound = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return F.get(F.call_function("transform", bound, F.expr(f"args -> {text}")), F.lit(0))
