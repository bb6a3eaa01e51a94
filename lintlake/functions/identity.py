"""Stable finding ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column

from lintlake.functions.sqltext import evaluate, let


def finding_id_sql(file: str, line: str, seed: str) -> str:
    name = f"encode(concat_ws(':', {file}, string({line}), {seed}), 'UTF-8')"
    digest = f"sha1(concat(unhex('{uuid.NAMESPACE_DNS.hex}'), {name}))"
    variant = "translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    parts = (
        "concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), concat('5', substr(d, 14, 3)), "
        f"concat({variant}, substr(d, 18, 3)), substr(d, 21, 12))"
    )
    return let(digest, "d", parts)


def finding_id(file: Column | str, line: Column | str, seed: Column | str) -> Column:
    """Name-based UUID (version 5, DNS namespace) of `file:line:seed`."""
    return evaluate(finding_id_sql, file=file, line=line, seed=seed)
