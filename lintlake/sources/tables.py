"""Rule, advisory and other dimension tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lintlake.builtin.rules import SECRET_RULES
from lintlake.builtin.tables import ADVISORIES, CWE_REMEDIATION, LANGUAGE_OF_EXTENSION
from lintlake.operators.rules import builtin_rule_rows, normalise_rules, validate_rules
from lintlake.operators.rules import with_defaults as _with_defaults
from lintlake.schema import ADVISORIES as ADVISORY_SCHEMA
from lintlake.schema import CWE_REMEDIATION as CWE_SCHEMA
from lintlake.schema import EXTENSIONS as EXTENSION_SCHEMA
from lintlake.schema import RULES as RULE_SCHEMA
from lintlake.support import small_table

_SECRET_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "severity", "pattern")]
)


def builtin_rules(spark: SparkSession) -> DataFrame:
    return small_table(spark, builtin_rule_rows(), RULE_SCHEMA)


def load_rules(spark: SparkSession, source: str | Iterable[dict] | DataFrame | None = None) -> DataFrame:
    """Usable rules of a source; the built-in rules without one.

    A source is a table, a list of rules as dicts, or a path: Parquet, JSON
    lines, or YAML packs with their rules under `rules`.  Invalid rules are left
    out; `validate_rules` and `read_packs` tell which.
    """
    if source is None:
        return builtin_rules(spark)
    return validate_rules(normalise_rules(_read_rules(spark, source)))[0]


def _read_rules(spark: SparkSession, source: str | Iterable[dict] | DataFrame) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        return small_table(spark, map(_with_defaults, source), RULE_SCHEMA)
    if source.endswith((".yaml", ".yml")):
        return read_packs(spark, source)[0]
    if source.endswith((".json", ".jsonl")):
        return spark.read.schema(RULE_SCHEMA).json(source)
    return spark.read.parquet(source)


_PACK_RULE = T.StructType([*RULE_SCHEMA.fields, T.StructField("pack", T.StringType()), T.StructField("problem", T.StringType())])


def read_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, problems) of rule packs: YAML or JSON files with their rules under `rules`.

    Every pack is read in a task of its own accord; one that cannot be read, or has no rules, costs itself only, and a
    member that is no rule only that.  `problems` has (pack, problem) for each of them, beside the rules that
    `validate_rules` rejects.
    """
    packs = spark.read.format("binaryFile").load(path).select("path", "content")
    every = packs.mapInPandas(_pack_rules, _PACK_RULE)
    rules = every.filter("problem IS NULL").drop("pack", "problem")
    return rules, every.filter("problem IS NOT NULL").select("pack", "problem")


def _pack_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    names = _PACK_RULE.fieldNames()
    for batch in batches:
        rows: list[dict] = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                pack = yaml.safe_load(content.decode("utf-8"))  # JSON is YAML, too
            except (yaml.YAMLError, UnicodeDecodeError):
                rows.append({"pack": path, "problem": "cannot be read"})
                continue
            members = pack.get("rules") if isinstance(pack, dict) else None
            if not isinstance(members, list):
                rows.append({"pack": path, "problem": "has no list of rules"})
                continue
            for number, member in enumerate(members):
                wrong = _wrong_field(member)
                if wrong:
                    rows.append({"pack": path, "problem": f"rule {number + 1}: {wrong}"})
                else:
                    rows.append({"pack": path, **_with_defaults(member)})
        yield pd.DataFrame([[row.get(name) for name in names] for row in rows], columns=names, dtype=object)


def _wrong_field(member: object) -> str | None:
    """The first field of a pack's member that no rule can have."""
    if not isinstance(member, dict):
        return "is no mapping"
    for field in RULE_SCHEMA.fields:
        value = member.get(field.name)
        if value is None:
            continue
        kind = bool if field.dataType == T.BooleanType() else list if isinstance(field.dataType, T.ArrayType) else str
        if not isinstance(value, kind) or (kind is list and not all(isinstance(x, str) for x in value)):
            return f"{field.name} is of another type"
    return None


def builtin_secret_patterns(spark: SparkSession) -> DataFrame:
    return small_table(spark, SECRET_RULES, _SECRET_SCHEMA)


def builtin_advisories(spark: SparkSession) -> DataFrame:
    names = ADVISORY_SCHEMA.fieldNames()
    return small_table(spark, (dict(zip(names, row)) for row in ADVISORIES), ADVISORY_SCHEMA)


def builtin_extensions(spark: SparkSession) -> DataFrame:
    rows = ({"ext": ext, "language": lang} for ext, lang in LANGUAGE_OF_EXTENSION.items())
    return small_table(spark, rows, EXTENSION_SCHEMA)


def builtin_cwe_remediation(spark: SparkSession) -> DataFrame:
    rows = ({"cwe": cwe, "texts": texts} for cwe, texts in CWE_REMEDIATION.items())
    return small_table(spark, rows, CWE_SCHEMA)
