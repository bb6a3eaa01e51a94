"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_TEXTS = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FINDINGS = _struct(
    ("id", _S),
    ("rule_id", _S),
    ("finding_type", _S),
    ("severity", _S),
    ("severity_rank", T.IntegerType()),
    ("file", _S),
    ("line", T.IntegerType()),
    ("column", T.IntegerType()),
    ("message", _S),
    ("code_snippet", _S),
    ("cwe", _S),
    ("cvss", T.DoubleType()),
    ("cvss_vector", _S),
    ("owasp", _S),
    ("category", _S),
    ("package", _S),
    ("cve", _S),
    ("remediations", _TEXTS),
    ("references", _TEXTS),
    ("status", _S),
    ("first_seen", T.TimestampType()),
    ("last_seen", T.TimestampType()),
    ("context", T.MapType(_S, _S)),
)

RULES = _struct(
    ("id", _S),
    ("name", _S),
    ("description", _S),
    ("pattern", _S),
    ("severity", _S),
    ("language", _S),
    ("cwe", _S),
    ("owasp", _S),
    ("message_template", _S),
    ("remediation", _S),
    ("references", _TEXTS),
    ("enabled", T.BooleanType()),
    ("tags", _TEXTS),
    ("category", _S),
)

ADVISORIES = _struct(
    ("language", _S),
    ("package", _S),
    ("version_spec", _S),
    ("cve", _S),
    ("severity", _S),
)

DEPENDENCIES = _struct(
    ("file", _S),
    ("name", _S),
    ("version", _S),
    ("language", _S),
    ("operator", _S),
    ("line", T.IntegerType()),
)

EXTENSIONS = _struct(("ext", _S), ("language", _S))

CWE_REMEDIATION = _struct(("cwe", _S), ("texts", _TEXTS))

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
FINDING_TYPES = ("vulnerability", "secret", "quality", "compliance", "dependency", "performance")
STATUSES = ("open", "fixed", "ignored", "false_positive", "in_progress")
