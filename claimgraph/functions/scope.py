"""Nested scope envelopes: JSON round trip and flattening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph import schemas as S

# What an absent field of each part stands for.
_FLAGS = {"temporal": "is_default", "geographic": "is_global", "organizational": "is_universal"}
_DEFAULTS = {"coverage": "universal", "completeness": "unknown", "source": "unknown"}


def to_text(scope: Column) -> Column:
    return F.to_json(scope)


def from_text(text: Column) -> Column:
    """Scope from JSON text; null, empty or partial text takes the defaults."""
    return with_defaults(F.from_json(F.coalesce(text, F.lit("{}")), S.SCOPE))


def with_defaults(scope: Column) -> Column:
    parts = []
    for field in S.SCOPE.fields:
        value = scope[field.name]
        if isinstance(field.dataType, T.StructType):
            inner = [_filled(value[f.name], f, field.name).alias(f.name) for f in field.dataType.fields]
            parts.append(F.struct(*inner).alias(field.name))
        else:
            default = _DEFAULTS.get(field.name)
            parts.append((F.coalesce(value, F.lit(default)) if default else value).alias(field.name))
    return F.struct(*parts)


def _filled(value: Column, field: T.StructField, part: str) -> Column:
    if field.name == _FLAGS.get(part):
        return F.coalesce(value, F.lit(True))
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(value, F.array().cast(field.dataType))
    if isinstance(field.dataType, T.MapType):
        return F.coalesce(value, F.create_map().cast(field.dataType))
    return value


def flat_columns(scope: str = "scope") -> list[Column]:
    """Scope fields as top-level columns, with the names of the assertion table."""
    prefix = {"temporal": "temporal_", "geographic": "geo_", "organizational": "org_", "conditional": "cond_"}
    out = []
    for field in S.SCOPE.fields:
        if isinstance(field.dataType, T.StructType):
            out += [F.col(f"{scope}.{field.name}.{f.name}").alias(prefix[field.name] + f.name)
                    for f in field.dataType.fields]
        else:
            out.append(F.col(f"{scope}.{field.name}").alias(f"scope_{field.name}"))
    return out
