"""Harmonised columns: categories of age, sex and dates beside the columns as published.

Rules are data (what a dictionary declares): `age` and `sex` name their fields,
`dates` lists date fields, and `validated_sources` says for which files each was
checked.  A column is only offered for sources that were.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.functions import rules as R

#: Names of the harmonised columns.
AGE = ("idade_anos_completos", "idade_status", "idade_quantidade", "idade_unidade")
SEX = ("sexo_categoria", "sexo_status")
DATE_SUFFIXES = ("_data", "_data_status")


@dataclass(frozen=True)
class Context:
    """Where rows come from: scope, release and digest of a source."""

    scope: Mapping[str, Any]
    release: str | None
    sha256: str

    def key(self) -> tuple:
        """A national file's year and month are those of its source, `_source_ano` and `_source_mes`."""
        return tuple(self.scope.get(k, self.scope.get(f"_source_{k}")) for k in ("uf", "ano", "mes")), self.release, self.sha256


@dataclass
class Projection:
    columns: list[tuple[str, Column]] = field(default_factory=list)
    unavailable: dict[str, str] = field(default_factory=dict)  # first column of a group -> why
    rule_version: str | None = None
    metadata_hash: str = ""  # of the rules, as canonical JSON

    def over(self, df: DataFrame) -> DataFrame:
        return df.select("*", *(c.alias(n) for n, c in self.columns))


def groups(rules: Mapping[str, Any]) -> list[tuple[str, tuple[str, ...], tuple[str, ...], Mapping[str, Any]]]:
    """(kind, harmonised columns, columns they come from, rule) of each group that the rules declare."""
    found = []
    if age := rules.get("age"):
        found.append(("age", AGE, tuple(age[k] for k in ("field", "unit_field") if age.get(k)), age))
    if sex := rules.get("sex"):
        found.append(("sex", SEX, (sex["field"],), sex))
    return found + [("date", tuple(f"{name}{x}" for x in DATE_SUFFIXES), (name,), rules) for name in rules.get("dates", ())]


def inputs(rules: Mapping[str, Any] | None) -> dict[str, tuple[str, ...]]:
    """Harmonised column -> the columns it comes from."""
    return {name: sources for _, names, sources, _ in groups(rules or {}) for name in names}


def confirmed(contexts: Sequence[Context], validated: Sequence[Mapping[str, Any]]) -> bool:
    """Whether every context is a validated source by scope, release and digest; no context is none."""
    known = {Context({k: v.get(k) for k in ("uf", "ano", "mes")}, v["release"], v["source_sha256"]).key() for v in validated}
    return bool(contexts) and {c.key() for c in contexts} <= known


def rules_hash(rules: Mapping[str, Any] | None) -> str:
    """Pins the rules that a result was made by: SHA-256 of their canonical JSON."""
    return hashlib.sha256(json.dumps(rules, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def projection(rules: Mapping[str, Any] | None, schema: T.StructType, contexts: Sequence[Context], formats: Mapping[str, str] | None = None, rule_version: str | None = None) -> Projection:
    """The columns that can be added to rows of a schema, and why others cannot.

    formats: patterns of date fields.  rule_version: refuse rules of another version.  Reasons: unsupported_dataset, unsupported_field,
    missing_source_field, unconfirmed_source_scope, unsupported_date_format.  Columns whose names differ by case only, and
    harmonised names that are taken, are errors.
    """
    own = {f.name.lower(): f for f in schema.fields}
    if len(own) < len(schema.fields):
        raise ValueError("columns differ by case only")
    version = (rules or {}).get("version")
    if rule_version is not None and rule_version != version:
        raise ValueError(f"rules of version {rule_version} are asked for, these are {version}")
    out = Projection(rule_version=version, metadata_hash=rules_hash(rules))
    if not rules:
        out.unavailable = dict.fromkeys((AGE[0], SEX[0]), "unsupported_dataset")
        return out
    if not rules.get("age"):
        out.unavailable[AGE[0]] = "unsupported_field"
    for kind, names, sources, rule in groups(rules):
        pattern = (formats or {}).get(sources[0])
        reasons = {
            "missing_source_field": not set(sources) <= set(own),
            "unconfirmed_source_scope": not confirmed(contexts, rule.get("validated_sources", rules.get("validated_sources", ()))),
            "unsupported_date_format": kind == "date" and pattern not in R.DATE_PATTERNS,
        }
        if why := next((r for r, true in reasons.items() if true), None):
            out.unavailable[names[0]] = why
            continue
        values = [F.col(f"`{own[s].name}`") for s in sources]
        if kind == "age":
            got = R.age(rule, *values)
            made = (got.years, got.status, got.quantity, got.unit)
        elif kind == "sex":
            made = R.sex(rule, values[0])
        else:
            made = R.date(values[0], pattern, "date" if isinstance(own[sources[0]].dataType, T.DateType) else "string")
        taken = {n for n, _ in out.columns} | set(own)
        if clash := [n for n in names if n.lower() in taken]:
            raise ValueError(f"harmonised columns are there already: {clash}")
        out.columns += zip(names, made, strict=True)
    return out
