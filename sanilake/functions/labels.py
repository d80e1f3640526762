"""Codes and their labels.

A code map is a mapping from string or integer keys to labels.  Small maps
become literals of the plan, larger ones a table that is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanilake.functions.text import as_text, trim_all

LITERAL_CODES = 1000  # larger maps are joined


def literal_map(pairs: Mapping[Any, str]) -> Column:
    if not pairs:
        return F.expr("map()").cast("map<string,string>")
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def lookup(codes: Mapping[str | int, str], value: Column | str) -> Column:
    """The label of a code: as it is, stripped, or as a whole number; otherwise null.

    Only ASCII digits make a number.
    """
    raw = as_text(value)
    stripped = trim_all(raw)
    by_text = literal_map({k: v for k, v in codes.items() if isinstance(k, str)})
    by_number = {str(k): v for k, v in codes.items() if isinstance(k, int)}
    tries = [F.try_element_at(by_text, raw), F.try_element_at(by_text, stripped)]
    if by_number:
        digits = F.when(stripped.rlike(r"\A[0-9]+\z"), F.regexp_replace(stripped, r"\A0+(?=[0-9])", ""))
        tries.append(F.try_element_at(literal_map(by_number), digits))
    return F.coalesce(*tries)


def label(df: DataFrame, maps: Mapping[str, Mapping[str | int, str]], columns: Sequence[str] | None = None, suffix: str = "_rotulo") -> DataFrame:
    """Puts a label column right after each coded column.  Unknown codes have a null label."""
    own = {c.lower(): c for c in df.columns}
    asked = list(columns) if columns is not None else [c for c in df.columns if c.lower() in maps]
    for c in asked:
        if c.lower() not in own:
            raise ValueError(f"no column {c!r}")
        if c.lower() not in maps:
            raise ValueError(f"{c!r} has no code map")
    wanted = {c.lower() for c in asked}
    out: list[Column] = []
    joined = df
    for c in df.columns:
        out.append(F.col(f"`{c}`"))
        if c.lower() not in wanted:
            continue
        codes = maps[c.lower()]
        if len(codes) <= LITERAL_CODES:
            out.append(lookup(codes, F.col(f"`{c}`")).alias(c + suffix))
            continue
        joined = join_labels(joined, c, codes, f"_label_{len(out)}")
        out.append(F.col(f"_label_{len(out) - 1}").alias(c + suffix))
    return joined.select(*out)


def join_labels(df: DataFrame, column: str, codes: Mapping[str | int, str], out: str) -> DataFrame:
    """lookup() by a join, for maps that are too large for a literal; Spark broadcasts them if they are small enough."""
    table = df.sparkSession.createDataFrame([(str(k), isinstance(k, int), v) for k, v in codes.items()], "key string, number boolean, label string")
    raw, stripped = as_text(F.col(f"`{column}`")), trim_all(F.col(f"`{column}`"))
    digits = F.when(stripped.rlike(r"\A[0-9]+\z"), F.regexp_replace(stripped, r"\A0+(?=[0-9])", ""))
    tries, found = [], df
    for n, (key, number) in enumerate(((raw, False), (stripped, False), (digits, True))):
        part = table.where(F.col("number") == number).select(F.col("key").alias(f"_key{n}"), F.col("label").alias(f"_try{n}"))
        found = found.join(part, key == F.col(f"_key{n}"), "left").drop(f"_key{n}")
        tries.append(f"_try{n}")
    return found.withColumn(out, F.coalesce(*tries)).drop(*tries)


def display_row(maps: Mapping[str, Mapping[str | int, str]], row: Mapping[str, Any]) -> dict[str, Any]:
    """A row with coded fields replaced by their labels, on the driver."""

    def named(field: str, value: Any) -> Any:
        codes = maps.get(field.lower())
        if codes is None or value is None:
            return value
        text = str(value)
        for key in (text, text.strip(), int(text) if text.strip().isascii() and text.strip().isdigit() else None):
            if key in codes:
                return codes[key]
        return value

    return {k: named(k, v) for k, v in row.items()}


def decode_coverage(df: DataFrame, maps: Mapping[str, Sequence[str | int] | Mapping[str | int, str]]) -> DataFrame:
    """(field, value, rows) of filled values that are not keys of their map, as exact text.

    All fields in one pass: values are unpivoted, counted, and those with a key dropped.
    """
    fields = [c for c in df.columns if c.lower() in maps]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, value string, rows long")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields))).alias("x")
    counted = df.select(values).select("x.*").where("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("rows"))
    keys = [(c, str(k)) for c in fields for k in maps[c.lower()]]
    table = df.sparkSession.createDataFrame(keys, "field string, value string")
    return counted.join(table, ["field", "value"], "left_anti")
