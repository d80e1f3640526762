"""How a table's schema grows: names and types of new files against those it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnsafeSchemaError(ValueError):
    """A type change that could lose values."""


FAMILIES = ((T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()), (T.FloatType(), T.DoubleType()))


def wider(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for family in FAMILIES:
        if a in family and b in family:
            return max(a, b, key=family.index)
    raise UnsafeSchemaError(f"column {name!r}: {a.simpleString()} and {b.simpleString()}")


def evolve(existing: T.StructType | None, incoming: T.StructType) -> T.StructType:
    """The table's schema after rows of incoming are added: shared columns widened, new ones last."""
    if existing is None:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in incoming])
    new = {f.name: f.dataType for f in incoming}
    fields = [T.StructField(f.name, wider(f.dataType, new.pop(f.name, f.dataType), f.name), True) for f in existing]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in new.items()])


def clean_names(df: DataFrame, scope: dict, reserved: tuple[str, ...] = ("_source_ano", "_source_release")) -> DataFrame:
    """Names trimmed and in lower case; clashes and reserved names are refused.

    A file column named like a part of the scope must have the scope's value in every row.
    """
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns have the same name in lower case")
    if taken := set(names) & set(reserved):
        raise ValueError(f"reserved column names: {sorted(taken)}")
    df = df.toDF(*names)
    for c, v in scope.items():
        if c in names:
            ok = F.when(F.col(c).cast("string").eqNullSafe(F.lit(v).cast("string")), True).otherwise(F.raise_error(F.lit(f"{c} is not {v} in every row")).cast("boolean"))
            df = df.where(ok).drop(c)
    return df


def with_library_columns(df: DataFrame, scope: dict, release: str) -> DataFrame:
    """Adds the scope's columns and _source_release."""
    kinds = {"uf": "string"}
    added = {c: F.lit(v).cast(kinds.get(c, "int")) for c, v in scope.items()}
    return clean_names(df, scope).withColumns(added | {"_source_release": F.lit(release)})


def text_where_declared(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Whole numbers declared string or date become text, those declared number become doubles."""
    kinds = {"string": "string", "date": "string", "number": "double"}
    out = {}
    for f in df.schema:
        kind = kinds.get(declared.get(f.name.lower(), ""))
        if kind and isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[f.name] = F.col(f"`{f.name}`").cast(kind)
    return df.withColumns(out) if out else df
