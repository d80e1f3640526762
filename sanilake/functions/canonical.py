"""Canonical JSON of columns, and its SHA-256.

The text is compact, keys are in order, nothing outside ASCII is escaped: what
json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
writes.  It is compiled from a column's type to built-in functions, so equal values have
equal hashes whatever the order of a struct's fields or a map's entries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of JSON text, the backslash first.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column) -> Column:
    """A JSON string; control characters without a short escape as \\u00xx."""
    rare = {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in ESCAPES}
    replaced = lambda found: lambda x: reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), found.items(), x)
    usual = F.when(text.rlike(r'["\\\n\r\t\x08\f]'), replaced(ESCAPES)(text)).otherwise(text)
    # controls without a short escape are none of the usual ones, so the order doesn't matter
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), replaced(rare)(usual)).otherwise(usual), F.lit('"'))


def decimal_text(number: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 to below 1e16, else with an exponent of two digits or more.

    The digits are the JVM's: the shortest that read back, but for rare values
    on a JVM before 19.
    """
    text = number.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(text, r"^-|E.*$", ""), r"\.0$", "")
    whole = F.substring_index(digits, ".", 1)
    fraction = F.when(digits.contains("."), F.substring_index(digits, ".", -1)).otherwise("")
    shift = F.coalesce(F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")), F.lit(0))
    every = F.concat(whole, fraction)
    leading = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    mantissa = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    point = F.length(whole) + shift - leading  # where the point stands in the digits without zeros
    size = F.length(mantissa)
    exponent = point - 1
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substr(mantissa, F.lit(1), F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substr(mantissa, F.lit(2)))).otherwise(""), F.lit("e"), power)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.negate(point)), mantissa)
    large = F.concat(mantissa, F.repeat(F.lit("0"), point - size), F.lit(".0"))
    mixed = F.concat(F.substr(mantissa, F.lit(1), point), F.lit("."), F.substr(mantissa, point + 1))
    laid_out = F.when(size == 0, "0.0").when((exponent < -4) | (exponent >= 16), scientific).when(point <= 0, small).when(point >= size, large).otherwise(mixed)
    odd = F.isnan(number) | number.isin(float("inf"), float("-inf"))
    return F.when(odd, F.raise_error(F.lit("canonical JSON has no NaN or infinity"))).otherwise(F.concat(sign, laid_out))


def compiled(kind: T.DataType, absent_nulls: bool) -> Callable[[Column], Column]:
    """The text of a value that isn't null."""
    inner = lambda k: lambda x: F.when(x.isNull(), "null").otherwise(compiled(k, absent_nulls)(x))
    listed = lambda items, a, b: F.concat(F.lit(a), F.array_join(items, ","), F.lit(b))
    if isinstance(kind, T.StringType):
        return quoted
    if isinstance(kind, T.BooleanType):
        return lambda x: F.when(x, "true").otherwise("false")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda x: decimal_text(x.cast("double"))
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return lambda x: x.cast("string")
    if isinstance(kind, T.DateType):
        return lambda x: F.concat(F.lit('"'), F.date_format(x, "yyyy-MM-dd"), F.lit('"'))
    if isinstance(kind, T.ArrayType):
        return lambda x: listed(F.transform(x, inner(kind.elementType)), "[", "]")
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), inner(kind.valueType)(e["value"]))
        return lambda x: listed(F.transform(F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), entry), "{", "}")
    if isinstance(kind, T.StructType):
        fields = sorted(kind, key=lambda f: f.name)

        def pairs(x: Column) -> Column:
            def one(f: T.StructField) -> Column:
                value = x.getField(f.name)
                text = F.concat(quoted(F.lit(f.name)), F.lit(":"), inner(f.dataType)(value))
                return F.when(value.isNotNull(), text) if absent_nulls else text

            return listed(F.array_compact(F.array(*map(one, fields))) if fields else F.array().cast("array<string>"), "{", "}")

        return pairs
    raise TypeError(f"canonical JSON has no {kind.simpleString()}")


def canonical_json(value: Column, kind: T.DataType, absent_nulls: bool = False) -> Column:
    """The canonical text of a column of the given type; null is `null`.

    absent_nulls leaves null fields of structs out, as documents do that were
    read with a schema wider than they are.  Maps have text keys; dates are
    written as text; binary and timestamps are refused.
    """
    return F.when(value.isNull(), "null").otherwise(compiled(kind, absent_nulls)(value))


def canonical_sha256(value: Column, kind: T.DataType, absent_nulls: bool = False) -> Column:
    return F.sha2(canonical_json(value, kind, absent_nulls).cast("binary"), 256)


# ---------------------------------------------------------------- scopes

SCOPE = T.StructType([T.StructField("ano", T.IntegerType()), T.StructField("mes", T.IntegerType()), T.StructField("uf", T.StringType())])


def scope_json(scope: Column, kind: T.StructType = SCOPE) -> Column:
    """A scope as text that is the same for equal scopes; parts that don't apply are left out."""
    return canonical_json(scope, kind, absent_nulls=True)


def scope_of(text: Column, kind: T.StructType = SCOPE) -> Column:
    """The scope that scope_json() wrote.  Text that isn't one, or says more, stops the query."""
    read = F.from_json(text, kind)
    return F.when(text.isNull() | (scope_json(read, kind) == text), read).otherwise(F.raise_error(F.concat(F.lit("not a scope: "), text)))


# ---------------------------------------------------------------- parsers

CONTRACT = T.StructType([T.StructField("encoding", T.StringType()), T.StructField("identity", T.MapType(T.StringType(), T.StringType()))])
DECODER = "dbf-records-1"  # goes up when the same file is decoded to other rows


def parser_version(encoding: Column, identity: Column) -> Column:
    """What rows of a file depend on besides the file: how text is decoded and which files are accepted.

    identity: a map of text.  Labels, codes and reviews aren't part of it, so
    editing them leaves publications as they are.
    """
    contract = F.struct(encoding.alias("encoding"), identity.alias("identity"))
    return F.concat(F.lit(f"{DECODER}:"), canonical_sha256(contract, CONTRACT))
