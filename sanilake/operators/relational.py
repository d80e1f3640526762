"""Filters, joins, aggregates and windows over health tables.

Each function is DataFrame in, DataFrame out, and leaves physical choices to
Spark.  A side is broadcast only where its size is fixed (a list of scopes, of
ranges, of codes given by the caller).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.functions.text import as_text


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(column: Column | str, value: Any) -> Column:
    """Null-safe equality with a value."""
    return (F.col(column) if isinstance(column, str) else column).eqNullSafe(F.lit(value))


def in_scope(scope: Mapping[str, Any]) -> Column:
    """Rows of one scope: every column equals its value, null included.  Prunes partitions."""
    return reduce(Column.__and__, (same(c, v) for c, v in scope.items()))


def in_scopes(scopes: Sequence[Mapping[str, Any]]) -> Column:
    """Rows of any of the scopes; no scope, no rows."""
    return reduce(Column.__or__, (in_scope(s) for s in scopes), F.lit(False))


def with_tuples(df: DataFrame, columns: Sequence[str], tuples: Sequence[Sequence[Any]]) -> DataFrame:
    """Rows whose columns are one of the tuples, by a semi join with the given list."""
    asked = df.sparkSession.createDataFrame([tuple(t) for t in tuples], df.select(*columns).schema)
    return df.join(F.broadcast(asked), list(columns), "left_semi")


def within_coverage(year: Column, month: Column, first: tuple[int, int], last: tuple[int, int] | None = None) -> Column:
    """Whether a (year, month) lies in a window; without a last month it is open."""
    at = year * 12 + month
    low = at >= first[0] * 12 + first[1]
    return low if last is None else low & (at <= last[0] * 12 + last[1])


def in_months(column: str, first: tuple[int, int], last: tuple[int, int] | None = None) -> Column:
    """The same of a date or timestamp column, as a range that reaches the scan."""
    start = F.col(column) >= F.lit(f"{first[0]:04d}-{first[1]:02d}-01").cast("date")
    if last is None:
        return start
    after = (last[0], last[1] + 1) if last[1] < 12 else (last[0] + 1, 1)
    return start & (F.col(column) < F.lit(f"{after[0]:04d}-{after[1]:02d}-01").cast("date"))


def reference_join(df: DataFrame, reference: DataFrame, on: Mapping[str, str], rule: Column | None = None, prefix: str = "ref_") -> DataFrame:
    """Left join of a code column with a vocabulary; rule adds a condition to the join.

    Columns of the vocabulary get a prefix, so names don't clash.
    """
    named = reference.select(*(F.col(f"`{c}`").alias(prefix + c) for c in reference.columns))
    condition = reduce(Column.__and__, (F.col(f"`{a}`") == F.col(f"`{prefix}{b}`") for a, b in on.items()))
    return df.join(named, condition if rule is None else condition & rule, "left")


def reference_join_sql(column: str, table: str, key: str, data: str = "d", alias: str = "r", rule: str | None = None) -> str:
    """The same join as SQL text, for spark.sql()."""
    q = lambda name: "`" + name.replace("`", "``") + "`"
    more = f" AND ({rule.format(d=data, r=alias)})" if rule else ""
    return f"LEFT JOIN {q(table)} AS {alias} ON {data}.{q(column)} = {alias}.{q(key)}{more}"


def mark(df: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Adds whether each row's key occurs in other; null keys never do."""
    keys = other.select(*on).dropna().distinct().withColumn(flag, F.lit(True))
    return df.join(keys, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


MOST_RANGES = 100_000  # that are sent to all tasks


def range_join(df: DataFrame, value: str, ranges: DataFrame, first: str = "first", last: str = "last", most: int = MOST_RANGES) -> DataFrame:
    """Left join of a value with the ranges that hold it.

    A value in no range keeps its row, with nulls.  Use exactly_one() where one range is due.
    Up to `most` ranges are sent to all tasks.  More are dealt, as the values are, into
    stretches between bounds that are quantiles of where ranges begin; a range stands in
    each stretch that it reaches, so only rows of one stretch meet.
    """
    holds = F.col(value).between(F.col(first), F.col(last))
    if ranges.limit(most + 1).count() <= most:
        return df.join(F.broadcast(ranges), holds, "left")
    spark = df.sparkSession
    starts = ranges.select(first).dropna().distinct()
    bounds = range_bounds(starts, first, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = starts.schema[first].dataType.simpleString()
    named = F.broadcast(spark.createDataFrame([(bounds,)], f"_bounds array<{kind}>"))  # one row
    part = lambda c: in_range(F.col(c), F.col("_bounds"), len(bounds))
    left = df.crossJoin(named).withColumn("_part", F.when(F.col(value).isNotNull(), part(value))).drop("_bounds")
    right = ranges.where(F.col(first) <= F.col(last)).crossJoin(named).withColumn("_of", F.explode(F.sequence(part(first), part(last)))).drop("_bounds")
    return left.join(right, (F.col("_part") == F.col("_of")) & holds, "left").drop("_part", "_of")


def exactly_one(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """Fails when a key has more than one row, whatever columns are read later."""
    w = Window.partitionBy(*key)
    ok = F.when(F.count("*").over(w) > 1, F.raise_error(F.lit(f"more than one {what} for a key")).cast("boolean")).otherwise(True)
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")


def one_row_each(df: DataFrame, key: Sequence[str], columns: Sequence[str], what: str) -> DataFrame:
    """(key, columns) of keys that have one row; a key with more stops every read, whatever columns it reads.

    By aggregation, so that no key's rows are gathered.
    """
    per = df.groupBy(*key).agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in columns))
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"more than one {what} for a key")).cast("boolean"))
    return per.where(ok).select(*key, *columns)


def prefix_join(df: DataFrame, code: str, reference: DataFrame, prefix: str, n: int, suffix: str = "_ref") -> DataFrame:
    """Left join of the first n characters of a code with a reference of such prefixes.

    Codes are trimmed and compared in upper case; a shorter code joins with nothing.
    A prefix that the reference has twice stops reads of its columns.  Columns of the
    reference that df has too get a suffix.
    """
    cut = F.upper(F.btrim(as_text(code)))
    key = F.when(F.length(cut) >= n, F.substring(cut, 1, n))
    named = {c: c if c not in df.columns else c + suffix for c in reference.columns if c != prefix}
    once = one_row_each(reference.withColumn("_prefix", F.upper(F.btrim(as_text(prefix)))), ("_prefix",), tuple(named), f"reference of {prefix}")
    once = once.select("_prefix", *(F.col(f"`{c}`").alias(n_) for c, n_ in named.items()))
    return df.withColumn("_prefix", key).join(once, "_prefix", "left").drop("_prefix")


def difference(a: DataFrame, b: DataFrame, columns: Sequence[str], other: Sequence[str] | None = None) -> DataFrame:
    """The distinct values of a's columns that b doesn't have; null is a value.  other: b's names for them."""
    return a.select(*columns).subtract(b.select(*(F.col(f"`{o}`").alias(c) for c, o in zip(columns, other or columns, strict=True))))


def absent_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that a table doesn't have, compared without case and blanks, in their order."""
    have = {c.strip().lower() for c in df.columns}
    return [c for c in wanted if c.strip().lower() not in have]


def days_held(df: DataFrame, start: str, end: str, out: str = "day", n: str = "n") -> DataFrame:
    """How many rows hold each day from start to end; days that none holds are left out.

    Counts of beginnings and ends are summed along the days, so rows aren't expanded; what
    stands in one task is a row for each day of the calendar.
    """
    held = df.where(F.col(start) <= F.col(end))
    steps = held.select(F.explode(F.array(F.struct(F.col(start).alias(out), F.lit(1).alias("step")), F.struct(F.date_add(end, 1).alias(out), F.lit(-1).alias("step")))).alias("x"))
    steps = steps.select("x.*").groupBy(out).agg(F.sum("step").alias("step"))
    along = Window.orderBy(out)
    runs = steps.select(out, F.sum("step").over(along).alias(n), F.lead(out).over(along).alias("_until")).where(F.col(n) > 0)
    return runs.select(F.explode(F.sequence(F.col(out), F.date_sub("_until", 1))).alias(out), n)


def expand_days(df: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row for each day from start to end; none where end is earlier or a date is missing."""
    return df.where(F.col(start) <= F.col(end)).withColumn(out, F.explode(F.sequence(start, end)))


def latest_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of each key's latest period, equal rows once, with how many differ (`variants`).

    Periods are compared column by column, nulls last.
    """
    columns = list(columns or df.columns)
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    last = df.withColumn("_rank", F.dense_rank().over(w)).where("_rank = 1").select(*columns).distinct()
    return last.withColumn("variants", F.count("*").over(Window.partitionBy(*key)))


def latest_guarded(df: DataFrame, key: Sequence[str], period: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of each key's latest period, behind a guard.

    Equal rows of the latest period are one.  If it has rows that differ, or a
    part of its period is missing, every read of the result stops, whatever columns it
    reads: the guard is a filter over counts of the whole rows.  Null keys don't count.
    Rows are compared where they are, so no key's rows are gathered: two aggregates, no window.
    """
    part = [F.col(c) for c in period]
    # a missing part comes before all others, so it is the latest only where no row has it
    at = F.struct(*(x for k, c in enumerate(part) for x in (c.isNotNull().alias(f"h{k}"), c.alias(f"p{k}"))))
    rows = df.dropna(subset=list(key)).select(*key, *(c for c in columns if c not in key), at.alias("_at")).distinct()
    last = rows.groupBy(*key).agg(F.max("_at").alias("_last"))
    kept = rows.join(last, list(key)).where(F.col("_at") == F.col("_last"))
    others = [c for c in columns if c not in key]
    per = kept.groupBy(*key, "_last").agg(F.count("*").alias("_n"), F.min(F.struct(*others)).alias("_row"))
    whole = F.lit(True)
    for k in range(len(part)):
        whole = whole & F.col(f"_last.h{k}")
    guard = F.when((F.col("_n") == 1) & whole, True).otherwise(F.raise_error(F.lit(f"conflicting latest rows, or no {' or '.join(period)}")).cast("boolean"))
    return per.where(guard).select(*key, *(F.col(f"_row.{c}").alias(c) for c in others))


def register_latest(name: str, df: DataFrame, key: Sequence[str], period: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """latest_guarded() under a name for spark.sql(); refused now if the guard would stop a read."""
    found = latest_guarded(df, key, period, columns)
    found.select(*key).write.format("noop").mode("overwrite").save()
    found.createOrReplaceTempView(name)
    return found


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with new's rows in place of those with the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def mode(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """Each group's most frequent value, the smallest of equals; nulls don't count."""
    return df.groupBy(*by).agg(F.mode(column, deterministic=True).alias(out))


def whole_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column, null being a value; smallest of equals, null first."""
    return df.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc_nulls_first(column)).limit(1)


def share_of_total(df: DataFrame, by: Sequence[str], digits: int = 2) -> DataFrame:
    """Rows by key and their percentage of all rows.

    The total is an aggregate of the counts, joined back, so no task gets all rows.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("rows") / F.col("_all"), digits)).drop("_all")


def top_share(df: DataFrame, outer: Sequence[str], inner: str, digits: int = 2) -> DataFrame:
    """Within each outer group: rows, distinct inner values, and the share of the largest."""
    per = df.groupBy(*outer, inner).agg(F.count("*").alias("n"))
    return per.groupBy(*outer).agg(F.sum("n").alias("total"), F.count(inner).alias("n_distinct"), F.round(100.0 * F.max("n") / F.sum("n"), digits).alias("top_pct"))


def pivot_counts(df: DataFrame, by: Sequence[str], column: str, values: Sequence[Any]) -> DataFrame:
    """Counts by key with a column for each given value; absent combinations are 0."""
    cells = [F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(str(v)) for v in values]
    return df.groupBy(*by).agg(*cells)


def banded(value: Column, tops: Sequence[int]) -> Column:
    """Labels like 0-4, 5-14, 75+ from the first value of each band."""
    out = F.when(value.isNull() | (value < tops[0]), None)
    for low, high in zip(tops, [*tops[1:], None], strict=True):
        out = out.when(value >= low, f"{low}+") if high is None else out.when((value >= low) & (value < high), f"{low}-{high - 1}")
    return out


def duplicated_share(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Percentage of rows whose key occurs more than once."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(F.round(100.0 * F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1)), 1).alias("pct_duplicated"))


def characters(df: DataFrame, column: str) -> DataFrame:
    """How often each character occurs in a text column."""
    return df.select(F.explode(F.split(as_text(column), "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


def lengths(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.length(as_text(column)).alias("length")).agg(F.count("*").alias("n"))


def range_bounds(keys: DataFrame, key: str, parts: int, per_part: int = 20) -> list:
    """Up to parts - 1 values that deal distinct keys into ranges of about equal shares.

    They are quantiles of the per_part * parts keys with the smallest hashes: a
    sample of a size that doesn't depend on the number of keys, and the same each time.
    """
    sample = [r[0] for r in keys.select(key).orderBy(F.xxhash64(key), key).limit(per_part * parts).collect()]
    sample.sort()
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


def in_range(column: Column, bounds: Column, n: int) -> Column:
    """How many of n sorted bounds lie below a value, by halving steps over one array."""
    steps = [F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)]
    if not n:
        return F.lit(0)
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < column, at + step).otherwise(at))


def next_key(df: DataFrame, key: str, out: str = "next_key", parts: int | None = None) -> DataFrame:
    """(key, next): each distinct key with the one that follows it; the last has none.

    Keys are dealt into ranges (as many as shuffle partitions, unless given), so
    each range orders its own; the first key of every range, a row each, closes
    the gaps between them.  The bounds are one array in the plan, sought by
    halving, so any number of ranges makes the same plan and whatever task runs again
    deals alike.  Null keys don't count.
    """
    spark = df.sparkSession
    keys = df.select(key).dropna().distinct()
    parts = max(1, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = range_bounds(keys, key, parts)
    kind = keys.schema[key].dataType.simpleString()
    named = spark.createDataFrame([(bounds,)], f"bounds array<{kind}>").select(F.col("bounds").alias("_bounds"))  # one row
    dealt = keys.select(F.col(key).alias("_key")).crossJoin(F.broadcast(named)).select("_key", in_range(F.col("_key"), F.col("_bounds"), len(bounds)).alias("_part"))
    firsts = dealt.groupBy("_part").agg(F.min("_key").alias("_first"))  # a row for each range
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    inside = dealt.withColumn("_next", F.lead("_key").over(Window.partitionBy("_part").orderBy("_key")))
    return inside.join(F.broadcast(after), "_part", "left").select(F.col("_key").alias(key), F.coalesce("_next", "_after").alias(out))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, numbers widened to a common type, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Families of types in which the later one holds the earlier ones.
LADDERS = (("boolean", "tinyint", "smallint", "int", "bigint", "float", "double"), ("date", "timestamp_ntz", "timestamp"))


def supertype(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type that values of all given types are turned into.

    Nulls take any type.  Whole numbers and booleans go to the widest of them;
    with a float or double to double; with decimals to a decimal with room for both;
    decimals and doubles to double.  Dates and timestamps go to the widest.  Equal arrays,
    structs and the like stay.  Any other mix is text, as is a decimal that has no room.
    """
    real = list({k.json(): k for k in kinds if not isinstance(k, T.NullType)}.values())
    if not real:
        return T.NullType()
    if len(real) == 1:
        return real[0]
    names = {k.simpleString() for k in real}
    for ladder in LADDERS:
        if names <= set(ladder):
            top = max(names, key=ladder.index)
            return T.DoubleType() if top in ("float", "double") else next(k for k in real if k.simpleString() == top)
    decimals = [k for k in real if isinstance(k, T.DecimalType)]
    rest = names - {k.simpleString() for k in decimals}
    if decimals and rest <= {"boolean", "tinyint", "smallint", "int", "bigint"}:
        digits = {"boolean": 1, "tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
        scale = max(k.scale for k in decimals)
        whole = max([k.precision - k.scale for k in decimals] + [digits[n] for n in rest])
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if decimals and rest <= set(LADDERS[0]):
        return T.DoubleType()
    return T.StringType()


def concat_relaxed(frames: Sequence[DataFrame], absent: str = "refuse") -> DataFrame:
    """All rows of all frames, each column in the supertype of its types over all frames.

    Types are settled once for all frames, so their order doesn't matter.
    Columns are matched by name, in the order of first appearance.  absent: `refuse`
    a frame that lacks a column, or `null`.  Text of dates is ISO, that of decimals has
    their scale, that of booleans is true or false.
    """
    kinds: dict[str, list[T.DataType]] = {}
    for k, df in enumerate(frames):
        if len(set(df.columns)) < len(df.columns):
            raise ValueError(f"frame {k} has a column twice")
        for f in df.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    for k, df in enumerate(frames):
        if lacking := [c for c in kinds if c not in df.columns]:
            if absent != "null":
                raise ValueError(f"frame {k} has no column {lacking[0]!r}")
    types = {c: supertype(k) for c, k in kinds.items()}
    cast = [df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items())) for df in frames]
    return reduce(DataFrame.unionAll, cast)
