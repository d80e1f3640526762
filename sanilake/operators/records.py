"""Person, stay and birth tables, checks of registers, and audits of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanilake.functions.text import as_text
from sanilake.operators.relational import fresh


def spells(df: DataFrame, person: str, also: Sequence[str], at: str) -> DataFrame:
    """One row for each person and the columns that describe them: first and last time, and rows.  No person, no row."""
    known = df.where(F.col(person).isNotNull())
    return known.groupBy(person, *also).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"))


def profiles(df: DataFrame, person: str, modes: Sequence[str], least: Sequence[str]) -> DataFrame:
    """One row for each person: the most frequent value of some columns (the smallest of equals), the least of others."""
    known = df.where(F.col(person).isNotNull())
    return known.groupBy(person).agg(*(F.mode(c, deterministic=True).alias(c) for c in modes), *(F.min(c).alias(c) for c in least))


def resident_cases(df: DataFrame, residence: str, unit: str, outcome: Column, out: str = "died") -> DataFrame:
    """Cases of those who live in a unit (their place's code begins with its own), and whether the outcome is a death."""
    here = df.where(as_text(residence).startswith(unit))
    return here.withColumn(out, F.coalesce(F.lower(outcome).startswith("óbito"), F.lit(False)))


def births(df: DataFrame, by: Sequence[str], twin: Column, least: Sequence[str]) -> DataFrame:
    """Newborns of the same birth as one row: how many, whether all are marked as twins, least of other columns."""
    return df.groupBy(*by).agg(F.count("*").alias("newborns"), F.bool_and(F.coalesce(twin, F.lit(False))).alias("all_twins"), *(F.min(c).alias(c) for c in least))


def register_check(df: DataFrame, code: str, register: DataFrame, elsewhere: Column) -> DataFrame:
    """One row: % of filled codes that a register has, distinct codes that it lacks, % of the rows with those that happened elsewhere."""
    mark = fresh("known", df)
    known = register.select(F.col(code)).where(F.col(code).isNotNull()).distinct().withColumn(mark, F.lit(True))
    filled = df.where(F.col(code).isNotNull()).join(known, code, "left")
    lost = F.col(mark).isNull()
    pct = lambda part, whole: F.round(100.0 * F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1)), 1)
    return filled.agg(pct(~lost, F.lit(True)).alias("pct_known"), F.countDistinct(F.when(lost, F.col(code))).alias("codes_outside"), pct(lost & elsewhere, lost).alias("pct_elsewhere"))


def month_lag(a: DataFrame, b: DataFrame, key: str, month_a: str, month_b: str) -> DataFrame:
    """Pairs of an exact key by (year of b, months from a to b)."""
    one, two = ("a", "b") if key.lower() not in ("a", "b") else ("month_a", "month_b")
    both = a.select(key, F.col(month_a).alias(one)).join(b.select(key, F.col(month_b).alias(two)), key)
    index = lambda c: F.year(c) * 12 + F.month(c)
    return both.groupBy(F.year(two).alias("year"), (index(two) - index(one)).alias("months")).agg(F.count("*").alias("pairs"))


def acts_of_stays(stays: DataFrame, acts: DataFrame, key: str, what: str, value: str) -> DataFrame:
    """Each stay with its acts: how many, of how many kinds, least and total value; null without any."""
    per = acts.groupBy(key).agg(F.count("*").alias("acts"), F.countDistinct(what).alias("kinds"), F.min(value).alias("least"), F.sum(value).alias("total"))
    return stays.join(per, key, "left")


def common_columns(a: DataFrame, b: DataFrame, without: Sequence[str] = ()) -> list[str]:
    theirs = {c.lower() for c in b.columns} - {c.lower() for c in without}
    return [c for c in a.columns if c.lower() in theirs]


def subset_matches(a: DataFrame, b: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """How many rows of a have exactly one, no, or several rows of b with the same text in every common column.

    Null counts as blank.  Rows of b are counted by their texts first, so a row of a meets one row at most.
    """
    shared = common_columns(a, b, without)
    plain = [F.coalesce(as_text(F.col(f"`{c}`")), F.lit("")).alias(c) for c in shared]
    counted = b.select(*plain).groupBy(*shared).agg(F.count("*").alias(count := fresh("n", a)))
    n = F.coalesce(count, F.lit(0))
    return a.select(*plain).join(counted, shared, "left").agg(F.count_if(n == 1).alias("one"), F.count_if(n == 0).alias("none"), F.count_if(n > 1).alias("several"))


def shape_report(df: DataFrame, person: str, code: str) -> DataFrame:
    """One row for each length of a code: rows, persons, and persons that have several codes of that length."""
    per = df.where(F.col(code).isNotNull()).groupBy(F.length(as_text(code)).alias("length"), person).agg(F.count("*").alias("n"), F.countDistinct(code).alias("codes"))
    return per.groupBy("length").agg(F.sum("n").alias("rows"), F.count(person).alias("persons"), F.count_if(F.col("codes") > 1).alias("with_several"))


def with_record_id(df: DataFrame, out: str = "record_id") -> DataFrame:
    """A digest of the row's values as its id, with the number of the copy behind it.

    Spark's rows have no stable order, so an id says what a row holds and not where it stood;
    equal rows are numbered, and it doesn't matter which is which.  Copies are counted where
    they are and written out again from one of them, so a row's copies aren't gathered.  A column with the
    name of the id gives way.
    """
    own = [c for c in df.columns if c.lower() != out.lower()]
    said = [F.coalesce(F.concat(F.length(as_text(F.col(f"`{c}`"))), F.lit(":"), as_text(F.col(f"`{c}`"))), F.lit("-")) for c in own]
    each = df.select(F.sha2(F.concat_ws(",", *said), 256).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    each = each.groupBy("digest").agg(F.any_value("row").alias("row"), F.count("*").alias("copies"))
    each = each.select("digest", "row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.select("row.*", F.concat("digest", F.lit("-"), F.col("copy").cast("string")).alias(out))


def acceptance_audit(df: DataFrame, expected: Sequence[str], statuses: Mapping[str, Column], ages: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """One row: columns that are missing or not expected, counts by status of each rule, ages that aren't those of the dates, and whether the file is blocked.

    ages: completed years as coded, date of birth, date of the event; compared where all three are there.
    A file is blocked if its columns differ or a rule has unsupported values.
    """
    own = {c.lower() for c in df.columns}
    differ = sorted(own ^ {c.lower() for c in expected})
    kinds = ("valid", "missing", "ignored", "invalid", "unsupported")
    counts = [F.count_if(status == kind).alias(f"{name}_{kind}") for name, status in statuses.items() for kind in kinds]
    if ages:
        years, born, at = ages
        exact = F.year(at) - F.year(born) - (F.date_format(at, "MMdd") < F.date_format(born, "MMdd")).cast("int")
        counts += [F.count(years + exact).alias("ages_compared"), F.count_if(years != exact).alias("ages_differ")]
    found = df.agg(F.count("*").alias("rows"), *counts)
    unsupported = [F.col(f"{name}_unsupported") > 0 for name in statuses]
    blocked = F.lit(bool(differ))
    for x in unsupported:
        blocked = blocked | x
    return found.withColumns({"columns_that_differ": F.lit(",".join(differ)), "blocked": blocked})
