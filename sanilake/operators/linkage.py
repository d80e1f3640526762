"""Deterministic record linkage in passes, with negative controls.

Records need an `id`.  A pass links records whose keys are filled and occur
once on either side; later passes see only what is left.  A control runs the
same pass with one key shifted, so the pairs that it finds are chance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanilake.operators.relational import next_key


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, keys) of the rows whose keys are filled and occur once.

    By aggregation: a key's rows are counted where they are before they are shuffled.
    """
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("_n")).where("_n = 1").select("id", *keys)


def link(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, id_b, keys) of records whose keys occur once in a and once in b."""
    return unique_by(a, keys).join(unique_by(b, keys).withColumnRenamed("id", "id_b"), list(keys)).select("id", "id_b", *keys)


@dataclass
class Linkage:
    pairs: DataFrame  # id, id_b, step
    report: DataFrame  # step, keys, pairs, control_pairs, pct_by_chance


def link_in_steps(a: DataFrame, b: DataFrame, steps: Sequence[Sequence[str]], shift: str, by: Column | None = None, checkpoint: bool = True) -> Linkage:
    """Links in steps; each uses only records that no earlier step linked.

    shift names the column that the control changes, by gives its new value
    (a week later, if not given).  With checkpoint, pairs of each step are
    written to the session's checkpoint folder, so plans stay short.
    """
    spark = a.sparkSession
    shifted = F.date_add(shift, 7) if by is None else by
    cut = checkpoint and (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    pairs, reports = None, []
    for step, keys in enumerate(steps, start=1):
        rest_a = a if pairs is None else a.join(pairs.select("id"), "id", "left_anti")
        rest_b = b if pairs is None else b.join(pairs.select(F.col("id_b").alias("id")), "id", "left_anti")
        found = link(rest_a, rest_b, keys).select("id", "id_b", F.lit(step).alias("step"))
        found = found.checkpoint() if cut else found
        control = link(rest_a.withColumn(shift, shifted), rest_b, keys)
        counts = found.agg(F.count("*").alias("pairs")).crossJoin(control.agg(F.count("*").alias("control_pairs")))
        reports.append(counts.select(F.lit(step).alias("step"), F.lit(" + ".join(keys)).alias("keys"), "pairs", "control_pairs"))
        pairs = found if pairs is None else pairs.unionByName(found)
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    chance = F.when(F.col("pairs") > 0, F.round(100.0 * F.col("control_pairs") / F.col("pairs"), 1))
    return Linkage(pairs, report.withColumn("pct_by_chance", chance))


def unlinked_reasons(a: DataFrame, b: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, reason) of every record of a that no pair has: the first reason that applies.

    In order: a key that is missing (each key by name, as given), a key that
    several records of a share, one that no record of b has, one that several of b share, and
    `linked otherwise` where the keys meet once on either side.  One pass over the
    records with two counts; the keys are counted before they are joined.
    """
    names = list(keys)
    counted = lambda df, n: df.dropna(subset=names).groupBy(*names).agg(F.count("*").alias(n))
    left = a.join(pairs.select("id").distinct(), "id", "left_anti").select("id", *names)
    flags = left.join(counted(a, "_in_a"), names, "left").join(counted(b, "_in_b"), names, "left")
    reasons = [F.when(F.col(k).isNull(), f"no {k}") for k in names]
    reasons += [F.when(F.col("_in_a") > 1, "several with these keys"), F.when(F.col("_in_b").isNull(), "not on the other side"), F.when(F.col("_in_b") > 1, "several on the other side")]
    return flags.select("id", F.coalesce(*reasons, F.lit("linked otherwise")).alias("reason"))


def reason_report(reasons: DataFrame) -> DataFrame:
    """(reason, records, pct): the records add up to all that are unlinked."""
    counts = reasons.groupBy("reason").agg(F.count("*").alias("records"))
    total = counts.agg(F.sum("records").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "records", F.round(100.0 * F.col("records") / F.col("_all"), 1).alias("pct"))


def detail(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the columns of both sides, those of b with the suffix _b."""
    return pairs.join(a, "id").join(b.select(*(F.col(f"`{c}`").alias(f"{c}_b") for c in b.columns)), "id_b")


def pairs_by_key(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of an exact key, and those of its control, where each key is replaced by the next one."""
    other = b.select(*(F.col(f"`{c}`").alias(c if c == key else f"{c}_b") for c in b.columns))
    moved = a.join(next_key(a, key, "_next"), key, "left").drop(key).withColumnRenamed("_next", key)
    return a.join(other, key), moved.select(*a.columns).join(other, key)


def concordance(pairs: DataFrame, variables: Sequence[tuple[str, float | None]], informative: dict[str, Sequence] | None = None) -> DataFrame:
    """(variable, comparable, pct_equal) of column and column_b, for all variables in one pass.

    A tolerance allows numbers to differ; informative restricts a variable to some values.
    """
    cells = []
    for n, (name, tolerance) in enumerate(variables):
        x, y = F.col(f"`{name}`"), F.col(f"`{name}_b`")
        both = x.isNotNull() & y.isNotNull()
        if informative and name in informative:
            both = both & x.isin(list(informative[name])) & y.isin(list(informative[name]))
        equal = x == y if tolerance is None else F.abs(x - y) <= tolerance
        cells += [F.count_if(both).alias(f"n{n}"), F.count_if(both & equal).alias(f"e{n}")]
    one = pairs.agg(*cells)
    rows = [F.struct(F.lit(name if t is None else f"{name} (±{t:g})").alias("variable"), F.col(f"n{n}").alias("comparable"), F.round(100.0 * F.col(f"e{n}") / F.greatest(f"n{n}", F.lit(1)), 1).alias("pct_equal")) for n, (name, t) in enumerate(variables)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compare(real: DataFrame, control: DataFrame, variables: Sequence[tuple[str, float | None]]) -> DataFrame:
    """concordance() of real pairs, and beside it that of the control."""
    return concordance(real, variables).join(concordance(control, variables).select("variable", F.col("pct_equal").alias("pct_equal_control")), "variable")


def unique_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentage of rows with filled keys whose keys occur once."""
    per = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.round(100.0 * F.count_if(F.col("n") == 1) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)), 1).alias("pct_unique"))


def verdict(pairs: int, by_chance: float | None, validation: float | None) -> str:
    """What a linkage is good for, by limits set before the numbers are seen."""
    if not pairs or validation is None:
        return "não viável"
    for most_chance, least_valid, word in ((5, 90, "viável"), (20, 75, "com cautela")):
        if (by_chance or 0) <= most_chance and validation >= least_valid:
            return word
    return "não viável"


def summary(name: str, records: int, linkage: Linkage, validation: float | None) -> dict:
    """One line: pairs that count, those of discarded steps, the share by chance and the verdict.

    A step is discarded if over 20 % of it is chance, or its control finds as many pairs as it.
    """
    steps = [r.asDict() for r in linkage.report.orderBy("step").collect()]  # a row for each step
    bad = [s for s in steps if (s["pct_by_chance"] or 0) > 20 or 0 < s["control_pairs"] >= s["pairs"]]
    good = [s for s in steps if s not in bad]
    pairs, control = sum(s["pairs"] for s in good), sum(s["control_pairs"] for s in good)
    chance = round(100 * control / max(pairs, 1), 1)
    return {"linkage": name, "records": records, "pairs": pairs, "pct_linked": round(100 * pairs / max(records, 1), 1), "discarded_steps": [s["step"] for s in bad], "discarded_pairs": sum(s["pairs"] for s in bad), "control_pairs": control, "pct_by_chance": chance, "validation": validation, "verdict": verdict(pairs, chance, validation)}
