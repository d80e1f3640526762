"""Reconciliation of the JSON documents of a population aggregate, in Spark.

An edition (a product and year) comes as five documents: its metadata, its
periods before and after the rest was fetched, the places there are, and the
population.  Each is parsed by a declared schema; what doesn't parse, doesn't
agree or isn't the latest edition is named, and only editions without a problem
have rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanilake.functions.text import whole_match

ROLES = ("metadata", "periods", "universe", "population", "periods_after")
LEVEL = "N6"  # places are municipalities

_BAD = "_bad"
SCHEMAS = {
    "metadata": f"id long, nivelTerritorial struct<Administrativo: array<string>>, variaveis array<struct<id: long, unidade: string>>, classificacoes array<struct<id: long, categorias: array<struct<id: long, nome: string>>>>, {_BAD} string",
    "periods": f"struct<d: array<struct<id: string, modificacao: string>>, {_BAD}: string>",
    "universe": f"struct<d: array<struct<id: string>>, {_BAD}: string>",
    "population": f"struct<d: array<struct<id: string, unidade: string, resultados: array<struct<series: array<struct<localidade: struct<id: string>, serie: map<string, string>>>>>>>, {_BAD}: string>",
}


@dataclass(frozen=True)
class Aggregate:
    """What an aggregate must be: its id, its variable and unit, and the classifications, each taken at its total (0)."""

    aggregate: int
    variable: int
    unit: str = "Pessoas"
    classifications: Mapping[int, int] = field(default_factory=dict)


def parsed(documents: DataFrame) -> DataFrame:
    """(edition, year, a column for each role) from rows of edition, year, role and body."""
    bodies = [F.max(F.when(F.col("role") == r, F.col("body"))).alias(f"{r}_body") for r in ROLES]
    copies = [F.count_if(F.col("role") == r).alias(f"{r}_n") for r in ROLES]
    one = documents.groupBy("edition", "year").agg(*bodies, *copies)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    for r in ROLES:
        body = F.col(f"{r}_body")
        kind = SCHEMAS[r.removesuffix("_after")]
        # lists are wrapped, so that a corrupt record has a column of its own
        one = one.withColumn(r, F.from_json(body if r == "metadata" else F.concat(F.lit('{"d":'), body, F.lit("}")), kind, options))
    return one


def period_of(periods: Column, year: Column) -> Column:
    """The periods of a year; one is due."""
    return F.filter(periods["d"], lambda p: p["id"] == year.cast("string"))


def findings(rule: Aggregate) -> list[Column]:
    """What can be wrong with an edition, in the order in which it is looked at; null where it isn't."""
    year, found = F.col("year"), []

    def no(true: Column, text: str) -> None:
        found.append(F.when(F.coalesce(true, F.lit(False)), text))

    for r in ROLES:
        no(F.col(f"{r}_n") != 1, f"{r}: one document is due")
        no((F.col(f"{r}_n") == 1) & (F.col(r).isNull() | F.col(r)[_BAD].isNotNull() | F.col(f"{r}_body").isNull()), f"{r}: not the JSON that is due")
    meta, periods, after, universe, population = (F.col(r) for r in ("metadata", "periods", "periods_after", "universe", "population"))
    no(meta["id"] != rule.aggregate, "metadata: another aggregate")
    no(~F.array_contains(meta["nivelTerritorial"]["Administrativo"], LEVEL), f"metadata: no {LEVEL} level")
    own = F.filter(meta["variaveis"], lambda v: v["id"] == rule.variable)
    no((F.size(own) != 1) | (F.get(own, F.lit(0))["unidade"] != rule.unit), "metadata: another variable or unit")
    wanted = F.array(*map(F.lit, sorted(rule.classifications))).cast("array<bigint>")
    no(F.array_sort(F.transform(meta["classificacoes"], lambda c: c["id"])) != wanted, "metadata: other classifications")
    total = lambda c: F.size(F.filter(c["categorias"], lambda k: (k["id"] == 0) & (k["nome"] == "Total"))) == 1
    no(~F.forall(meta["classificacoes"], total), "metadata: a classification without one total")
    ids = F.transform(periods["d"], lambda p: p["id"])
    no(F.size(ids) == 0, "periods: none")
    no(~F.forall(ids, lambda x: whole_match(F.coalesce(x, F.lit("")), "[0-9]{4}")) | (F.size(F.array_distinct(ids)) != F.size(ids)), "periods: malformed or twice")
    no(F.size(period_of(periods, year)) != 1, "periods: the year isn't there")
    revision = F.get(period_of(periods, year), F.lit(0))["modificacao"]
    no((F.size(period_of(periods, year)) == 1) & F.try_to_timestamp(revision, F.lit("dd/MM/yyyy")).isNull(), "periods: no date of revision")
    no(year.cast("string") != F.array_max(ids), "periods: not the latest edition")
    no(~period_of(after, year).eqNullSafe(period_of(periods, year)) | ~F.array_max(F.transform(after["d"], lambda p: p["id"])).eqNullSafe(F.array_max(ids)), "periods: revised while it was fetched")
    places = F.transform(universe["d"], lambda p: p["id"])
    no((F.size(places) == 0) | (F.size(F.array_distinct(places)) != F.size(places)), "universe: no places, or one twice")
    no(F.size(population["d"]) != 1, "population: one variable is due")
    said = F.get(population["d"], F.lit(0))
    no((said["id"] != str(rule.variable)) | (said["unidade"] != rule.unit), "population: another variable or unit")
    series = F.flatten(F.transform(said["resultados"], lambda r: r["series"]))
    no(F.array_sort(F.transform(series, lambda s: s["localidade"]["id"])) != F.array_sort(places), "population: other places than there are")
    no(~F.forall(series, lambda s: whole_match(F.coalesce(F.element_at(s["serie"], year.cast("string")), F.lit("")), "[0-9]{1,18}")), "population: not a number")
    return found


def problems(documents: DataFrame, rule: Aggregate) -> DataFrame:
    """(edition, year, problem) of all that is wrong; an edition without rows here can be published."""
    return parsed(documents).select("edition", "year", F.explode(F.array_compact(F.array(*findings(rule)))).alias("problem"))


def reconciled(documents: DataFrame, rule: Aggregate, strict: bool = True) -> DataFrame:
    """(edition, year, code, population, revision) of the editions in which all documents agree.

    strict: an edition with a problem stops the query and its first problem is
    said; else it has no rows.
    """
    seen = parsed(documents).withColumn("problem", F.coalesce(*findings(rule)))
    ok = F.col("problem").isNull()
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat_ws(" ", "edition", F.col("year").cast("string"), "problem")).cast("boolean"))
    year = F.col("year").cast("string")
    revision = F.to_date(F.get(period_of(F.col("periods"), F.col("year")), F.lit(0))["modificacao"], "dd/MM/yyyy")
    series = F.flatten(F.transform(F.get(F.col("population.d"), F.lit(0))["resultados"], lambda r: r["series"]))
    rows = seen.where(ok).select("edition", "year", revision.alias("revision"), F.explode(series).alias("s"))
    return rows.select("edition", "year", F.col("s.localidade.id").alias("code"), F.element_at("s.serie", year).cast("long").alias("population"), "revision")

