"""The registry of data sets and their dictionaries as tables.

A registry is one JSON document for each data set.  It is read once with a
declared schema and projected into tables: data sets, fields, codes,
references and claims.  A claim says how a value of a field was reviewed and
holds the hash of the value it was made for, so a value that changed since is found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.functions.canonical import canonical_sha256, parser_version



def struct(text: str = "", **kinds: T.DataType) -> T.StructType:
    """A struct of text fields, by name, and of others."""
    return T.StructType([*(T.StructField(n, T.StringType()) for n in text.split()), *(T.StructField(n, k) for n, k in kinds.items())])


MONTH = struct(year=T.IntegerType(), month=T.IntegerType())
SCOPE = T.StructType([T.StructField("uf", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("ano", "mes")), *struct("release source_sha256")])
CODE, REFERENCE, EVIDENCE = struct("value label missing_kind"), struct("table key"), struct("source_id locator")
CLAIM = struct("target value_sha256 status", evidence=T.ArrayType(EVIDENCE))
FIELD = struct("name label description type unit format", codes=T.ArrayType(CODE), references=T.ArrayType(REFERENCE), claims=T.ArrayType(CLAIM))
DOCUMENT = struct("name title version encoding geography cadence prefix folder preliminary_folder", identity=T.MapType(T.StringType(), T.StringType()), coverage=struct(first=MONTH, last=MONTH), validated=T.ArrayType(SCOPE), fields=T.ArrayType(FIELD))
SOURCE = struct("id title authority url")

#: Values of a field that a claim can be about.
TARGETS = ("name", "label", "description", "type", "unit", "format", "codes", "references")


class RegistryError(ValueError):
    """A registry contradicts itself."""


def period(at: Column, cadence: Column) -> Column:
    """2014-08 of a monthly data set, 2014 of another; null stays null."""
    return F.when(cadence == "monthly", F.format_string("%04d-%02d", at["year"], at["month"])).otherwise(at["year"].cast("string"))


def scope_name(scope: Column) -> Column:
    """RR_2023_01; a scope of the whole country begins with `national`."""
    return F.concat_ws("_", F.coalesce(scope["uf"], F.lit("national")), scope["ano"].cast("string"), F.lpad(scope["mes"].cast("string"), 2, "0"))


@dataclass
class Registry:
    """documents: rows of DOCUMENT.  sources: rows of SOURCE that evidence refers to."""

    documents: DataFrame
    sources: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, documents: str, sources: str) -> Registry:
        """From JSON files, a document each.  What the schema doesn't allow stops the query."""
        strict = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        return cls(strict.schema(DOCUMENT).json(documents), strict.schema(SOURCE).json(sources))

    def datasets(self) -> DataFrame:
        """One row for each data set: what it is, how it is published and since when."""
        d, each = self.documents, F.coalesce("fields", F.array().cast(DOCUMENT["fields"].dataType))
        return d.select(
            "name",
            F.upper(F.substring_index("name", "_", 1)).alias("category"),
            "title",
            "geography",
            "cadence",
            period(F.col("coverage.first"), F.col("cadence")).alias("coverage_start"),
            F.when(F.col("coverage.last").isNotNull(), period(F.col("coverage.last"), F.col("cadence"))).alias("coverage_end"),
            "prefix",
            "folder",
            "preliminary_folder",
            F.size(each).cast("long").alias("fields"),
            F.size(F.filter(each, lambda f: F.coalesce(F.size(f["codes"]), F.lit(0)) > 0)).cast("long").alias("labelled_fields"),
            F.coalesce(F.transform("validated", scope_name), F.array().cast("array<string>")).alias("validated_scopes"),
            parser_version(F.col("encoding"), F.col("identity")).alias("parser_version"),
        )

    @cached_property
    def each_field(self) -> DataFrame:
        return self.documents.select(F.col("name").alias("dataset"), F.posexplode("fields").alias("place", "f"))

    def fields(self) -> DataFrame:
        """One row for each field, in the order of the dictionary by place."""
        f, codes = F.col("f"), F.coalesce(F.size("f.codes"), F.lit(0))
        kind = F.when(codes > 0, "enum").when(F.size("f.references") > 0, "reference").otherwise("unknown")
        return self.each_field.select("dataset", "place", F.concat_ws(".", "dataset", f["name"]).alias("id"), *(f[c].alias(c) for c in TARGETS[:6]), codes.cast("long").alias("n_codes"), kind.alias("domain"))

    def codes(self) -> DataFrame:
        """One row for each code; without a kind of missing value it is `unknown`."""
        each = self.each_field.select("dataset", F.col("f.name").alias("field"), F.posexplode("f.codes").alias("place", "c"))
        return each.select("dataset", "field", "place", "c.value", "c.label", F.coalesce("c.missing_kind", F.lit("unknown")).alias("missing_kind"))

    def references(self) -> DataFrame:
        each = self.each_field.select("dataset", F.col("f.name").alias("field"), F.explode("f.references").alias("r"))
        return each.select("dataset", "field", "r.table", "r.key")

    def claims(self) -> DataFrame:
        """One row for each value of each field: its hash, and the review made of it, if any.

        status is `unreviewed` where there is no claim; claimed_sha256 is that of the claim.
        """
        kinds = {f.name: f.dataType for f in FIELD}
        hashes = F.array(*(F.struct(F.lit(f"/field/{c}").alias("target"), canonical_sha256(F.col("f")[c], kinds[c], absent_nulls=True).alias("value_sha256")) for c in TARGETS))
        values = self.each_field.select("dataset", F.col("f.name").alias("field"), F.col("f.claims").alias("claims"), F.explode(hashes).alias("v"))
        own = F.filter("claims", lambda c: c["target"] == F.col("v.target"))
        claim = F.get(own, F.lit(0))
        status = F.coalesce(claim["status"], F.lit("unreviewed"))
        return values.select("dataset", "field", "v.target", "v.value_sha256", status.alias("status"), claim["value_sha256"].alias("claimed_sha256"), F.coalesce(F.size(own), F.lit(0)).alias("claims"), F.transform(claim["evidence"], lambda e: e["source_id"]).alias("evidence"))

    def problems(self) -> DataFrame:
        """(dataset, field, problem) of all that contradicts itself."""
        said = lambda text, *c: F.concat(F.lit(text), *c).alias("problem")
        no_field = F.lit(None).cast("string").alias("field")
        counted = self.documents.groupBy(F.col("name").alias("dataset")).count().where("count > 1").select("dataset", no_field, said("two documents"))
        sources = self.sources.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("authority") == "official").alias("official"))
        twice = sources.where("n > 1").select(F.lit(None).cast("string").alias("dataset"), no_field, said("a source twice: ", F.col("id")))
        f = self.each_field
        names = f.groupBy("dataset", F.col("f.name").alias("field")).count().where("count > 1").select("dataset", "field", said("a field twice"))
        codes = self.codes().groupBy("dataset", "field", "value").count().where("count > 1").select("dataset", "field", said("a code twice: ", F.col("value")))
        made = f.select("dataset", F.col("f.name").alias("field"), F.explode("f.claims").alias("c"))
        known = [f"/field/{c}" for c in TARGETS]
        strange = made.where(~F.col("c.target").isin(known)).select("dataset", "field", said("a claim about nothing: ", F.col("c.target")))
        again = made.groupBy("dataset", "field", "c.target").count().where("count > 1").select("dataset", "field", said("two claims about ", F.col("target")))
        claims = self.claims()
        changed = claims.where("claimed_sha256 <> value_sha256").select("dataset", "field", said("changed since it was reviewed: ", F.col("target")))
        bare = claims.where("status = 'verified_in_source' and coalesce(size(evidence), 0) = 0").select("dataset", "field", said("verified without evidence: ", F.col("target")))
        used = claims.select("dataset", "field", "status", F.explode("evidence").alias("id")).join(sources, "id", "left")
        lost = used.where("n is null").select("dataset", "field", said("no such source: ", F.col("id")))
        weak = used.where("status = 'verified_in_source' and not official").select("dataset", "field", said("verified by a source that isn't official: ", F.col("id")))
        out = counted
        for more in (twice, names, codes, strange, again, changed, bare, lost, weak):
            out = out.unionByName(more)
        return out

    def checked(self) -> Registry:
        """The registry, if nothing in it contradicts itself."""
        for r in self.problems().orderBy("dataset", "field", "problem").limit(1).collect():
            raise RegistryError(f"{r['dataset']}.{r['field']}: {r['problem']}")
        return self

    def described(self) -> DataFrame:
        """Each document with its sources and a hash that pins all of it: (name, document, sources, metadata_hash)."""
        used = self.claims().select(F.col("dataset").alias("name"), F.explode("evidence").alias("id")).distinct().join(self.sources, "id")
        cited = used.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(*SOURCE.names))).alias("sources"))
        whole = self.documents.select("name", F.struct(*DOCUMENT.names).alias("document")).join(cited, "name", "left")
        whole = whole.withColumn("sources", F.coalesce("sources", F.array().cast(T.ArrayType(SOURCE))))
        kind = T.StructType([T.StructField("document", DOCUMENT), T.StructField("sources", T.ArrayType(SOURCE))])
        return whole.withColumn("metadata_hash", canonical_sha256(F.struct("document", "sources"), kind, absent_nulls=True))

    def resolve(self, name: str) -> DataFrame:
        """The description of one data set; an unknown name is refused."""
        found = self.described().where(F.col("name") == name)
        if found.isEmpty():
            raise KeyError(name)
        return found
