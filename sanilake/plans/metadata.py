"""Queries over registries, canonical hashes, aggregates, vocabularies, guarded relations and unlinked records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.functions import text
from sanilake.functions.canonical import canonical_sha256
from sanilake.operators import linkage
from sanilake.operators import relational as rel
from sanilake.plans.catalog import register, table
from sanilake.plans.lake import with_sources
from sanilake.plans.scratch import scratch
from sanilake.sources import aggregates, dbc, vocabularies
from sanilake.sources.registry import DOCUMENT, FIELD, SOURCE, Registry

# ---------------------------------------------------------------- canonical hashes


@register("""
WITH o AS (SELECT o_custkey, list({'key': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1)
SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'orders': coalesce(orders, []), 'place': {'nation': c_nationkey, 'segment': c_mktsegment}})::VARCHAR) AS sha FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def canonical_hash(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    place = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))  # in no order
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    rows = rows.select("c_custkey", F.struct(place.alias("place"), "c_name", F.coalesce("orders", F.array().cast("array<struct<key:bigint,status:string>>")).alias("orders"), "c_custkey").alias("whole"))
    return rows.select("c_custkey", canonical_sha256(F.col("whole"), rows.schema["whole"].dataType).alias("sha"))


# ---------------------------------------------------------------- registry

#: table -> (code columns, date column, cadence)
CODED = {"orders": (("o_orderstatus", "o_orderpriority"), "o_orderdate", "monthly"), "lineitem": (("l_returnflag", "l_linestatus"), "l_shipdate", "yearly"), "customer": (("c_mktsegment",), None, "yearly"), "events": (("event_type",), "ts", "monthly")}


def observed_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """A registry of the code columns of tables: their codes as they occur, and the months that the tables cover."""
    codes_type = FIELD["codes"].dataType
    documents = []
    for name, (columns, date, cadence) in CODED.items():
        rows = table(spark, sf_dir, name)
        at = lambda best: F.struct(F.year(best).alias("year"), F.month(best).alias("month"))
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns))).alias("x")
        seen = rows.select(cells, *([F.col(date).alias("day")] if date else [F.lit(None).cast("timestamp").alias("day")]))
        counts = seen.groupBy("x.name", "x.value").agg(F.min("day").alias("first"), F.max("day").alias("last"))
        code = F.struct("value", F.upper("value").alias("label"), F.lit(None).cast("string").alias("missing_kind"))
        fields = counts.groupBy("name").agg(F.array_sort(F.collect_list(code)).cast(codes_type).alias("codes"), F.min("first").alias("first"), F.max("last").alias("last"))
        # l_linestatus was reviewed when it had other codes; the rest as they are
        reviewed = F.when(F.col("name") == "l_linestatus", F.sha2(F.lit("[]"), 256)).otherwise(canonical_sha256(F.col("codes"), codes_type, absent_nulls=True))
        claim = F.struct(F.lit("/field/codes").alias("target"), reviewed.alias("value_sha256"), F.lit("verified_in_source").alias("status"), F.array(F.struct(F.when(F.col("name") == "event_type", "blog").otherwise("manual").alias("source_id"), F.lit("p. 1").alias("locator"))).alias("evidence"))
        no = F.lit(None).cast("string")
        whole = F.struct("name", F.upper("name").alias("label"), no.alias("description"), F.lit("string").alias("type"), no.alias("unit"), no.alias("format"), "codes", F.lit(None).cast("array<struct<table:string,key:string>>").alias("references"), F.array(claim).alias("claims"))
        one = fields.agg(F.array_sort(F.collect_list(F.struct("name", whole.alias("f")))).alias("each"), F.min("first").alias("first"), F.max("last").alias("last"))  # a row for each code column
        coverage = F.when(F.col("first").isNotNull(), F.struct(at("first").alias("first"), at("last").alias("last")))
        documents.append(
            one.select(
                F.lit(f"{name}_codes").alias("name"),
                F.lit(f"Codes of {name}").alias("title"),
                F.lit("1").alias("version"),
                F.lit("latin-1").alias("encoding"),
                F.create_map(F.lit("table"), F.lit(name), F.lit("kind"), F.lit("codes")).alias("identity"),
                F.lit("national").alias("geography"),
                F.lit(cadence).alias("cadence"),
                F.lit(name[:2].upper()).alias("prefix"),
                F.lit(f"/{name}").alias("folder"),
                no.alias("preliminary_folder"),
                coverage.alias("coverage"),
                F.lit(None).alias("validated"),
                F.transform("each", lambda e: e["f"]).alias("fields"),
            ).select(*(F.col(f.name).cast(f.dataType) for f in DOCUMENT))
        )
    sources = spark.createDataFrame([("manual", "Manual", "official", None), ("blog", "Notes", "other", None)], SOURCE)
    whole = documents[0]
    for more in documents[1:]:
        whole = whole.unionByName(more)
    return Registry(whole, sources)


SEEN = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c} AS v, {d or 'NULL::TIMESTAMP'} AS day FROM {t}" for t, (columns, d, _) in CODED.items() for c in columns)


@register(f"""
WITH s AS ({SEEN}), a AS (SELECT t, min(day) AS first, max(day) AS last, count(DISTINCT c) AS n FROM s GROUP BY 1)
SELECT t || '_codes' AS name, upper(t) AS category, 'Codes of ' || t AS title, CASE WHEN t IN ('orders', 'events') THEN strftime(first, '%Y-%m') ELSE CAST(year(first) AS VARCHAR) END AS coverage_start,
  CASE WHEN t IN ('orders', 'events') THEN strftime(last, '%Y-%m') ELSE CAST(year(last) AS VARCHAR) END AS coverage_end, n AS fields, n AS labelled_fields,
  'dbf-records-1:' || sha256('{{"encoding":"latin-1","identity":{{"kind":"codes","table":"' || t || '"}}}}') AS parser_version FROM a
""")
def registry_datasets(spark, sf_dir):
    return observed_registry(spark, sf_dir).datasets().select("name", "category", "title", "coverage_start", "coverage_end", "fields", "labelled_fields", "parser_version")


@register(f"""
WITH s AS ({SEEN}) SELECT DISTINCT t || '_codes' AS dataset, c AS field, v AS value, upper(v) AS label, 'unknown' AS missing_kind FROM s
""")
def registry_codes(spark, sf_dir):
    return observed_registry(spark, sf_dir).codes().drop("place")


@register(f"""
WITH s AS ({SEEN}), d AS (SELECT DISTINCT t, c, v FROM s),
f AS (SELECT t, c, to_json(list({{'label': upper(v), 'value': v}} ORDER BY v))::VARCHAR AS codes FROM d GROUP BY ALL),
k AS (SELECT *, unnest(['name', 'label', 'description', 'type', 'unit', 'format', 'codes', 'references']) AS target FROM f)
SELECT t || '_codes' AS dataset, c AS field, '/field/' || target AS target, CASE WHEN target = 'codes' THEN 'verified_in_source' ELSE 'unreviewed' END AS status,
  sha256(CASE target WHEN 'name' THEN '"' || c || '"' WHEN 'label' THEN '"' || upper(c) || '"' WHEN 'type' THEN '"string"' WHEN 'codes' THEN codes ELSE 'null' END) AS value_sha256 FROM k
""")
def registry_claims(spark, sf_dir):
    return observed_registry(spark, sf_dir).claims().select("dataset", "field", "target", "status", "value_sha256")


@register("""
SELECT DISTINCT 'lineitem_codes' AS dataset, 'l_linestatus' AS field, 'changed since it was reviewed: /field/codes' AS problem FROM lineitem
UNION ALL SELECT DISTINCT 'events_codes', 'event_type', 'verified by a source that isn''t official: blog' FROM events
""")
def registry_problems(spark, sf_dir):
    return observed_registry(spark, sf_dir).problems()


# ---------------------------------------------------------------- publications with their sources


@register("""
SELECT o_orderkey, count(l_orderkey) AS sources, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS uris FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def publications_with_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("publication_id"), F.col("l_linenumber").alias("position"), F.concat_ws(":", "l_linenumber", "l_partkey").alias("uri"), "l_partkey", "l_suppkey")
    both = with_sources(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("publication_id")), sources.select("publication_id", "position", "l_partkey", "l_suppkey", "uri"))
    return both.select(F.col("publication_id").alias("o_orderkey"), F.size("sources").cast("long").alias("sources"), F.array_join(F.transform("sources", lambda s: s["uri"]), ",").alias("uris"))


# ---------------------------------------------------------------- population aggregates

POPULATION = aggregates.Aggregate(aggregate=6579, variable=9324, classifications={2: 0})


def aggregate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents for each region: customers of its nations; the nations of two regions aren't published well."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    places = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left").select("n_regionkey", F.col("n_nationkey").cast("string").alias("id"), F.coalesce("n", F.lit(0)).cast("string").alias("n"))
    series = F.struct(F.struct("id").alias("localidade"), F.create_map(F.lit("2024"), "n").alias("serie"))
    one = places.groupBy(F.col("n_regionkey").alias("edition")).agg(F.to_json(F.collect_list(series)).alias("series"), F.to_json(F.collect_list(F.struct("id"))).alias("universe"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    meta = '{"id": 6579, "nivelTerritorial": {"Administrativo": ["N1", "N6"]}, "variaveis": [{"id": 9324, "unidade": "Pessoas"}], "classificacoes": [{"id": 2, "categorias": [{"id": 0, "nome": "Total"}]}]}'
    periods = lambda revision: f'[{{"id": "2022", "modificacao": "01/01/2023"}}, {{"id": "2024", "modificacao": "{revision}"}}]'
    documents = {
        "metadata": F.when(F.col("edition") == 4, meta[:-1]).otherwise(meta),
        "periods": F.lit(periods("29/08/2024")),
        "periods_after": F.when(F.col("edition") == 3, periods("30/08/2024")).otherwise(periods("29/08/2024")),
        "universe": F.col("universe"),
        "population": text('[{"id": "9324", "unidade": "Pessoas", "resultados": [{"series": ', F.col("series"), "}]}]"),
    }
    each = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("body")) for r, c in documents.items()))
    return one.select(F.col("edition").cast("string").alias("edition"), F.lit(2024).alias("year"), F.explode(each).alias("d")).select("edition", "year", "d.role", "d.body")


@register("""
SELECT CAST(n_regionkey AS VARCHAR) AS edition, CAST(n_nationkey AS VARCHAR) AS code, count(c_custkey) AS population, DATE '2024-08-29' AS revision
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey NOT IN (3, 4) GROUP BY ALL
""")
def aggregate_population(spark, sf_dir):
    return aggregates.reconciled(aggregate_documents(spark, sf_dir), POPULATION, strict=False).select("edition", "code", "population", "revision")


@register("""
SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS edition, CASE n_regionkey WHEN 3 THEN 'periods: revised while it was fetched' ELSE 'metadata: not the JSON that is due' END AS problem FROM nation WHERE n_regionkey IN (3, 4)
""")
def aggregate_problems(spark, sf_dir):
    return aggregates.problems(aggregate_documents(spark, sf_dir), POPULATION).select("edition", "problem")


# ---------------------------------------------------------------- vocabularies


@register(f"""
WITH v(code, state, label, region) AS (VALUES {", ".join(f"({c}, '{s}', '{n}', {c // 10})" for c, s, n in vocabularies.STATES)}),
r(code, region_label) AS (VALUES {", ".join(f"({c}, '{n}')" for c, n in vocabularies.REGIONS)})
SELECT c_nationkey + 10 AS code, state, label, region_label, count(*) AS n FROM customer LEFT JOIN v ON v.code = c_nationkey + 10 LEFT JOIN r ON r.code = v.region GROUP BY ALL
""")
def vocabulary_join(spark, sf_dir):
    folder = scratch(spark, "vocabularies")
    vocabularies.load(spark, folder)
    states, regions = (vocabularies.read(spark, folder, n) for n in ("voc_state", "voc_region"))
    counts = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 10).alias("code")).agg(F.count("*").alias("n"))
    named = rel.reference_join(rel.reference_join(counts, states, {"code": "code"}, prefix="s_"), regions, {"s_region": "code"}, prefix="r_")
    return named.select("code", F.col("s_state").alias("state"), F.col("s_label").alias("label"), F.col("r_label").alias("region_label"), "n")


# ---------------------------------------------------------------- relations


@register("SELECT o_custkey, max(year(o_orderdate) * 100 + month(o_orderdate)) AS yyyymm FROM orders GROUP BY 1")
def guarded_latest(spark, sf_dir):
    day = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year(day).alias("ano"), F.month(day).alias("mes"))
    found = rel.latest_guarded(orders.withColumn("yyyymm", F.col("ano") * 100 + F.col("mes")), ["o_custkey"], ["ano", "mes"], ["yyyymm"])
    return found.select("o_custkey", F.col("yyyymm").cast("long").alias("yyyymm"))


@register("""
WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(c_acctbal AS DECIMAL(14, 2))::DOUBLE AS amount, CAST(c_custkey AS VARCHAR) AS who, CAST(c_custkey AS DECIMAL(25, 4)) AS number FROM customer
UNION ALL SELECT s_name, s_acctbal, CAST(s_suppkey % 2 = 0 AS VARCHAR), CAST(s_nationkey AS DECIMAL(25, 4)) FROM supplier
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(o_totalprice AS DECIMAL(18, 4)) FROM orders)
SELECT * FROM a
""")
def concat_relaxed(spark, sf_dir):
    day = F.to_date("o_orderdate")
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_acctbal").cast("decimal(14,2)").alias("amount"), F.col("c_custkey").alias("who"), F.col("c_custkey").alias("number"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("code"), F.col("s_acctbal").alias("amount"), (F.col("s_suppkey") % 2 == 0).alias("who"), F.col("s_nationkey").cast("decimal(10,2)").alias("number"))
    orders = table(spark, sf_dir, "orders").select(day.alias("code"), F.col("o_orderkey").alias("amount"), day.alias("who"), F.col("o_totalprice").cast("decimal(18,4)").alias("number"))
    found = rel.concat_relaxed([customers, suppliers, orders])
    assert found.schema["number"].dataType == T.DecimalType(23, 4)
    return found.withColumn("number", F.col("number").cast("decimal(25,4)"))


@register("""
WITH a AS (SELECT c_custkey, c_nationkey AS nation, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS hundreds FROM customer),
b AS (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 100) AS BIGINT) AS hundreds FROM supplier WHERE s_acctbal >= 0),
x AS (SELECT nation, hundreds, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT nation, hundreds, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT CASE WHEN a.nation IS NULL THEN 'no nation' WHEN a.hundreds IS NULL THEN 'no hundreds' WHEN x.n > 1 THEN 'several with these keys' WHEN y.n IS NULL THEN 'not on the other side' WHEN y.n > 1 THEN 'several on the other side' END AS reason
  FROM a LEFT JOIN x USING (nation, hundreds) LEFT JOIN y USING (nation, hundreds))
SELECT reason, count(*) AS records, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM r WHERE reason IS NOT NULL GROUP BY 1
""")
def unlinked_reasons(spark, sf_dir):
    hundreds = lambda c: F.when(F.col(c) >= 0, F.floor(F.col(c) / 100)).alias("hundreds")
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), hundreds("c_acctbal"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), hundreds("s_acctbal"))
    keys = ["nation", "hundreds"]
    return linkage.reason_report(linkage.unlinked_reasons(a, b, linkage.link(a, b, keys), keys))


@register("""
SELECT p_partkey, label FROM part LEFT JOIN (VALUES ('STA', 'standard'), ('ECO', 'economy'), ('PRO', 'promo')) r(p, label) ON upper(left(trim(p_type), 3)) = p
""")
def prefix_join(spark, sf_dir):
    chapters = spark.createDataFrame([("sta", "standard"), ("ECO", "economy"), ("PRO ", "promo")], "prefix string, label string")
    return rel.prefix_join(table(spark, sf_dir, "part"), "p_type", chapters, "prefix", 3).select("p_partkey", "label")


@register("""
SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_acctbal BETWEEN s_acctbal AND s_acctbal + 40
""")
def range_join_dealt(spark, sf_dir):
    """Ranges that are too many to be sent to all tasks, and that overlap."""
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("first"), (F.col("s_acctbal") + 40).alias("last"))
    return rel.range_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ranges, most=0).select("c_custkey", "s_suppkey")


@register("""
SELECT o_orderkey, r.chapter FROM orders JOIN (VALUES ('low', 0.0, 50000.0), ('mid', 50000.0000001, 200000.0), ('high', 200000.0000001, 1e12)) r(chapter, lo, hi) ON o_totalprice BETWEEN lo AND hi
""")
def one_chapter_each(spark, sf_dir):
    """Each order is in exactly one chapter; two would stop the query."""
    ranges = spark.createDataFrame([("low", 0.0, 50000.0), ("mid", 50000.0000001, 200000.0), ("high", 200000.0000001, 1e12)], "chapter string, first double, last double")
    return rel.exactly_one(rel.range_join(table(spark, sf_dir, "orders"), "o_totalprice", ranges), ["o_orderkey"], "chapter").select("o_orderkey", "chapter")


@register("SELECT c_custkey AS code FROM customer EXCEPT SELECT o_custkey FROM orders")
def code_difference(spark, sf_dir):
    return rel.difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")), table(spark, sf_dir, "orders"), ["code"], ["o_custkey"])


@register(r"""
WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '', 's') AS u FROM pages)
SELECT page_id, regexp_extract(u, '^([a-z]+):', 1) AS scheme, lower(regexp_extract(u, '^[a-z]+://([^/:]*)', 1)) AS host, nullif(regexp_extract(u, '^[a-z]+://[^/]*/(?:.*/)?([^/]*)$', 1), '') AS name,
  CASE WHEN regexp_matches(u, '^[a-z]+://[^/]*/') THEN regexp_extract(u, '^[a-z]+://[^/]*(/.*)?/[^/]*$', 1) END AS folder FROM u
""")
def address_parts(spark, sf_dir):
    parts = text.uri_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", parts["scheme"].alias("scheme"), parts["host"].alias("host"), parts["name"].alias("name"), parts["folder"].alias("folder"))


@register("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '  ' || p_size || ' ' WHEN 1 THEN p_size || ',0' WHEN 2 THEN p_size || '.5' WHEN 3 THEN '' ELSE p_size || 'x' END AS said FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN TRY_CAST(trim(said) AS BIGINT) WHEN 1 THEN TRY_CAST(replace(said, ',0', '') AS BIGINT) END AS whole, CASE WHEN p_partkey % 5 < 3 THEN TRY_CAST(replace(trim(said), ',', '.') AS DOUBLE) END AS number FROM t
""")
def loose_numbers(spark, sf_dir):
    size, way = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    said = F.when(way == 0, F.concat(F.lit("  "), size, F.lit(" "))).when(way == 1, F.concat(size, F.lit(",0"))).when(way == 2, F.concat(size, F.lit(".5"))).when(way == 3, "").otherwise(F.concat(size, F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", text.loose_number(said).alias("whole"), text.loose_number(said, "double").alias("number"))


# ---------------------------------------------------------------- DBC files


def months_as_parts(spark: SparkSession, sf_dir: str) -> str:
    """Orders as DBC files of three layouts: keys as numbers, as text, and with a price beside them."""
    spark.dataSource.register(dbc.DbcDataSource)
    folder, orders = scratch(spark, "dbc"), table(spark, sf_dir, "orders")
    day, key = F.to_date("o_orderdate").alias("DT"), F.col("o_orderkey")
    layouts = [
        orders.where("o_orderstatus = 'F'").select(key.alias("CHAVE"), day, (F.col("o_custkey") > 700).alias("ALTO")),
        orders.where("o_orderstatus = 'O'").select(F.lpad(key.cast("string"), 12, "0").alias("CHAVE"), day, (F.col("o_custkey") > 700).alias("ALTO")),
        orders.where("o_orderstatus not in ('F', 'O') or o_orderstatus is null").select(key.alias("chave"), day, (F.col("o_custkey") > 700).alias("alto"), F.col("o_totalprice").cast("decimal(14,2)").alias("PRECO")),
    ]
    for k, rows in enumerate(layouts):
        rows.write.format("dbc").mode("append").option("width", 14).option("packed", str(k < 2).lower()).save(folder)
    return folder


@register("""
SELECT CASE WHEN o_orderstatus = 'O' THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS chave, CAST(o_orderdate AS DATE) AS dt, o_custkey > 700 AS alto,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) END AS preco FROM orders
""")
def dbc_parts(spark, sf_dir):
    """Files that drifted, read as one table: numbers meet text, and a column comes late."""
    return dbc.read_parts(spark, months_as_parts(spark, sf_dir), drift="widen").select("chave", "dt", "alto", "preco")


@register("""
WITH o AS (SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE '-' END AS s, count(*) AS n FROM orders GROUP BY 1),
f(s, name, kind, size, decimals) AS (VALUES ('F', 'chave', 'N', 18, 0), ('F', 'dt', 'D', 8, 0), ('F', 'alto', 'L', 1, 0), ('O', 'chave', 'C', 14, 0), ('O', 'dt', 'D', 8, 0), ('O', 'alto', 'L', 1, 0),
  ('-', 'chave', 'N', 18, 0), ('-', 'dt', 'D', 8, 0), ('-', 'alto', 'L', 1, 0), ('-', 'preco', 'N', 16, 2))
SELECT name, kind, CAST(size AS INTEGER) AS size, CAST(decimals AS INTEGER) AS decimals, CAST(sum(n) AS BIGINT) AS records FROM f JOIN o USING (s) GROUP BY ALL
""")
def dbc_headers(spark, sf_dir):
    """Every field of every header, with the records that have it."""
    return dbc.survey(spark, months_as_parts(spark, sf_dir)).groupBy("name", "kind", "size", "decimals").agg(F.sum("records").alias("records"))


@register("""
SELECT c_custkey AS codigo, c_name AS nome, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS saldo, 'RR' AS uf, CAST(2024 AS INTEGER) AS ano, 'final' AS release FROM customer
""")
def dbc_staged(spark, sf_dir):
    """A scope's parts staged as one Parquet folder: a whole number declared text becomes text, and the library's columns are added."""
    spark.dataSource.register(dbc.DbcDataSource)
    folder, target = scratch(spark, "dbc"), scratch(spark, "staged")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CODIGO"), F.col("c_name").alias("NOME"), F.col("c_acctbal").cast("decimal(12,2)").alias("SALDO"))
    rows.write.format("dbc").mode("append").option("width", 30).save(folder)
    done = dbc.stage(spark, folder, target, {"uf": "RR", "ano": 2024}, "final", declared={"codigo": "string"})
    found = spark.read.parquet(target)
    if done.rows != found.count() or found.schema["codigo"].dataType != T.StringType():
        raise AssertionError("staging lost rows or types")
    return found.select(F.col("codigo").cast("long").alias("codigo"), "nome", "saldo", "uf", "ano", F.col("_source_release").alias("release"))
