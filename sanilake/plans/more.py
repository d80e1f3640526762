"""Queries over person, stay and birth tables, registers, harmonised reading and the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanilake.functions import harmonised, rules
from sanilake.operators import records
from sanilake.operators import relational as rel
from sanilake.plans.catalog import age_columns, register, table
from sanilake.plans.lake import Lake, SourceFile, read_harmonised
from sanilake.plans.scratch import scratch
from sanilake.sources.files import file_scope


# ---------------------------------------------------------------- persons, stays, births


@register("""
SELECT o_custkey, o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS rows
FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1, 2
""")
def person_spells(spark, sf_dir):
    return records.spells(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"], "o_orderdate")


@register("""
WITH p AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) = 1),
s AS (SELECT o_custkey, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) = 1)
SELECT o.o_custkey, p.v AS o_orderpriority, s.v AS o_orderstatus, min(o_totalprice) AS o_totalprice, min(o_orderdate) AS o_orderdate
FROM orders o JOIN p USING (o_custkey) JOIN s USING (o_custkey) GROUP BY 1, 2, 3
""")
def person_profiles(spark, sf_dir):
    return records.profiles(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_orderdate"])


@register("""
SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS died FROM orders JOIN customer ON o_custkey = c_custkey WHERE starts_with(CAST(c_nationkey AS VARCHAR), '1')
""")
def resident_deaths(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    outcome = F.when(F.col("o_orderstatus") == "F", "Óbito por outra causa").when(F.col("o_orderstatus") == "O", "Cura")
    return records.resident_cases(cases, "c_nationkey", "1", outcome).select("o_orderkey", "died")


@register("""
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS newborns, bool_and(coalesce(l_quantity > 10, false)) AS all_twins, min(l_orderkey) AS l_orderkey, min(l_partkey) AS l_partkey
FROM lineitem GROUP BY 1, 2
""")
def births(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return records.births(lines, ["l_suppkey", "day"], F.col("l_quantity") > 10, ["l_orderkey", "l_partkey"])


@register("""
WITH r AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_nationkey < 20), l AS (SELECT l.l_suppkey, r.s_suppkey IS NULL AS lost, l_returnflag = 'R' AS away FROM lineitem l LEFT JOIN r ON l.l_suppkey = r.s_suppkey WHERE l.l_suppkey IS NOT NULL)
SELECT round(100.0 * count(CASE WHEN NOT lost THEN 1 END) / greatest(count(*), 1), 1) AS pct_known, count(DISTINCT CASE WHEN lost THEN l_suppkey END) AS codes_outside,
  round(100.0 * count(CASE WHEN lost AND away THEN 1 END) / greatest(count(CASE WHEN lost THEN 1 END), 1), 1) AS pct_elsewhere FROM l
""")
def register_check(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"))
    return records.register_check(table(spark, sf_dir, "lineitem"), "l_suppkey", known, F.col("l_returnflag") == "R")


@register("""
SELECT year(l_shipdate) AS year, (year(l_shipdate) * 12 + month(l_shipdate)) - (year(o_orderdate) * 12 + month(o_orderdate)) AS months, count(*) AS pairs
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")
def approval_lag(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = records.month_lag(table(spark, sf_dir, "orders"), lines, "o_orderkey", "o_orderdate", "l_shipdate")
    return found.select(F.col("year").cast("long").alias("year"), F.col("months").cast("long").alias("months"), "pairs")


@register("""
WITH a AS (SELECT l_orderkey AS o_orderkey, count(*) AS acts, count(DISTINCT l_suppkey) AS kinds, min(l_quantity) AS least, sum(l_quantity) AS total FROM lineitem GROUP BY 1)
SELECT count(*) AS stays, round(100.0 * count(acts) / greatest(count(*), 1), 1) AS pct_with_acts, CAST(sum(acts) AS BIGINT) AS acts, round(100.0 * count(CASE WHEN kinds = acts THEN 1 END) / greatest(count(acts), 1), 1) AS pct_all_kinds,
  count(CASE WHEN total > 10 * least THEN 1 END) AS uneven FROM orders LEFT JOIN a USING (o_orderkey)
""")
def acts_of_stays(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    both = records.acts_of_stays(table(spark, sf_dir, "orders"), lines, "o_orderkey", "l_suppkey", "l_quantity")
    pct = lambda part, whole: F.round(100.0 * part / F.greatest(whole, F.lit(1)), 1)
    return both.agg(F.count("*").alias("stays"), pct(F.count("acts"), F.count("*")).alias("pct_with_acts"), F.sum("acts").alias("acts"), pct(F.count_if(F.col("kinds") == F.col("acts")), F.count("acts")).alias("pct_all_kinds"), F.count_if(F.col("total") > 10 * F.col("least")).alias("uneven"))


@register("""
WITH a AS (SELECT coalesce(c_mktsegment, '') AS s, coalesce(CAST(c_nationkey AS VARCHAR), '') AS n FROM customer),
b AS (SELECT coalesce(c_mktsegment, '') AS s, coalesce(CAST(s_nationkey AS VARCHAR), '') AS n, count(*) AS k FROM supplier JOIN customer ON c_custkey = s_suppkey GROUP BY 1, 2)
SELECT count(CASE WHEN k = 1 THEN 1 END) AS one, count(CASE WHEN k IS NULL THEN 1 END) AS "none", count(CASE WHEN k > 1 THEN 1 END) AS several FROM a LEFT JOIN b USING (s, n)
""")
def subset_matches(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    part = table(spark, sf_dir, "supplier").join(customers, F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "c_mktsegment", F.col("s_nationkey").alias("c_nationkey"))
    return records.subset_matches(customers, part, ["c_custkey"])


@register("""
WITH p AS (SELECT length(CAST(o_orderkey AS VARCHAR)) AS length, o_custkey, count(*) AS n, count(DISTINCT o_orderkey) AS codes FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1, 2)
SELECT length, CAST(sum(n) AS BIGINT) AS rows, count(o_custkey) AS persons, count(CASE WHEN codes > 1 THEN 1 END) AS with_several FROM p GROUP BY 1
""")
def shape_report(spark, sf_dir):
    return records.shape_report(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@register("""
WITH t AS (SELECT event_type, user_id, sha256(concat_ws(',', coalesce(length(event_type) || ':' || event_type, '-'), coalesce(length(CAST(user_id AS VARCHAR)) || ':' || user_id, '-'))) AS d FROM events)
SELECT event_type, user_id, d || '-' || row_number() OVER (PARTITION BY d ORDER BY d) AS record_id FROM t
""")
def record_ids(spark, sf_dir):
    return records.with_record_id(table(spark, sf_dir, "events").select("event_type", "user_id"))


@register("SELECT o_orderstatus, year(o_orderdate) AS ano, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY ALL ORDER BY ALL")
def group_by_all(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS ano, count(*) AS n, min(o_totalprice) AS least FROM {orders} GROUP BY ALL ORDER BY ALL", orders=table(spark, sf_dir, "orders"))


# ---------------------------------------------------------------- rules

SINAN = {"kind": "sinan", "units": {"1": {"unit": "hour"}, "2": {"unit": "day"}, "3": {"unit": "month"}, "4": {"unit": "year"}}}


@register("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '40x0' ELSE CAST(o_orderkey % 6000 AS VARCHAR) END AS v FROM orders),
s AS (SELECT *, left(v, 1) AS u, TRY_CAST(substr(v, 2, 3) AS INTEGER) AS q FROM r),
t AS (SELECT *, CASE WHEN NOT regexp_full_match(v, '[0-9]{4}') THEN 'invalid' WHEN (u IN ('1', '2') AND q <= 99) OR u IN ('3', '4') THEN 'valid' ELSE 'unsupported' END AS status FROM s)
SELECT o_orderkey, status, CASE WHEN status = 'valid' THEN CASE u WHEN '3' THEN q // 12 WHEN '4' THEN q ELSE 0 END END AS years, CASE WHEN status = 'valid' THEN q END AS quantity,
  CASE WHEN status = 'valid' THEN CASE u WHEN '1' THEN 'hour' WHEN '2' THEN 'day' WHEN '3' THEN 'month' ELSE 'year' END END AS unit FROM t
""")
def age_rule_sinan(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 13 == 0, "40x0").otherwise((key % 6000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *age_columns(rules.age(SINAN, value)))


@register("""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '00000229' WHEN o_orderkey % 3 = 1 THEN '00010101' ELSE strftime(o_orderdate, '%Y%m%d') END AS v FROM orders)
SELECT o_orderkey, CAST(CAST(try_strptime(v, '%Y%m%d') AS DATE) AS VARCHAR) AS day, 'valid' AS status FROM v
""")
def year_zero(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 3 == 0, "00000229").when(key % 3 == 1, "00010101").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    day, status = rules.date(value, "yyyyMMdd")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.date_text(day).alias("day"), status.alias("status"))


@register("""
WITH r AS (SELECT CASE c_custkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '9' WHEN 3 THEN '' WHEN 4 THEN '1' ELSE 'Z' END AS sex, CAST(c_custkey % 70 AS INTEGER) AS years,
  DATE '1950-03-01' + CAST(c_custkey AS INTEGER) AS born, DATE '2020-03-01' AS event FROM customer),
e AS (SELECT *, year(event) - year(born) - CASE WHEN strftime(event, '%m%d') < strftime(born, '%m%d') THEN 1 ELSE 0 END AS exact FROM r)
SELECT count(*) AS rows, count(CASE WHEN sex IN ('1', '2') THEN 1 END) AS sex_valid, count(CASE WHEN sex = '' THEN 1 END) AS sex_missing, count(CASE WHEN sex = '9' THEN 1 END) AS sex_ignored, CAST(0 AS BIGINT) AS sex_invalid,
  count(CASE WHEN sex = 'Z' THEN 1 END) AS sex_unsupported, count(*) AS ages_compared, count(CASE WHEN years <> exact THEN 1 END) AS ages_differ, 'extra,sexo' AS columns_that_differ, true AS blocked FROM e
""")
def acceptance_audit(spark, sf_dir):
    key = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, ("1", "2", "9", "", "1", "Z"))), (key % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(code.alias("sex"), (key % 70).cast("int").alias("years"), F.date_add(F.lit("1950-03-01").cast("date"), key.cast("int")).alias("born"), F.lit("2020-03-01").cast("date").alias("event"), F.lit(1).alias("extra"))
    status = rules.sex({"categories": {"1": "male", "2": "female", "9": None}}, "sex")[1]
    return records.acceptance_audit(rows, ["sex", "years", "born", "event", "sexo"], {"sex": status}, (F.col("years"), F.col("born"), F.col("event")))


# ---------------------------------------------------------------- files and the lake


@register("""
WITH f AS (SELECT s_suppkey, (['AC', 'SP', 'RR', 'XX'])[s_suppkey % 4 + 1] AS uf, CAST(1979 + s_suppkey % 45 AS VARCHAR) AS y, CAST(s_suppkey % 14 AS INTEGER) AS m FROM supplier)
SELECT s_suppkey, CASE WHEN uf <> 'XX' AND m BETWEEN 1 AND 12 THEN uf END AS uf, CASE WHEN uf <> 'XX' AND m BETWEEN 1 AND 12 THEN CAST(y AS INTEGER) END AS ano, CASE WHEN uf <> 'XX' AND m BETWEEN 1 AND 12 THEN m END AS mes FROM f
""")
def filename_decode(spark, sf_dir):
    key = F.col("s_suppkey")
    uf = F.element_at(F.array(*map(F.lit, ("AC", "SP", "RR", "XX"))), (key % 4 + 1).cast("int"))
    name = F.concat(F.lit("RD"), uf, F.lpad(((1979 + key % 45) % 100).cast("string"), 2, "0"), F.lpad((key % 14).cast("string"), 2, "0"), F.lit(".dbc"))
    found = table(spark, sf_dir, "supplier").select("s_suppkey", file_scope(name, "RD", monthly=True).alias("f"))
    return found.select("s_suppkey", "f.uf", "f.ano", "f.mes")


def published_orders(spark: SparkSession, sf_dir: str) -> Lake:
    """Orders, every month a publication; a month of them replaced by part of its rows, and another deleted again."""
    lake = Lake(spark, scratch(spark, "lake"))
    day = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(F.year(day).alias("ano"), F.month(day).alias("mes"), "o_orderkey", F.date_format(day, "ddMMyyyy").alias("dtobito"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("9").alias("sexo"))
    lake.publish_scopes("sim", orders, ["ano", "mes"], "mem:orders", "v1", "run-1")
    again = {"ano": 1996, "mes": 2}
    lake.publish("sim", orders.where("ano = 1996 and mes = 2 and sexo = '1'"), again, [SourceFile("mem:2", f"{2:064x}", 1)], "v1", "replace", release="final")
    lake.delete_scope("sim", {"ano": 1996, "mes": 3})
    return lake


@register("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes, o_orderkey FROM orders
WHERE NOT (year(o_orderdate) = 1996 AND (month(o_orderdate) = 3 OR month(o_orderdate) = 2 AND o_orderkey % 2 = 1))
""")
def publication_roundtrip(spark, sf_dir):
    return published_orders(spark, sf_dir).table("sim").select("ano", "mes", "o_orderkey")


ANALYTICS = {"sex": {"field": "sexo", "categories": {"1": "masculino", "2": "feminino", "9": None}}, "dates": ["dtobito"]}


@register("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'masculino' END AS sexo_categoria, CASE WHEN o_orderkey % 2 = 0 THEN 'valid' ELSE 'ignored' END AS sexo_status,
  CAST(o_orderdate AS DATE) AS dtobito_data, 'valid' AS dtobito_data_status FROM orders
WHERE NOT (year(o_orderdate) = 1996 AND (month(o_orderdate) = 3 OR month(o_orderdate) = 2 AND o_orderkey % 2 = 1))
""")
def harmonised_read(spark, sf_dir):
    """Every month that is published, each a validated source."""
    lake = published_orders(spark, sf_dir)
    there = [p for p in lake.publications("sim") if p.active]
    validated = [{"uf": None, **p.scope, "release": p.release, "source_sha256": p.sha256} for p in there]
    rows, _ = read_harmonised(lake, "sim", [p.scope for p in there], ANALYTICS | {"validated_sources": validated}, {"dtobito": "ddMMyyyy"})
    return rows.select("o_orderkey", "sexo_categoria", "sexo_status", "dtobito_data", "dtobito_data_status")


@register("""
WITH m AS (SELECT DISTINCT year(o_orderdate) AS ano, month(o_orderdate) AS mes FROM orders WHERE NOT (year(o_orderdate) = 1996 AND month(o_orderdate) = 3))
SELECT CAST(ano AS INTEGER) AS ano, CAST(mes AS INTEGER) AS mes, "column", why FROM m, (VALUES ('dtobito_data', 'dtobito'), ('sexo_categoria', 'sexo')) t("column", source), (SELECT 'unconfirmed_source_scope' AS why) WHERE NOT (ano = 1996 AND mes = 2)
""")
def harmonised_unavailable(spark, sf_dir):
    """The months of which no source was validated (all but the one published again): each column that is not there, and why."""
    lake = published_orders(spark, sf_dir)
    known = [{"uf": None, "ano": 1996, "mes": 2, "release": "final", "source_sha256": f"{2:064x}"}]
    schema, found = lake.table("sim").schema, []
    for p in lake.publications("sim"):
        if p.active:
            told = harmonised.projection(ANALYTICS | {"validated_sources": known}, schema, [harmonised.Context(p.scope, p.release, p.sha256)], {"dtobito": "ddMMyyyy"}).unavailable
            found += [(p.scope["ano"], p.scope["mes"], c, why) for c, why in told.items() if why == "unconfirmed_source_scope"]
    return spark.createDataFrame(found, "ano int, mes int, column string, why string")
