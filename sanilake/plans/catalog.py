"""Every query of the library over the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sanilake.functions import labels, rules, text
from sanilake.operators import linkage, quality
from sanilake.operators import relational as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer nation."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey, "left")
    return named.groupBy("n_name").agg(F.count("*").alias("orders"))


def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.withColumns({"ano": F.year("o_orderdate"), "mes": F.month("o_orderdate")})


# ---------------------------------------------------------------- filters


@register("""
SELECT o_orderkey, year(o_orderdate) AS ano, month(o_orderdate) AS mes FROM orders
WHERE (year(o_orderdate) = 1995 AND month(o_orderdate) = 3) OR (year(o_orderdate) = 1996 AND month(o_orderdate) = 7)
""")
def scope_filter(spark, sf_dir):
    scopes = [{"ano": 1995, "mes": 3}, {"ano": 1996, "mes": 7}]
    months = reduce(Column.__or__, (rel.in_months("o_orderdate", (s["ano"], s["mes"]), (s["ano"], s["mes"])) for s in scopes))
    return orders_by_month(spark, sf_dir).where(months & rel.in_scopes(scopes)).select("o_orderkey", F.col("ano").cast("long").alias("ano"), F.col("mes").cast("long").alias("mes"))


@register("""
SELECT o_orderkey, o_orderstatus FROM orders
WHERE (o_orderstatus, year(o_orderdate)) IN (('F', 1994), ('O', 1996))
""")
def tuple_in_semi(spark, sf_dir):
    orders = orders_by_month(spark, sf_dir)
    return rel.with_tuples(orders, ["o_orderstatus", "ano"], [("F", 1994), ("O", 1996)]).select("o_orderkey", "o_orderstatus")


@register("""
SELECT o_orderkey FROM orders WHERE year(o_orderdate) * 12 + month(o_orderdate) BETWEEN 1995 * 12 + 11 AND 1996 * 12 + 2
""")
def coverage_window(spark, sf_dir):
    orders = orders_by_month(spark, sf_dir)
    return orders.where(rel.in_months("o_orderdate", (1995, 11), (1996, 2)) & rel.within_coverage(F.col("ano"), F.col("mes"), (1995, 11), (1996, 2))).select("o_orderkey")


@register("""
SELECT s_suppkey, s_name FROM supplier
WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey NOT IN (1, 2, 3) AND starts_with(s_name, 'Supplier') AND contains(lower(s_name), '1')
""")
def predicates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.where(F.col("s_acctbal").between(0, 5000) & ~F.col("s_nationkey").isin(1, 2, 3) & F.col("s_name").startswith("Supplier") & F.lower("s_name").contains("1")).select("s_suppkey", "s_name")


# ---------------------------------------------------------------- labels

STATUS = {"O": "open", "F": "filled"}


@register("""
SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS o_orderstatus_rotulo, count(*) AS n
FROM orders GROUP BY 1, 2
""")
def label_codes(spark, sf_dir):
    named = labels.label(table(spark, sf_dir, "orders"), {"o_orderstatus": STATUS})
    return named.groupBy("o_orderstatus", "o_orderstatus_rotulo").agg(F.count("*").alias("n"))


@register("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS label FROM nation
""")
def label_int_fallback(spark, sf_dir):
    padded = F.concat(F.lit(" 00"), (F.col("n_nationkey") % 5).cast("string"), F.lit(" "))
    return table(spark, sf_dir, "nation").select("n_nationkey", labels.lookup({0: "zero", 1: "one", 2: "two"}, padded).alias("label"))


@register("""
SELECT 'event_type' AS field, event_type AS value, count(*) AS rows FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') GROUP BY 2
""")
def decode_coverage(spark, sf_dir):
    return labels.decode_coverage(table(spark, sf_dir, "events"), {"event_type": ["click", "view", "purchase", "signup"]})


@register("""
WITH c AS (
  SELECT 'o_orderstatus' AS "column", 'code map (2 codes)' AS rule, o_orderstatus AS v, o_orderstatus NOT IN ('O', 'F') AS bad FROM orders
  UNION ALL SELECT 'o_orderpriority', 'not in dictionary', o_orderpriority, false FROM orders
  UNION ALL SELECT 'd', 'date yyyyMMdd', CASE WHEN o_orderkey % 50 = 0 THEN '19990231' WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END, false FROM orders),
n AS (SELECT "column", rule, v, bad, count(*) AS k FROM c GROUP BY ALL),
d AS (SELECT *, CASE WHEN "column" = 'd' AND v <> '' THEN CAST(try_strptime(v, '%Y%m%d') AS DATE) END AS t FROM n)
SELECT "column", CASE "column" WHEN 'd' THEN 'Date' END AS label, rule, round(100.0 * sum(CASE WHEN v IS NULL OR v = '' THEN k ELSE 0 END) / sum(k), 1) AS pct_empty,
  count(CASE WHEN v <> '' THEN 1 END) AS "distinct", min(CASE WHEN v <> '' THEN v END) AS example_code,
  CASE WHEN "column" = 'o_orderstatus' THEN CASE min(CASE WHEN v <> '' THEN v END) WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END END AS example_label,
  array_to_string(coalesce(list(v ORDER BY k DESC, v) FILTER (WHERE bad), []), ',') AS unlabelled_codes,
  CAST(sum(CASE WHEN bad THEN k ELSE 0 END) AS BIGINT) AS unlabelled_rows,
  CASE WHEN "column" = 'd' THEN round(100.0 * sum(CASE WHEN v <> '' AND t IS NULL THEN k ELSE 0 END) / sum(CASE WHEN v <> '' THEN k END), 1) END AS pct_invalid_dates,
  min(t) AS date_min, max(t) AS date_max
FROM d GROUP BY "column", rule
""")
def check_columns(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 50 == 0, "19990231").when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    data = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", day.alias("d"))
    report = quality.check_columns(data, {"o_orderstatus": {"codes": STATUS}, "d": {"label": "Date", "type": "date", "format": "yyyyMMdd"}})
    return report.withColumn("unlabelled_codes", F.array_join("unlabelled_codes", ","))


# ---------------------------------------------------------------- joins


@register("""
SELECT c_custkey, n_name AS ref_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def reference_join(spark, sf_dir):
    joined = rel.reference_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"})
    return joined.select("c_custkey", "ref_n_name")


@register("""
SELECT c_custkey, n_name AS ref_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
""")
def reference_join_rule(spark, sf_dir):
    joined = rel.reference_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}, F.col("ref_n_regionkey") < 3)
    return joined.select("c_custkey", "ref_n_name")


@register("""
WITH p AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_name, balance, coalesce(orders, 0) AS orders, round(100000.0 * coalesce(orders, 0) / balance, 2) AS rate
FROM nation JOIN p ON n_nationkey = p.k LEFT JOIN o ON n_nationkey = o.k
""")
def three_way_rate(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    balance = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders"))
    joined = table(spark, sf_dir, "nation").join(balance, "n_nationkey").join(orders, "n_nationkey", "left")
    n = F.coalesce("orders", F.lit(0))
    return joined.select("n_name", "balance", n.alias("orders"), F.round(100000.0 * n / F.col("balance"), 2).alias("rate"))


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')")
def missing_codes_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(rel.in_months("o_orderdate", (2001, 1))).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@register("""
SELECT c_mktsegment, o_custkey IS NOT NULL AS ordered, count(*) AS n
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY 1, 2
""")
def mark_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return rel.mark(table(spark, sf_dir, "customer"), orders, ["c_custkey"], "ordered").groupBy("c_mktsegment", "ordered").agg(F.count("*").alias("n"))


@register("""
WITH r(chapter, lo, hi) AS (VALUES ('A', 1, 10), ('B', 11, 20), ('C', 31, 50))
SELECT p_partkey, chapter FROM part LEFT JOIN r ON p_size BETWEEN lo AND hi
""")
def range_join_chapter(spark, sf_dir):
    ranges = spark.createDataFrame([("A", 1, 10), ("B", 11, 20), ("C", 31, 50)], "chapter string, first int, last int")
    return rel.range_join(table(spark, sf_dir, "part"), "p_size", ranges).select("p_partkey", "chapter")


STAYS = "SELECT l_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@register(f"""
SELECT a AS day, count(*) AS n FROM (
  SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS a FROM ({STAYS}) WHERE a <= b) GROUP BY 1
""")
def interval_explode(spark, sf_dir):
    stays = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stays = stays.select(F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("b"))
    return rel.days_held(stays, "a", "b")


@register("""
SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON left(CAST(c.c_custkey AS VARCHAR), 6) = left(CAST(o.o_custkey AS VARCHAR), 6)
""")
def derived_key_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", text.municipality_join_key("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.municipality_join_key("o_custkey").alias("k"))
    return c.join(o, "k").select("c_custkey", "o_orderkey")


@register("""
WITH a AS (SELECT coalesce(CAST(o_orderstatus AS VARCHAR), '') AS s, coalesce(o_orderpriority, '') AS p, o_orderkey AS id FROM orders),
b AS (SELECT coalesce(CAST(o_orderstatus AS VARCHAR), '') AS s, coalesce(o_orderpriority, '') AS p, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
SELECT id, first FROM a LEFT JOIN b USING (s, p)
""")
def wide_text_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    plain = lambda df: df.select("o_orderkey", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("o_orderstatus", "o_orderpriority")))
    first = plain(orders).groupBy("o_orderstatus", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    return plain(orders).join(first, ["o_orderstatus", "o_orderpriority"], "left").select(F.col("o_orderkey").alias("id"), "first")


# ---------------------------------------------------------------- linkage

SIDES = """
a AS (SELECT c_custkey AS id, c_nationkey AS nation, CAST(round(c_acctbal / 100) AS BIGINT) AS balance FROM customer),
b AS (SELECT s_suppkey AS id, s_nationkey AS nation, CAST(round(s_acctbal / 100) AS BIGINT) AS balance FROM supplier)"""
LINK = """SELECT x.id, y.id AS id_b FROM (SELECT nation, balance, min(id) AS id FROM {a} WHERE nation IS NOT NULL AND balance IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) x
JOIN (SELECT nation, balance, min(id) AS id FROM {b} GROUP BY 1, 2 HAVING count(*) = 1) y USING (nation, balance)"""


def sides(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal") / 100).cast("long").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.round(F.col("s_acctbal") / 100).cast("long").alias("balance"))
    return a, b


@register(f"WITH {SIDES} {LINK.format(a='a', b='b')}")
def one_to_one_link(spark, sf_dir):
    return linkage.link(*sides(spark, sf_dir), ["nation", "balance"]).select("id", "id_b")


CASCADE = f"""{SIDES},
s1 AS ({LINK.format(a='a', b='b')}),
ra AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM s1)), rb AS (SELECT * FROM b WHERE id NOT IN (SELECT id_b FROM s1)),
s2 AS (SELECT x.id, y.id AS id_b FROM (SELECT balance, min(id) AS id FROM ra GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT balance, min(id) AS id FROM rb GROUP BY 1 HAVING count(*) = 1) y USING (balance))"""


@register(f"WITH {CASCADE} SELECT id, id_b, 1 AS step FROM s1 UNION ALL SELECT id, id_b, 2 FROM s2")
def cascade_link(spark, sf_dir):
    return linkage.link_in_steps(*sides(spark, sf_dir), [["nation", "balance"], ["balance"]], "balance", F.col("balance") + 7).pairs


@register(f"""
WITH {CASCADE},
ca AS (SELECT id, nation, balance + 7 AS balance FROM a), c1 AS ({LINK.format(a='ca', b='b')}),
cra AS (SELECT id, nation, balance + 7 AS balance FROM ra),
c2 AS (SELECT x.id FROM (SELECT balance, min(id) AS id FROM cra GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT balance, min(id) AS id FROM rb GROUP BY 1 HAVING count(*) = 1) y USING (balance)),
r AS (SELECT 1 AS step, 'nation + balance' AS keys, (SELECT count(*) FROM s1) AS pairs, (SELECT count(*) FROM c1) AS control_pairs
  UNION ALL SELECT 2, 'balance', (SELECT count(*) FROM s2), (SELECT count(*) FROM c2))
SELECT *, CASE WHEN pairs > 0 THEN round(100.0 * control_pairs / pairs, 1) END AS pct_by_chance FROM r
""")
def negative_control(spark, sf_dir):
    return linkage.link_in_steps(*sides(spark, sf_dir), [["nation", "balance"], ["balance"]], "balance", F.col("balance") + 7).report


@register("""
WITH k AS (SELECT DISTINCT o_orderkey AS k FROM orders), n AS (SELECT k, lead(k) OVER (ORDER BY k) AS nx FROM k),
l AS (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT 'real' AS kind, count(*) AS pairs, CAST(sum(lines) AS BIGINT) AS lines FROM orders JOIN l ON o_orderkey = l.k
UNION ALL SELECT 'control', count(*), CAST(sum(lines) AS BIGINT) FROM orders JOIN n ON o_orderkey = n.k JOIN l ON n.nx = l.k
""")
def exact_key_neighbour(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    real, control = linkage.pairs_by_key(a, b, "k")
    count = lambda df, kind: df.agg(F.count("*").alias("pairs"), F.sum("lines_b").alias("lines")).select(F.lit(kind).alias("kind"), "pairs", "lines")
    return count(real, "real").unionByName(count(control, "control"))


@register("""
WITH l AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice)) AS total FROM lineitem GROUP BY 1),
p AS (SELECT round(o_totalprice) AS total, o_orderkey % 4 + 1 AS lines, l.total AS total_b, l.lines AS lines_b FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT 'lines' AS variable, count(*) AS comparable, round(100.0 * count(CASE WHEN lines = lines_b THEN 1 END) / greatest(count(*), 1), 1) AS pct_equal FROM p
UNION ALL SELECT 'total (±50000)', count(*), round(100.0 * count(CASE WHEN abs(total - total_b) <= 50000 THEN 1 END) / greatest(count(*), 1), 1) FROM p
""")
def concordance(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines_b"), F.round(F.sum("l_extendedprice")).alias("total_b"))
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").alias("total"), (F.col("o_orderkey") % 4 + 1).alias("lines")).join(lines, "o_orderkey")
    return linkage.concordance(pairs, [("lines", None), ("total", 50000)]).withColumn("variable", F.regexp_replace("variable", "5e\\+04", "50000"))


@register("""
WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT round(100.0 * count(CASE WHEN n = 1 THEN 1 END) / greatest(sum(n), 1), 1) AS pct_unique FROM n
""")
def unique_key_share(spark, sf_dir):
    return linkage.unique_share(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@register("""
WITH k(shift) AS (VALUES (0), (1), (2), (3)),
a AS (SELECT shift, nation, balance + shift AS balance, id FROM (SELECT c_custkey AS id, c_nationkey AS nation, CAST(round(c_acctbal / 100) AS BIGINT) AS balance FROM customer), k),
b AS (SELECT s_nationkey AS nation, CAST(round(s_acctbal / 100) AS BIGINT) AS balance FROM supplier GROUP BY 1, 2 HAVING count(*) = 1),
u AS (SELECT shift, nation, balance FROM a GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT k.shift, count(b.nation) AS pairs FROM k LEFT JOIN u ON u.shift = k.shift LEFT JOIN b ON u.nation = b.nation AND u.balance = b.balance GROUP BY 1
""")
def shift_sensitivity(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    counts = [linkage.link(a.withColumn("balance", F.col("balance") + k), b, ["nation", "balance"]).agg(F.count("*").alias("pairs")).select(F.lit(k).alias("shift"), "pairs") for k in range(4)]
    return rel.union_by_name(counts)


# ---------------------------------------------------------------- windows and aggregates


@register("""
WITH e AS (SELECT user_id, year(ts) AS y, month(ts) AS m, event_type FROM events),
r AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY y DESC NULLS LAST, m DESC NULLS LAST) AS k FROM e),
d AS (SELECT DISTINCT user_id, y, m, event_type FROM r WHERE k = 1)
SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS variants FROM d
""")
def latest_row_guard(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.year("ts").alias("y"), F.month("ts").alias("m"), "event_type")
    return rel.latest_rows(events, ["user_id"], ["y", "m"]).select("user_id", "event_type", "variants")


@register("""
WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority AS priority FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1
""")
def mode_tiebreak(spark, sf_dir):
    return rel.mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "priority")


@register("SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY 1 ORDER BY rows DESC, o_orderpriority LIMIT 1")
def file_mode(spark, sf_dir):
    return rel.whole_mode(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("""
WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS total, count(c_mktsegment) AS n_distinct, round(100.0 * max(n) / sum(n), 2) AS top_pct FROM n GROUP BY 1
""")
def two_level_agg(spark, sf_dir):
    return rel.top_share(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@register("SELECT event_type, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1")
def share_of_total(spark, sf_dir):
    return rel.share_of_total(table(spark, sf_dir, "events"), ["event_type"])


@register("""
SELECT year(o_orderdate) AS ano, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P
FROM orders GROUP BY 1
""")
def pivot_counts(spark, sf_dir):
    orders = orders_by_month(spark, sf_dir).withColumn("ano", F.col("ano").cast("long"))
    return rel.pivot_counts(orders, ["ano"], "o_orderstatus", ["O", "F", "P"])


@register("""
SELECT CASE WHEN p_size < 5 THEN '0-4' WHEN p_size < 15 THEN '5-14' WHEN p_size < 45 THEN '15-44' ELSE '45+' END AS band, count(*) AS n,
  round(avg(p_retailprice), 2) AS mean_price, count(DISTINCT p_brand) AS brands
FROM part GROUP BY 1
""")
def age_bands(spark, sf_dir):
    band = rel.banded(F.col("p_size"), [0, 5, 15, 45])
    return table(spark, sf_dir, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("mean_price"), F.countDistinct("p_brand").alias("brands"))


@register("""
SELECT l_returnflag, bool_and(l_linestatus = 'F') AS all_filled, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted, count(*) FILTER (WHERE l_quantity < 10) AS small
FROM lineitem GROUP BY 1
""")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bool_and(F.col("l_linestatus") == "F").alias("all_filled"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.expr("count(*) FILTER (WHERE l_quantity < 10)").alias("small"))


@register("""
SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order
FROM orders GROUP BY 1
""")
def first_by_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@register("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1
""")
def keep_first_ordered(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


@register("""
WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT round(100.0 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / greatest(sum(n), 1), 1) AS pct_duplicated FROM n
""")
def duplicated_share(spark, sf_dir):
    return rel.duplicated_share(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@register("""
SELECT character, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS character FROM part) WHERE character <> '' GROUP BY 1
""")
def characters(spark, sf_dir):
    return rel.characters(table(spark, sf_dir, "part"), "p_name")


@register("SELECT length(p_name) AS length, count(*) AS n FROM part GROUP BY 1")
def length_histogram(spark, sf_dir):
    return rel.lengths(table(spark, sf_dir, "part"), "p_name")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@register("""
SELECT o_orderkey AS k, o_totalprice AS amount, NULL AS note FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1
""")
def widen_by_name(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    even = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    odd = orders.where("o_orderkey % 2 = 1").select(F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("k"))
    return rel.union_by_name([even, odd])


# ---------------------------------------------------------------- rules

SIM = {"kind": "sim", "ignored_values": ["000", "999"], "units": {"0": {"unit": "minute"}, "1": {"unit": "hour"}, "2": {"unit": "day"}, "3": {"unit": "month"}, "4": {"unit": "year"}, "5": {"unit": "year", "offset": 100}}}
SIH = {"kind": "sih", "invalid_composites": ["000", "999"], "ignored_units": ["0"], "units": {"2": {"unit": "day", "maximum_value": 30}, "3": {"unit": "month", "maximum_value": 11}, "4": {"unit": "year", "maximum_value": 99}, "5": {"unit": "year", "offset": 100, "maximum_value": 50}}}
YEARS = {"kind": "years", "ignored_values": ["0", "00", "99"], "units": {"year": {"unit": "year", "minimum_value": 1, "maximum_value": 65}}}


def age_columns(found):
    return [found.years.alias("years"), found.status.alias("status"), found.quantity.alias("quantity"), found.unit.alias("unit")]


@register("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'x1' ELSE lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS v FROM orders),
s AS (SELECT *, CASE WHEN v = '' THEN 'missing' WHEN NOT regexp_full_match(v, '[0-9]{3}') THEN 'invalid' WHEN v IN ('000', '999') THEN 'ignored' WHEN left(v, 1) <= '5' THEN 'valid' ELSE 'unsupported' END AS status,
  left(v, 1) AS u, TRY_CAST(substr(v, 2, 2) AS INTEGER) AS q FROM r)
SELECT o_orderkey, status,
  CASE WHEN status = 'valid' THEN CASE u WHEN '3' THEN q // 12 WHEN '4' THEN q WHEN '5' THEN q + 100 ELSE 0 END END AS years,
  CASE WHEN status = 'valid' THEN CASE u WHEN '5' THEN q + 100 ELSE q END END AS quantity,
  CASE WHEN status = 'valid' THEN CASE u WHEN '0' THEN 'minute' WHEN '1' THEN 'hour' WHEN '2' THEN 'day' WHEN '3' THEN 'month' ELSE 'year' END END AS unit
FROM s
""")
def age_rule_sim(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 11 == 0, " \t").when(key % 13 == 0, "x1").otherwise(F.lpad((key % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *age_columns(rules.age(SIM, value)))


@register("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 120 AS VARCHAR) END AS v, CAST(o_orderkey % 7 AS VARCHAR) AS u FROM orders),
t AS (SELECT *, TRY_CAST(v AS BIGINT) AS q FROM r),
s AS (SELECT *, CASE WHEN v IS NULL THEN 'missing' WHEN q <= 99 AND u || lpad(v, 2, '0') IN ('000', '999') THEN 'invalid' WHEN u = '0' THEN 'ignored'
  WHEN (u = '2' AND q <= 30) OR (u = '3' AND q <= 11) OR (u = '4' AND q <= 99) OR (u = '5' AND q <= 50) THEN 'valid' ELSE 'unsupported' END AS status FROM t)
SELECT o_orderkey, status, CASE WHEN status = 'valid' THEN CAST(CASE u WHEN '4' THEN q WHEN '5' THEN q + 100 WHEN '3' THEN q // 12 ELSE 0 END AS INTEGER) END AS years,
  CASE WHEN status = 'valid' THEN CAST(CASE u WHEN '5' THEN q + 100 ELSE q END AS INTEGER) END AS quantity,
  CASE WHEN status = 'valid' THEN CASE u WHEN '2' THEN 'day' WHEN '3' THEN 'month' ELSE 'year' END END AS unit
FROM s
""")
def age_rule_sih(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 17 != 0, (key % 120).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *age_columns(rules.age(SIH, value, (key % 7).cast("string"))))


@register("""
WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 100 AS VARCHAR) AS v, o_orderkey % 100 AS q FROM orders)
SELECT o_orderkey, CASE WHEN v IN ('0', '99') THEN 'ignored' WHEN q BETWEEN 1 AND 65 THEN 'valid' ELSE 'unsupported' END AS status,
  CAST(CASE WHEN q BETWEEN 1 AND 65 THEN q END AS INTEGER) AS years FROM r
""")
def age_rule_years(spark, sf_dir):
    found = rules.age(YEARS, (F.col("o_orderkey") % 100).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.years.alias("years"), found.status.alias("status"))


@register("""
WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '1' WHEN 1 THEN 'M' WHEN 2 THEN '2' WHEN 3 THEN '9' WHEN 4 THEN ' ' ELSE 'Z' END AS v FROM customer)
SELECT c_custkey, CASE WHEN v IN ('1', 'M') THEN 'male' WHEN v = '2' THEN 'female' END AS sex,
  CASE WHEN v = ' ' THEN 'missing' WHEN v IN ('1', 'M', '2') THEN 'valid' WHEN v = '9' THEN 'ignored' ELSE 'unsupported' END AS status FROM r
""")
def sex_rule(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, ("1", "M", "2", "9", "   ", "Z"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    category, status = rules.sex({"categories": {"1": "male", "M": "male", "2": "female", "9": None}}, value)
    return table(spark, sf_dir, "customer").select("c_custkey", category.alias("sex"), status.alias("status"))


@register("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '31021999' WHEN o_orderkey % 10 = 0 THEN '1012023' WHEN o_orderkey % 21 = 1 THEN NULL ELSE strftime(o_orderdate, '%d%m%Y') END AS v FROM orders),
d AS (SELECT *, CASE WHEN regexp_full_match(v, '[0-9]{8}') THEN CAST(try_strptime(v, '%d%m%Y') AS DATE) END AS d FROM r)
SELECT o_orderkey, d AS day, CASE WHEN v IS NULL THEN 'missing' WHEN d IS NULL THEN 'invalid' ELSE 'valid' END AS status FROM d
""")
def date_rule(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 9 == 0, "31021999").when(key % 10 == 0, "1012023").when(key % 21 != 1, F.date_format("o_orderdate", "ddMMyyyy"))
    day, status = rules.date(value, "ddMMyyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), status.alias("status"))


@register("SELECT o_orderkey, nullif(left(trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' ' || CAST(o_orderkey * 100 AS VARCHAR) END), 6), '') AS k FROM orders")
def join_key(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit(" "), (key * 100).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.municipality_join_key(value).alias("k"))


@register(r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[-./ ][0-9]+)*')) AS run FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, length(run) + 1), lambda k: CASE WHEN k = 1 OR NOT regexp_matches(substr(run, CAST(k AS INT) - 1, 1), '[0-9]') THEN substr(run, CAST(k AS INT), 14) END)) AS s FROM m),
g AS (SELECT doc_id, regexp_replace(regexp_extract(s, '^([0-9]{3}[. ]?[0-9]{3}[. ]?[0-9]{3}[-/ ]?[0-9]{2})($|[^0-9])', 1), '[^0-9]', '', 'g') AS d FROM p WHERE s IS NOT NULL),
c AS (SELECT doc_id, d, list_sum(list_transform(range(0, 9), lambda i: CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) * (10 - i))) * 10 % 11 % 10 AS a,
  list_sum(list_transform(range(0, 10), lambda i: CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) * (11 - i))) * 10 % 11 % 10 AS b FROM g WHERE length(d) = 11)
SELECT doc_id, doc_id IN (SELECT doc_id FROM c WHERE a = CAST(substr(d, 10, 1) AS INT) AND b = CAST(substr(d, 11, 1) AS INT) AND d <> repeat(substr(d, 1, 1), 11)) AS has_cpf FROM documents
""")
def cpf_detector(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_cpf("text").alias("has_cpf"))


@register("""
SELECT l_orderkey, l_linenumber, CAST(year(b) - year(a) - CASE WHEN strftime(b, '%m%d') < strftime(a, '%m%d') THEN 1 ELSE 0 END AS INTEGER) AS years
FROM (SELECT l_orderkey, l_linenumber, o_orderdate AS a, l_shipdate + INTERVAL 400 DAY AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
""")
def exact_age(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", rules.completed_years(F.to_date("o_orderdate"), F.date_add(F.to_date("l_shipdate"), 400)).alias("years"))


@register("""
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y%m') || '01', '%Y%m%d') AS DATE) AS month_start,
  CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
  CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 365.25) AS INTEGER) AS years FROM orders
""")
def date_functions(spark, sf_dir):
    day, start = F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.month_start(F.date_format("o_orderdate", "yyyyMM")).alias("month_start"), F.to_date(F.add_months(F.trunc(day, "MM"), 1)).alias("next_month"), F.datediff(day, start).alias("days"), F.floor(F.datediff(day, start) / 365.25).cast("int").alias("years"))
