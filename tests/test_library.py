"""Operators that no query of the catalogue reaches, and what they refuse."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sanilake.functions import harmonised, labels, rules
from sanilake.operators import linkage, records
from sanilake.operators import relational as rel
from sanilake.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exactly_one_and_upsert(spark):
    one = frame(spark, [("a", 1), ("b", 2)], "k string, v int")
    assert rel.exactly_one(one, ["k"], "label").count() == 2
    with pytest.raises(Exception, match="more than one label"):
        rel.exactly_one(one.union(one), ["k"], "label").collect()
    new = frame(spark, [("b", 5, "x")], "k string, v int, w string")
    assert got(rel.upsert(one, new, ["k"])) == [("a", 1, None), ("b", 5, "x")]


def test_reference_join_sql(spark):
    frame(spark, [(1,), (2,)], "c int").createOrReplaceTempView("ref_data")
    frame(spark, [(1, "one", True), (2, "two", False)], "k int, name string, good boolean").createOrReplaceTempView("ref_words")
    join = rel.reference_join_sql("c", "ref_words", "k", rule="{r}.good")
    assert got(spark.sql(f"SELECT d.c, r.name FROM ref_data d {join}")) == [(1, "one"), (2, None)]


def test_next_key_is_stable(spark):
    keys = frame(spark, [(k,) for k in [5, 1, 9, 9, None, 3, 7]], "k int").repartition(3)
    assert got(rel.next_key(keys, "k")) == [(1, 3), (3, 5), (5, 7), (7, 9), (9, None)]
    assert rel.next_key(keys.where("false"), "k").count() == 0


def test_days_held(spark):
    stays = frame(spark, [("2020-01-01", "2020-01-03"), ("2020-01-03", "2020-01-03"), ("2020-01-09", "2020-01-08"), (None, "2020-01-01"), ("2020-02-01", "2020-02-01")], "a string, b string")
    stays = stays.select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    expanded = rel.expand_days(stays, "a", "b").groupBy("day").agg(F.count("*").alias("n"))
    assert got(rel.days_held(stays, "a", "b")) == got(expanded)


def test_linkage_reports(spark):
    a = frame(spark, [(1, "x", 30), (2, "y", 40)], "id int, k string, age int")
    b = frame(spark, [(7, "x", 30), (8, "y", 47)], "id int, k string, age int")
    found = linkage.link_in_steps(a, b, [["k"]], "age", F.col("age") + 2)
    both = linkage.detail(found.pairs.select("id", "id_b"), a, b)
    assert got(both.select("id", "id_b", "age", "age_b")) == [(1, 7, 30, 30), (2, 8, 40, 47)]
    assert got(linkage.compare(both, both.where("false"), [("age", None)])) == [("age", 2, 50.0, 0.0)]
    steps = linkage.Linkage(found.pairs, frame(spark, [(1, "k", 10, 0, 0.0), (2, "l", 4, 4, 100.0)], "step int, keys string, pairs long, control_pairs long, pct_by_chance double"))
    said = linkage.summary("x", 20, steps, 95.0)
    assert (said["pairs"], said["discarded_steps"], said["discarded_pairs"], said["verdict"]) == (10, [2], 4, "viável")


def test_labels_on_the_driver_and_by_join(spark):
    maps = {"sexo": {1: "um", "M": "eme"}}
    assert labels.display_row(maps, {"SEXO": " 01 ", "x": 3}) == {"SEXO": "um", "x": 3}
    df = frame(spark, [("01",), (" M ",), ("Z",), (None,)], "sexo string")
    by_join = labels.join_labels(df, "sexo", maps["sexo"], "l").select("sexo", "l")
    assert got(by_join) == got(df.select("sexo", labels.lookup(maps["sexo"], "sexo").alias("l")))


def test_small_sources(spark, tmp_path):
    assert files.base_name("/a/b/DOAC1996.dbc") == "DOAC1996.dbc"
    assert files.planned_scopes(spark, [2020, 2021], ["RR"], [None]).count() == 2
    page = files.stock_page(spark, [{"a": 1}, {"b": None, "a": "x"}])
    assert got(page) == [("1", None, False), ("x", None, False)]
    with pytest.raises(ValueError, match="more than"):
        files.stock_page(spark, [{}] * 3, limit=2)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("part1.csv", "a;b\n")
    assert open(files.unpack(str(tmp_path / "z.zip"), r"part\d\.csv", str(tmp_path))).read() == "a;b\n"
    with pytest.raises(ValueError, match="0 members"):
        files.unpack(str(tmp_path / "z.zip"), "other", str(tmp_path))


AGE = {"field": "idade", "kind": "sim", "units": {"4": {"unit": "year"}}}
RULES = {"age": AGE, "sex": {"field": "sexo", "categories": {"1": "m", "9": None}}, "dates": ["dt"], "validated_sources": [{"uf": "RR", "ano": 2023, "release": "final", "source_sha256": "aa"}]}
HERE = [harmonised.Context({"uf": "RR", "ano": 2023}, "final", "aa")]


def test_harmonised_columns(spark):
    df = frame(spark, [("430", "1", "01022023"), ("", "9", "x")], "IDADE string, sexo string, dt string")
    found = harmonised.projection(RULES, df.schema, HERE, {"dt": "ddMMyyyy"})
    assert not found.unavailable and set(harmonised.inputs(RULES)) == {n for n, _ in found.columns}
    first, second = found.over(df).collect()
    assert (first["idade_anos_completos"], first["sexo_categoria"], str(first["dt_data"])) == (30, "m", "2023-02-01")
    assert (second["idade_status"], second["sexo_status"], second["dt_data_status"]) == ("missing", "ignored", "invalid")


@pytest.mark.parametrize(
    ("rules_", "contexts", "formats", "why"),
    [
        (None, HERE, {}, {"idade_anos_completos": "unsupported_dataset", "sexo_categoria": "unsupported_dataset"}),
        ({"sex": RULES["sex"]}, HERE, {}, {"idade_anos_completos": "unsupported_field", "sexo_categoria": "unconfirmed_source_scope"}),
        (RULES, [], {"dt": "ddMMyyyy"}, {"idade_anos_completos": "missing_source_field", "sexo_categoria": "unconfirmed_source_scope", "dt_data": "unconfirmed_source_scope"}),
        (RULES, HERE + [harmonised.Context({"uf": "RR", "ano": 2023}, "preliminary", "aa")], {}, {"idade_anos_completos": "missing_source_field", "sexo_categoria": "unconfirmed_source_scope", "dt_data": "unconfirmed_source_scope"}),
        (RULES, HERE, {"dt": "MMyyyy"}, {"idade_anos_completos": "missing_source_field", "dt_data": "unsupported_date_format"}),
    ],
)
def test_why_harmonised_columns_are_not_there(spark, rules_, contexts, formats, why):
    schema = frame(spark, [], "sexo string, dt string").schema
    assert harmonised.projection(rules_, schema, contexts, formats).unavailable == why


def test_harmonised_names_that_are_taken(spark):
    with pytest.raises(ValueError, match="case"):
        harmonised.projection(RULES, frame(spark, [], "a int, A int").schema, HERE)
    with pytest.raises(ValueError, match="there already"):
        harmonised.projection(RULES, frame(spark, [], "sexo string, SEXO_STATUS string").schema, HERE)


def test_record_ids_tell_rows_apart(spark):
    df = frame(spark, [("a", None), ("a", None), ("a", "-"), ("a,1", "b"), ("a", "1,b")], "x string, y string")
    ids = [r["record_id"] for r in records.with_record_id(df).collect()]
    assert len(set(ids)) == 5 and len({i[:64] for i in ids}) == 4


def test_age_domains(spark):
    def status(rule, value, unit=None):
        return spark.range(1).select(rules.age(rule, F.lit(value), F.lit(unit) if unit else None).status).first()[0]

    sih = {"kind": "sih", "units": {"2": {"unit": "day"}, "3": {"unit": "month"}, "4": {"unit": "year"}, "5": {"unit": "year", "offset": 100}}}
    assert [status(sih, v, u) for v, u in (("5", "2"), ("5", "3"), ("500", "4"), ("2147483647", "4"), ("2147483600", "5"))] == ["unsupported", "unsupported", "valid", "valid", "unsupported"]
    sinan = {"kind": "sinan", "units": {"2": {"unit": "day"}, "3": {"unit": "month", "maximum_value": 11}, "4": {"unit": "year", "minimum_value": 2}}}
    assert [status(sinan, v) for v in ("2099", "2100", "3011", "3012", "4001", "4002")] == ["valid", "unsupported", "valid", "unsupported", "unsupported", "valid"]


def test_records_with_columns_of_inner_names(spark):
    rows = spark.createDataFrame([("x", 1, {"a": 1}), ("x", 1, {"a": 1}), ("x", 1, {"a": 1}), ("y", None, None)], "digest string, copies int, row map<string,int>")
    got = records.with_record_id(rows.withColumn("Record_Id", F.lit("old")))
    ids = sorted(r["record_id"].rsplit("-", 1)[1] for r in got.where("digest = 'x'").collect())
    assert got.columns == ["digest", "copies", "row", "record_id"] and ids == ["1", "2", "3"] and got.count() == 4
    df = spark.createDataFrame([("1", "p"), ("2", "q"), (None, "r")], "known string, n string")
    assert records.register_check(df, "known", df.where("n = 'p'").select("known"), F.col("n") == "q").first().asDict() == {"pct_known": 50.0, "codes_outside": 1, "pct_elsewhere": 100.0}
    assert records.subset_matches(df, df.limit(1)).first().asDict() == {"one": 1, "none": 2, "several": 0}
    days = spark.sql("SELECT 'k' AS a, date '2024-01-31' AS x, date '2024-03-01' AS y")
    assert [tuple(r) for r in records.month_lag(days, days, "a", "x", "y").collect()] == [(2024, 2, 1)]
