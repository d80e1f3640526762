"""Canonical JSON, registries, aggregates, vocabularies, supertypes, guards and next keys."""

import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.functions import canonical
from sanilake.functions.harmonised import Context, confirmed
from sanilake.operators import linkage
from sanilake.operators import relational as rel
from sanilake.plans.lake import Lake, SourceFile, publication_table, with_sources
from sanilake.sources import aggregates, registry, vocabularies


def dumps(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


# ---------------------------------------------------------------- canonical JSON

KIND = "struct<z: string, a: bigint, m: map<string, array<double>>, n: struct<b: boolean, `A b`: string>, l: array<struct<y: int, x: string>>>"
TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=8)
DOUBLE = st.one_of(st.sampled_from([0.0, -0.0, 1.0, 1e16, 123456789012345680.0, 1e-4, 1e-5, 0.001, 1.5e300, -2.5e-7, 9999999.0, 1e7, 12345678.5]), st.integers(-(10**9), 10**9).map(lambda n: n / 8))
VALUE = st.fixed_dictionaries(
    {
        "z": st.none() | TEXT,
        "a": st.none() | st.integers(-(2**63), 2**63 - 1),
        "m": st.none() | st.dictionaries(TEXT, st.none() | st.lists(st.none() | DOUBLE, max_size=3), max_size=4),
        "n": st.none() | st.fixed_dictionaries({"b": st.none() | st.booleans(), "A b": st.none() | TEXT}),
        "l": st.none() | st.lists(st.none() | st.fixed_dictionaries({"y": st.none() | st.integers(-9, 9), "x": st.none() | TEXT}), max_size=3),
    }
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VALUE, min_size=30, max_size=60))
def test_canonical_json(spark, values):
    kind = T._parse_datatype_string(KIND)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], T.StructType([T.StructField("k", T.LongType()), T.StructField("v", kind)]))
    got = rows.select("k", canonical.canonical_json(F.col("v"), kind).alias("t"), canonical.canonical_sha256(F.col("v"), kind).alias("h")).collect()
    for r in got:
        want = dumps(values[r["k"]])
        assert r["t"] == want and r["h"] == hashlib.sha256(want.encode()).hexdigest()


def test_canonical_json_of_every_control_character(spark):
    texts = [chr(c) for c in range(0x21)] + ['"\\/\x7f é😀\x01\n', "\\u0001", "\\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", canonical.canonical_json(F.col("t"), T.StringType())).collect()} == {t: dumps(t) for t in texts}
    one = spark.range(1)
    kind = T._parse_datatype_string("struct<a: int, b: string>")
    empty = F.struct(F.lit(None).cast("int").alias("a"), F.lit("x").alias("b"))
    assert one.select(canonical.canonical_json(empty, kind, absent_nulls=True)).first()[0] == '{"b":"x"}'
    with pytest.raises(Exception, match="NaN"):
        one.select(canonical.canonical_json(F.lit(float("nan")), T.DoubleType())).collect()
    with pytest.raises(TypeError):
        canonical.canonical_json(F.lit(b""), T.BinaryType())


def test_scopes_as_text(spark):
    rows = spark.createDataFrame([(2024, 1, "RR"), (2023, None, None)], canonical.SCOPE)
    got = rows.select(canonical.scope_json(F.struct("ano", "mes", "uf")).alias("t")).withColumn("s", canonical.scope_of(F.col("t"))).collect()
    assert [r["t"] for r in got] == ['{"ano":2024,"mes":1,"uf":"RR"}', '{"ano":2023}'] and [tuple(r["s"]) for r in got] == [(2024, 1, "RR"), (2023, None, None)]
    for wrong in ('{"ano": 2023}', '{"ano":2023,"x":1}', "no"):
        with pytest.raises(Exception, match="not a scope"):
            spark.createDataFrame([(wrong,)], "t string").select(canonical.scope_of(F.col("t"))).collect()


# ---------------------------------------------------------------- registry

FIELD = {"name": "SEXO", "label": "Sex", "type": "string", "codes": [{"value": "1", "label": "m"}, {"value": "9", "label": "?", "missing_kind": "ignored"}], "references": [{"table": "voc_sex", "key": "code"}]}
DATASET = {"name": "sim_obitos", "title": "Deaths", "version": "3", "encoding": "latin-1", "identity": {"prefix": "DO"}, "geography": "state", "cadence": "monthly", "prefix": "DO", "folder": "/do", "coverage": {"first": {"year": 2014, "month": 8}}, "validated": [{"uf": "RR", "ano": 2023, "mes": 1}, {"ano": 2023}], "fields": [FIELD, {"name": "IDADE"}]}
SOURCES = [{"id": "manual", "authority": "official"}, {"id": "blog", "authority": "other"}]


def made(spark, folder, documents, sources=SOURCES):
    for k, d in enumerate(documents):
        (folder / f"d{k}.json").write_text(json.dumps(d, indent=1, ensure_ascii=False))
    for k, s in enumerate(sources):
        (folder / f"s{k}.json").write_text(json.dumps(s))
    return registry.Registry.read(spark, str(folder / "d*.json"), str(folder / "s*.json"))


def sha(value):
    return hashlib.sha256(dumps(value).encode()).hexdigest()


def test_registry_tables(spark, tmp_path):
    claim = {"target": "/field/codes", "value_sha256": sha(FIELD["codes"]), "status": "verified_in_source", "evidence": [{"source_id": "manual"}]}
    found = made(spark, tmp_path, [DATASET | {"fields": [FIELD | {"claims": [claim]}, {"name": "IDADE"}]}, {"name": "sih_aih", "cadence": "yearly", "coverage": {"first": {"year": 1992}, "last": {"year": 1995}}}]).checked()
    rows = {r["name"]: r for r in found.datasets().collect()}
    sim, sih = rows["sim_obitos"], rows["sih_aih"]
    assert (sim["category"], sim["coverage_start"], sim["coverage_end"], sim["fields"], sim["labelled_fields"], sim["validated_scopes"]) == ("SIM", "2014-08", None, 2, 1, ["RR_2023_01", "national_2023"])
    assert (sih["coverage_start"], sih["coverage_end"], sih["fields"], sih["validated_scopes"]) == ("1992", "1995", 0, [])
    assert [(r["value"], r["missing_kind"]) for r in found.codes().orderBy("place").collect()] == [("1", "unknown"), ("9", "ignored")]
    assert [tuple(r) for r in found.references().collect()] == [("sim_obitos", "SEXO", "voc_sex", "code")]
    assert {r["name"]: r["domain"] for r in found.fields().collect()} == {"SEXO": "enum", "IDADE": "unknown"}
    claims = {(r["field"], r["target"]): (r["value_sha256"], r["status"]) for r in found.claims().collect()}
    assert len(claims) == 16 and claims["SEXO", "/field/codes"] == (sha(FIELD["codes"]), "verified_in_source") and claims["IDADE", "/field/unit"] == (sha(None), "unreviewed")
    told = found.resolve("sim_obitos").first()
    assert [s["id"] for s in told["sources"]] == ["manual"]
    document = DATASET | {"fields": [FIELD | {"claims": [claim]}, {"name": "IDADE"}]}
    assert told["metadata_hash"] == sha({"document": document, "sources": [SOURCES[0]]})
    with pytest.raises(KeyError):
        found.resolve("none")


@pytest.mark.parametrize(
    ("field", "message"),
    [
        ({"codes": [{"value": "1"}, {"value": "1"}]}, "a code twice: 1"),
        ({"claims": [{"target": "/field/codes", "value_sha256": "0", "status": "reviewed", "evidence": []}]}, "changed since it was reviewed: /field/codes"),
        ({"claims": [{"target": "/field/none", "status": "reviewed"}]}, "a claim about nothing: /field/none"),
        ({"claims": [{"target": "/field/unit", "value_sha256": sha(None), "status": "reviewed"}] * 2}, "two claims about /field/unit"),
        ({"claims": [{"target": "/field/unit", "value_sha256": sha(None), "status": "verified_in_source", "evidence": []}]}, "verified without evidence: /field/unit"),
        ({"claims": [{"target": "/field/unit", "value_sha256": sha(None), "status": "reviewed", "evidence": [{"source_id": "lost"}]}]}, "no such source: lost"),
        ({"claims": [{"target": "/field/unit", "value_sha256": sha(None), "status": "verified_in_source", "evidence": [{"source_id": "blog"}]}]}, "isn't official: blog"),
    ],
)
def test_registry_problems(spark, tmp_path, field, message):
    with pytest.raises(registry.RegistryError, match=message):
        made(spark, tmp_path, [DATASET | {"fields": [FIELD | field]}]).checked()


def test_registry_documents_twice(spark, tmp_path):
    said = {r["problem"] for r in made(spark, tmp_path, [DATASET, DATASET], [*SOURCES, SOURCES[0]]).problems().collect()}
    assert {"two documents", "a source twice: manual", "a field twice"} <= said


def test_parser_version_depends_on_decoding_and_identity_only(spark, tmp_path):
    def version(**changes):
        folder = tmp_path / hashlib.sha256(repr(changes).encode()).hexdigest()
        folder.mkdir()
        return made(spark, folder, [DATASET | changes]).datasets().first()["parser_version"]

    first = version()
    assert first == version(title="Other", fields=[], version="4") and first.startswith("dbf-records-1:")
    assert first == f"dbf-records-1:{sha({'encoding': 'latin-1', 'identity': {'prefix': 'DO'}})}"
    assert len({first, version(encoding="cp1252"), version(identity={"prefix": "DX"})}) == 3
    lake = Lake(spark, str(tmp_path / "lake"))
    rows, source = spark.range(3).withColumn("ano", F.lit(2023)), [SourceFile("ftp://a", "0" * 64, 1, "x")]
    lake.publish("t", rows, {"ano": 2023}, source, first)
    assert lake.unchanged("t", {"ano": 2023}, source, version(title="Third"))
    assert not lake.unchanged("t", {"ano": 2023}, source, version(encoding="utf-8"))
    published = publication_table(lake).collect()
    assert [(r["table"], r["rows"], r["active"], [s["uri"] for s in r["sources"]]) for r in published] == [("t", 3, True, ["ftp://a"])]
    assert publication_table(Lake(spark, str(tmp_path / "none"))).count() == 0


def test_publications_with_sources(spark):
    sources = spark.createDataFrame([("a", 10, "z"), ("a", 2, "y"), ("c", 1, "x")], "publication_id string, position int, uri string")
    got = with_sources(spark.createDataFrame([("a",), ("b",)], "publication_id string"), sources)
    assert {r[0]: [s["uri"] for s in r[1]] for r in got.collect()} == {"a": ["y", "z"], "b": []}


# ---------------------------------------------------------------- aggregates

RULE = aggregates.Aggregate(6579, 9324, classifications={2: 0})
GOOD = {
    "metadata": {"id": 6579, "nivelTerritorial": {"Administrativo": ["N1", "N6"]}, "variaveis": [{"id": 9324, "unidade": "Pessoas"}, {"id": 1, "unidade": "%"}], "classificacoes": [{"id": 2, "categorias": [{"id": 0, "nome": "Total"}, {"id": 4, "nome": "x"}]}]},
    "periods": [{"id": "2022", "modificacao": "01/01/2023"}, {"id": "2024", "modificacao": "29/08/2024"}],
    "universe": [{"id": "1100015"}, {"id": "1100023"}],
    "population": [{"id": "9324", "unidade": "Pessoas", "resultados": [{"series": [{"localidade": {"id": "1100023"}, "serie": {"2024": "12"}}, {"localidade": {"id": "1100015"}, "serie": {"2024": "7"}}]}]}],
}
GOOD["periods_after"] = GOOD["periods"]


def changed(role, path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for p in (role, *path[:-1]):
        at = at[p]
    if path:
        at[path[-1]] = value
    else:
        out[role] = value
    return out


CASES = {
    "metadata: another aggregate": changed("metadata", ["id"], 1),
    "metadata: no N6 level": changed("metadata", ["nivelTerritorial", "Administrativo"], ["N1"]),
    "metadata: another variable or unit": changed("metadata", ["variaveis", 0, "unidade"], "Mil"),
    "metadata: other classifications": changed("metadata", ["classificacoes", 0, "id"], 3),
    "metadata: a classification without one total": changed("metadata", ["classificacoes", 0, "categorias", 0, "nome"], "Soma"),
    "periods: none": changed("periods", [], []),
    "periods: malformed or twice": changed("periods", [0, "id"], "2024"),
    "periods: the year isn't there": changed("periods", [1, "id"], "2023"),
    "periods: no date of revision": changed("periods", [1, "modificacao"], "2024"),
    "periods: not the latest edition": changed("periods", [0, "id"], "2025"),
    "periods: revised while it was fetched": changed("periods_after", [1, "modificacao"], "30/08/2024"),
    "universe: no places, or one twice": changed("universe", [1, "id"], "1100015"),
    "population: one variable is due": changed("population", [], []),
    "population: another variable or unit": changed("population", [0, "unidade"], "Mil"),
    "population: other places than there are": changed("population", [0, "resultados", 0, "series", 0, "localidade", "id"], "1"),
    "population: not a number": changed("population", [0, "resultados", 0, "series", 0, "serie", "2024"], "..."),
    "metadata: not the JSON that is due": changed("metadata", [], "text"),
    "population: not the JSON that is due": changed("population", [0, "resultados"], "text"),
}


def test_aggregates(spark):
    rows = [("good", 2024, r, json.dumps(b)) for r, b in GOOD.items()]
    for name, documents in CASES.items():
        rows += [(name, 2024, r, json.dumps(b)) for r, b in documents.items()]
    rows += [("universe: one document is due", 2024, r, json.dumps(b)) for r, b in GOOD.items() if r != "universe"]
    rows += [("periods: not the JSON that is due", 2024, r, "[{" if r == "periods" else json.dumps(b)) for r, b in GOOD.items()]
    documents = spark.createDataFrame(rows, "edition string, year int, role string, body string")
    said = {}
    for r in aggregates.problems(documents, RULE).collect():
        said.setdefault(r["edition"], set()).add(r["problem"])
    assert "good" not in said
    for name in {r[0] for r in rows} - {"good"}:
        assert name in said[name], (name, said.get(name))
    got = aggregates.reconciled(documents, RULE, strict=False).collect()
    assert sorted((r["edition"], r["code"], r["population"], str(r["revision"])) for r in got) == [("good", "1100015", 7, "2024-08-29"), ("good", "1100023", 12, "2024-08-29")]
    with pytest.raises(Exception, match="2024"):
        aggregates.reconciled(documents, RULE).collect()
    assert aggregates.problems(documents.where("false"), RULE).count() == 0


# ---------------------------------------------------------------- vocabularies


def test_vocabularies(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert vocabularies.load(spark, folder) == {"voc_region": 5, "voc_state": 27, "voc_month": 12, "voc_race": 6, "voc_sex": 3}
    assert vocabularies.read(spark, folder, "voc_state").where("state = 'RR'").first()["region"] == 1
    sexes = next(v for v in vocabularies.PACKAGED if v.name == "voc_sex")
    fewer = vocabularies.Vocabulary("voc_sex", sexes.schema, sexes.key, sexes.rows[:2])
    vocabularies.load(spark, folder, (fewer,))
    assert vocabularies.read(spark, folder, "voc_sex").count() == 2 and vocabularies.read(spark, folder, "voc_region").count() == 5
    for rows, message in ((sexes.rows * 2, "twice"), (((None, "x"),), "no key")):
        with pytest.raises(vocabularies.VocabularyError, match=message):
            vocabularies.load(spark, folder, (vocabularies.Vocabulary("voc_sex", sexes.schema, sexes.key, rows),))
    assert vocabularies.read(spark, folder, "voc_sex").count() == 2
    with pytest.raises(LookupError):
        vocabularies.read(spark, folder, "voc_none")


# ---------------------------------------------------------------- relations


def test_next_key_over_many_ranges(spark):
    rng = random.Random(3)
    numbers = rng.sample(range(10**9), 3000)
    rows = spark.createDataFrame([(n, f"k{n}") for n in numbers * 2] + [(None, None)], "n long, t string")
    for column, parts in (("n", 5000), ("t", 700), ("n", 1)):
        own = sorted(numbers if column == "n" else (f"k{n}" for n in numbers))
        got = {r[0]: r[1] for r in rel.next_key(rows, column, parts=parts).collect()}
        assert got == dict(zip(own, [*own[1:], None], strict=True))


@pytest.mark.parametrize(
    ("kinds", "want"),
    [
        (["int", "bigint", "boolean"], "bigint"),
        (["tinyint", "float"], "double"),
        (["void", "date"], "date"),
        (["date", "timestamp"], "timestamp"),
        (["date", "int"], "string"),
        (["decimal(14,2)", "decimal(10,4)"], "decimal(16,4)"),
        (["decimal(14,2)", "bigint"], "decimal(21,2)"),
        (["decimal(38,10)", "decimal(38,0)"], "string"),
        (["decimal(14,2)", "double", "int"], "double"),
        (["string", "double"], "string"),
        (["array<int>", "array<int>"], "array<int>"),
        (["array<int>", "int"], "string"),
        (["void"], "void"),
    ],
)
def test_supertypes(kinds, want):
    types = [T._parse_datatype_string(k) for k in kinds]
    assert rel.supertype(types).simpleString() == want == rel.supertype(types[::-1]).simpleString()


def test_concat_relaxed(spark):
    a = spark.sql("SELECT 1 AS x, date '2024-01-02' AS d, true AS b")
    b = spark.sql("SELECT 2.5BD AS x, 'text' AS d, 3 AS b")
    c = spark.sql("SELECT null AS x, null AS d, null AS b")
    got = rel.concat_relaxed([a, b, c])
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("x", "decimal(11,1)"), ("d", "string"), ("b", "int")]
    assert [(str(r[0]), r[1], r[2]) for r in got.collect()] == [("1.0", "2024-01-02", 1), ("2.5", "text", 3), ("None", None, None)]
    with pytest.raises(ValueError, match="frame 1 has no column 'd'"):
        rel.concat_relaxed([a, b.drop("d")])
    assert rel.concat_relaxed([a, b.drop("d")], absent="null").where("d is null").count() == 1


def test_guard_of_latest_rows(spark):
    schema = "k string, ano int, mes int, v string, w string"
    good = [("a", 2024, 1, "x", "1"), ("a", 2023, 12, "y", "2"), ("a", 2024, 1, "x", "1"), ("b", 2024, 2, None, None), ("b", None, 3, "z", "9"), (None, 2024, 1, "n", "n")]
    found = rel.register_latest("latest_good", spark.createDataFrame(good, schema), ["k"], ["ano", "mes"], ["v", "w"])
    assert sorted((tuple(r) for r in spark.sql("SELECT * FROM latest_good").collect()), key=str) == [("a", "x", "1"), ("b", None, None)] and found.count() == 2
    for bad in ([("a", 2024, 1, "x", "2")], [("c", 2024, None, "x", "1")], [("c", None, None, "x", "1")]):
        df = spark.createDataFrame(good + bad, schema)
        guarded = rel.latest_guarded(df, ["k"], ["ano", "mes"], ["v", "w"])
        for read in (guarded.count, guarded.select("k").collect, guarded.select("v").distinct().collect):
            with pytest.raises(Exception, match="conflicting latest rows"):
                read()
        with pytest.raises(Exception, match="conflicting latest rows"):
            rel.register_latest("latest_bad", df, ["k"], ["ano", "mes"], ["v", "w"])


def test_range_joins_agree(spark):
    rng = random.Random(2)
    values = spark.createDataFrame([(k, rng.randrange(100)) for k in range(300)] + [(900, None)], "k int, v int")
    ranges = spark.createDataFrame([(k, a, a + rng.randrange(-2, 30)) for k, a in enumerate(rng.randrange(110) for _ in range(60))] + [(99, None, 5), (98, 3, None)], "r int, first int, last int")
    few, many = (sorted(map(tuple, rel.range_join(values, "v", ranges, most=m).collect()), key=str) for m in (1000, 0))
    assert few == many and len(few) > 1000 and (900, None, None, None, None) in many
    words = rel.range_join(spark.createDataFrame([("A10",), ("Z",)], "code string"), "code", spark.createDataFrame([("A00", "B99")], "first string, last string"), most=0)
    assert sorted(map(tuple, words.collect())) == [("A10", "A00", "B99"), ("Z", None, None)]


def test_reasons_of_unlinked_records(spark):
    a = spark.createDataFrame([(1, "p", 1), (2, None, 1), (3, "q", None), (4, None, None), (5, "r", 1), (6, "r", 1), (7, "s", 1), (8, "t", 1)], "id int, x string, y int")
    b = spark.createDataFrame([(1, "p", 1), (2, "t", 1), (3, "t", 1), (4, "r", 1)], "id int, x string, y int")
    pairs = linkage.link(a, b, ["x", "y"])
    got = linkage.unlinked_reasons(a, b, pairs, ["x", "y"])
    assert {r["id"]: r["reason"] for r in got.collect()} == {2: "no x", 3: "no y", 4: "no x", 5: "several with these keys", 6: "several with these keys", 7: "not on the other side", 8: "several on the other side"}
    report = linkage.reason_report(got).collect()
    assert sum(r["records"] for r in report) == a.count() - pairs.count()
    assert {r["reason"] for r in linkage.unlinked_reasons(a, b, pairs.where("false"), ["x", "y"]).where("id = 1").collect()} == {"linked otherwise"}


def test_a_national_file_is_confirmed():
    known = [{"uf": None, "ano": 2023, "mes": None, "release": "final", "source_sha256": "f"}]
    assert confirmed([Context({"_source_ano": 2023}, "final", "f")], known)
    assert not confirmed([Context({"_source_ano": 2022}, "final", "f")], known) and not confirmed([Context({"_source_ano": 2023}, "prelim", "f")], known)
