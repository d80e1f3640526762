"""From parts to publications, runs that can be cited, population editions, and the small functions beside them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_metadata import GOOD, RULE, changed
from test_sources import as_dbc, dbf

from sanilake.functions import harmonised, text
from sanilake.operators import relational as rel
from sanilake.plans import imports
from sanilake.plans.lake import Lake, PublicationError, SourceFile, combined_sha256

SCOPE = {"uf": "MG", "ano": 2024, "mes": 12}


def write_parts(folder, sizes, name="BIMG2412"):
    folder.mkdir(exist_ok=True)
    for k, n in sizes.items():
        (folder / f"{name}_{k}.dbc").write_bytes(as_dbc(dbf([("PROC", "N", 4, 0), ("X", "C", 2, 0)], [(str(100 * k + i).rjust(4).encode(), b"a ") for i in range(n)])))


def test_parts_are_one_publication(spark, tmp_path):
    write_parts(tmp_path / "ftp", {10: 2, 2: 3, 1: 4})
    lake = Lake(spark, str(tmp_path / "lake"))
    made = imports.publish_parts(lake, "bi", str(tmp_path / "ftp"), SCOPE, "v1", run_id="r", declared={"proc": "string"})
    assert made.rows == 9 and [s["uri"].rsplit("_", 1)[1] for s in made.sources] == ["1.dbc", "2.dbc", "10.dbc"]
    raw = [(tmp_path / "ftp" / f"BIMG2412_{k}.dbc").read_bytes() for k in (1, 2, 10)]
    assert [s["sha256"] for s in made.sources] == [hashlib.sha256(x).hexdigest() for x in raw] and [s["bytes"] for s in made.sources] == [len(x) for x in raw]
    assert made.sha256 == combined_sha256([SourceFile(s["uri"], s["sha256"], s["bytes"]) for s in made.sources])
    rows = lake.table("bi")
    assert rows.schema["proc"].dataType == T.StringType() and rows.where("proc = '1000' and mes = 12 and _source_release = 'final'").count() == 1
    assert imports.publish_parts(lake, "bi", str(tmp_path / "ftp"), SCOPE, "v1", policy="skip_same", declared={"proc": "string"}) is None
    write_parts(tmp_path / "other", {3: 1})
    both = f"{tmp_path}/ftp/BIMG2412_1.dbc,{tmp_path}/other/BIMG2412_3.dbc"
    with pytest.raises(PublicationError, match="several folders"):
        imports.publish_parts(lake, "bi", both, SCOPE, "v1", policy="replace")
    assert "several folders" in lake.attempts()[-1]["error"] and lake.table("bi").count() == 9


def test_research_runs(spark, tmp_path):
    write_parts(tmp_path / "a", {1: 2})
    write_parts(tmp_path / "b", {1: 3})
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "X.dbc").write_bytes(b"broken")
    lake = Lake(spark, str(tmp_path / "lake"))
    uris = [({"uf": u, "ano": 2024}, str(tmp_path / f)) for u, f in (("MG", "a"), ("SP", "c"), ("RR", "b"))]
    done = imports.import_research(lake, "t", uris, "tese-1", "v1")
    assert [p.scope["uf"] for p in done.published] == ["MG", "RR"] and [s["uf"] for s, _ in done.failed] == ["SP"] and not done.unchanged
    assert {p.run_id for p in lake.publications("t")} == {"tese-1"} and [a["run_id"] for a in lake.attempts()] == ["tese-1"]
    again = imports.import_research(lake, "t", [uris[0], uris[2]], "tese-1", "v1")
    assert len(again.unchanged) == 2 and lake.table("t").count() == 5
    for run_id, policy in ((" ", "skip_same"), ("x", "append")):
        with pytest.raises(ValueError):
            imports.import_research(lake, "t", uris, run_id, "v1", policy=policy)
    imports.save_result(lake.table("t").groupBy("uf").count(), str(tmp_path / "result"), lake.publications("t"), lake.latest_snapshot_id(), "T")
    (csv,) = (tmp_path / "result" / "result").glob("*.csv")
    assert sorted(csv.read_text().split()) == ["MG,2", "RR,3", "uf,count"]
    (said,) = (tmp_path / "result" / "citation").glob("*.txt")
    assert "BIMG2412_1.dbc" in said.read_text()


def documents(spark, found):
    return spark.createDataFrame([("e", 2024, r, json.dumps(b)) for r, b in found.items()], "edition string, year int, role string, body string")


def test_population_editions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    first = imports.append_population(lake, documents(spark, GOOD), RULE)
    assert {tuple(r) for r in imports.population(lake).collect()} == {("1100015", 2024, 7), ("1100023", 2024, 12)}
    manifest = lake.table(imports.MANIFEST).first()
    assert (manifest["publication_id"], manifest["rows"], len(manifest["evidence"])) == (first, 2, 5)
    snapshot = lake.latest_snapshot_id()
    with pytest.raises(Exception, match="another aggregate"):
        imports.append_population(lake, documents(spark, changed("metadata", ["id"], 1)), RULE)
    assert lake.latest_snapshot_id() == snapshot and lake.table(imports.POPULATION).count() == 2
    imports.append_population(lake, documents(spark, GOOD), RULE)
    for read in (imports.population(lake).count, imports.population(lake).select("codigo_ibge").collect):
        with pytest.raises(Exception, match="more than one population"):
            read()
    assert imports.population(lake, snapshot).count() == 2
    other = Lake(spark, str(tmp_path / "other"))
    other.ingest(imports.POPULATION, spark.range(1))
    with pytest.raises(PublicationError, match="wasn't made here"):
        imports.append_population(other, documents(spark, GOOD), RULE)


def test_uri_parts(spark):
    cases = {
        "ftp://User@Ftp.Host.BR:21/a b/c/DORR2023.DBC": ("ftp", "ftp.host.br", 21, "/a b/c/DORR2023.DBC", "/a b/c", "DORR2023.DBC", "dbc"),
        "https://h/x.tar.gz?q=/y.z#f": ("https", "h", None, "/x.tar.gz", "", "x.tar.gz", "gz"),
        "http://h": ("http", "h", None, None, None, None, None),
        "http://h/d/": ("http", "h", None, "/d/", "/d", None, None),
        "a/.hidden": (None, None, None, "a/.hidden", "a", ".hidden", None),
        "name": (None, None, None, "name", None, "name", None),
        "": (None,) * 7,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: tuple(r["p"]) for r in rows.select("u", text.uri_parts(F.col("u")).alias("p")).collect()} == cases
    got = imports.citation_files(spark.createDataFrame([("ftp://h/a/b.dbc",), (None,)], "uri string")).collect()
    assert [tuple(r)[1:] for r in got] == [("h", "/a", "b.dbc"), (None, None, None)]


def test_loose_numbers(spark):
    said = {" 12 ": (12, 12.0), "1,5": (None, 1.5), "7.0": (7, 7.0), "1e3": (None, None), "-3": (-3, -3.0), "": (None, None), "x": (None, None), "9" * 20: (None, float("9" * 20)), "\x00 4\t": (4, 4.0), ".5": (None, 0.5), ".": (None, None)}
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    assert {r[0]: (r[1], r[2]) for r in rows.select("t", text.loose_number(F.col("t")), text.loose_number(F.col("t"), "double")).collect()} == said


def test_prefixes_and_differences(spark):
    codes = spark.createDataFrame([(" a001 ", 1), ("A0", 2), (None, 3), ("Z99", 4)], "code string, label int")
    chapters = spark.createDataFrame([("A00", "x"), ("B00", "y")], "prefix string, label string")
    got = {r["label"]: r["label_ref"] for r in rel.prefix_join(codes, "code", chapters, "prefix", 3).collect()}
    assert got == {1: "x", 2: None, 3: None, 4: None}
    with pytest.raises(Exception, match="more than one reference"):
        rel.prefix_join(codes, "code", chapters.unionAll(spark.createDataFrame([("a00", "z")], chapters.schema)), "prefix", 3).select("label_ref").collect()
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert {r[0] for r in rel.difference(a, b, ["x"], ["y"]).collect()} == {1, None} and rel.difference(a, b.unionAll(a), ["x"], ["y"]).count() == 0
    assert rel.absent_columns(codes, ["CODE", "Other ", "label"]) == ["Other "]


def test_versions_and_hashes_of_rules():
    rules = {"version": "1.1.0", "sex": {"field": "sexo", "categories": {"1": "masculino"}}, "validated_sources": []}
    schema = T.StructType([T.StructField("sexo", T.StringType())])
    found = harmonised.projection(rules, schema, [], rule_version="1.1.0")
    want = json.dumps(rules, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert (found.rule_version, found.metadata_hash) == ("1.1.0", hashlib.sha256(want.encode()).hexdigest())
    with pytest.raises(ValueError, match="1.0.0"):
        harmonised.projection(rules, schema, [], rule_version="1.0.0")
    assert harmonised.projection(None, schema, []).rule_version is None
