import struct
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sanilake.sources import dbc, files


def imploded(data: bytes) -> bytes:
    """Literals only, then the end code."""
    bits, n = 0, 0
    for b in data:
        bits |= b << (n + 1)
        n += 9
    table = dbc.code_tables()[1]
    code = next(k for k, (s, size) in enumerate(table) if s == 15)
    size = table[code][1]
    bits |= 1 << n | (code & ((1 << size) - 1)) << (n + 1) | 0xFF << (n + 1 + size)
    n += 1 + size + 8
    return bytes([0, 6]) + bits.to_bytes(n // 8 + 1, "little")


def dbf(fields, rows, deleted=()):
    """fields: (name, kind, size, decimals); rows: tuples of padded bytes."""
    record = 1 + sum(f[2] for f in fields)
    header = 32 + 32 * len(fields) + 1
    out = bytes([3, 24, 1, 1]) + struct.pack("<IHH", len(rows), header, record) + bytes(20)
    for name, kind, size, decimals in fields:
        out += name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size, decimals]) + bytes(14)
    out += b"\r"
    for k, r in enumerate(rows):
        out += (b"*" if k in deleted else b" ") + b"".join(r)
    return out + b"\x1a"


def as_dbc(raw):
    size = int.from_bytes(raw[8:10], "little")
    return raw[:size] + b"\0\0\0\0" + imploded(raw[size:])


FIELDS = [("NOME ", "C", 6, 0), ("N", "N", 5, 0), ("V", "N", 6, 2), ("D", "D", 8, 0), ("L", "L", 1, 0)]
ROWS = [("José".encode("latin-1").ljust(6), b"   12", b"  1,50", b"20230131", b"T"), (b"x\0\0   ", b"     ", b"******", b"00000000", b"?"), (b"gone  ", b"    1", b"  1.00", b"20230101", b"F")]


def test_known_vector():
    assert dbc.explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_literals_round_trip(data):
    assert dbc.explode(imploded(data)) == data


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes_inflate_or_raise(data):
    try:
        dbc.decompress(data)
    except dbc.DbcError:
        pass


def test_source(spark, tmp_path):
    raw = dbf(FIELDS, ROWS, deleted={2})
    (tmp_path / "a.dbc").write_bytes(as_dbc(raw))
    (tmp_path / "b.dbf").write_bytes(raw)
    spark.dataSource.register(dbc.DbcDataSource)
    df = spark.read.format("dbc").load(str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("NOME", "string"), ("N", "bigint"), ("V", "double"), ("D", "date"), ("L", "boolean")]
    got = [tuple(r) for r in df.orderBy("NOME").collect()]
    assert got[0][0] == "José" and got[0][1:3] == (12, 1.5) and str(got[0][3]) == "2023-01-31" and got[0][4] is True
    assert got[2][:2] == ("x", None) and got[2][2:] == (None, None, None) and len(got) == 4
    assert df.where("N = 12").count() == 2
    only = spark.read.format("dbc").load(str(tmp_path / "*.dbc"))
    assert only.count() == 2


def test_damage(spark, tmp_path):
    raw = dbf(FIELDS, ROWS)
    with pytest.raises(dbc.DbfIntegrityError):
        list(dbc.batches(raw[:-40], "latin-1"))
    with pytest.raises(dbc.DbcError):
        dbc.decompress(as_dbc(raw)[:-30])
    with pytest.raises(dbc.DbcError):
        dbc.decompress(raw[:32])
    assert sum(b.num_rows for b in dbc.batches(raw, "latin-1", rows=2)) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(10**9), 10**17))))
def test_numbers(values):
    rows = [(b" " * 18 if v is None else str(v).rjust(18).encode(),) for v in values]
    got = [x for b in dbc.batches(dbf([("N", "N", 18, 0)], rows), "latin-1") for x in b.column(0).to_pylist()]
    assert got == values


def copying(data: bytes, distance: int, size: int = 518) -> bytes:
    """Imploded: data as literals, then copies from `distance` back, 40 of them, and the end code."""
    bits = n = 0

    def put(value: int, width: int) -> None:
        nonlocal bits, n
        bits |= value << n
        n += width

    def code(table, symbol):
        found = next(k for k, (s, _) in enumerate(table) if s == symbol)
        width = table[found][1]
        put(found & ((1 << width) - 1), width)

    _, matches, distances = dbc.code_tables()
    for b in data:
        put(b << 1, 9)
    for _ in range(40):
        put(1, 1)
        code(matches, 15)
        put(size - dbc.MATCH_BASE[15], 8)
        code(distances, (distance - 1) >> 6)
        put((distance - 1) & 63, 6)
    put(1, 1)
    code(matches, 15)
    put(0xFF, 8)
    return bytes([0, 6]) + bits.to_bytes(n // 8 + 1, "little")


@pytest.mark.parametrize("distance", [1, 7, 600, 4096])
@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_inflating_in_chunks(distance, chunk, monkeypatch):
    monkeypatch.setattr(dbc, "OUT_BYTES", 5000)  # many pieces
    start = bytes(k * 7 % 251 for k in range(4200))
    packed, want = copying(start, distance), bytearray(start)
    for _ in range(40):
        for _ in range(518):
            want.append(want[-distance])
    pieces = list(dbc.inflate(packed[k : k + chunk] for k in range(0, len(packed), chunk)))
    assert b"".join(pieces) == bytes(want) and max(map(len, pieces)) < 5000 + 4096 + 3000
    with pytest.raises(dbc.DbcError):
        list(dbc.inflate([packed[:-2]]))


def test_memory_of_a_task_does_not_grow_with_the_file(monkeypatch):
    monkeypatch.setattr(dbc, "BATCH_BYTES", 1 << 16)
    peaks = []
    for n in (20_000, 200_000):
        head = dbf([("A", "C", 20, 0), ("N", "N", 5, 0)], [])[:-1]
        head = head[:4] + struct.pack("<I", n) + head[8:]
        chunks = (c for c in [head, *[b" " + b"x" * 20 + b"   12"] * n])
        tracemalloc.start()
        rows = sum(b.num_rows for _, b in dbc.record_batches((x for x in chunks), "latin-1"))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.5 * peaks[0] + 2_000_000  # the list of chunks is shared objects, a pointer each


def test_written_files_read_back(spark, tmp_path):
    spark.dataSource.register(dbc.DbcDataSource)
    rows = spark.sql("SELECT id AS n, if(id = 3, null, concat('Jos\u00e9 ', id)) AS t, cast(id * 0.25 AS double) AS v, date_add(date '2024-02-28', cast(id AS int)) AS d, if(id = 4, null, id % 2 = 0) AS b, cast(-id AS decimal(6,2)) AS m FROM range(25)").repartition(3)
    for packed in ("true", "false"):
        folder = str(tmp_path / packed)
        rows.write.format("dbc").mode("append").option("packed", packed).option("width", 12).option("rowsPerFile", 4).save(folder)
        found = dbc.files(folder)
        assert len(found) >= 7 and all(x.endswith(".dbc" if packed == "true" else ".dbf") for x in found)
        got = dbc.read_parts(spark, folder)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double", "date", "boolean", "double"]
        want = rows.withColumns({"m": F.col("m").cast("double"), "t": F.coalesce("t", F.lit(""))})
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        rows.where("n < 2").write.format("dbc").mode("append").option("packed", packed).option("width", 12).save(folder)
        assert dbc.read_parts(spark, folder).count() == 27
    for bad, message in ((rows.select("t"), "longer than 2"), (rows.select(F.array("n").alias("a")), "has no array"), (rows.select(F.col("n").alias("much_too_long")), "longer than 10")):
        with pytest.raises(Exception, match=message):
            bad.write.format("dbc").mode("append").option("width", 2).save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or dbc.files(str(tmp_path / "bad")) == []


def part(*columns, rows):
    return dbf([(n, k, size, d) for n, k, size, d in columns], rows)


def test_parts_with_drift_are_one_table(spark, tmp_path):
    (tmp_path / "RDRR_2.dbc").write_bytes(as_dbc(part(("NUM_PROC", "N", 4, 0), ("VAL", "N", 3, 0), rows=[(b" 368", b" 12"), (b"    ", b"  7")])))
    (tmp_path / "RDRR_10.dbc").write_bytes(as_dbc(part(("num_proc", "C", 4, 0), ("VAL", "N", 6, 2), ("NOVO", "C", 1, 0), rows=[(b"0489", b"  1.50", b"x")])))
    df = dbc.read_parts(spark, str(tmp_path), drift="widen", position=True)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("num_proc", "string"), ("val", "double"), ("novo", "string"), ("_file", "string"), ("_record", "bigint")]
    got = sorted((dbc.in_part_order(r["_file"]), r["_record"], r["num_proc"], r["val"], r["novo"]) for r in df.collect())
    assert [x[1:] for x in got] == [(0, "368", 12.0, None), (1, None, 7.0, None), (0, "0489", 1.5, "x")]
    with pytest.raises(dbc.LayoutError, match="RDRR_10.*num_proc|RDRR_10.*val"):
        dbc.read_parts(spark, str(tmp_path))
    spark.dataSource.register(dbc.DbcDataSource)
    assert spark.read.format("dbc").option("drift", "widen").load(str(tmp_path)).count() == 3
    assert [dbc.files(str(tmp_path))[k].rsplit("_")[-1] for k in (0, 1)] == ["2.dbc", "10.dbc"]


def test_parts_that_clash_are_named(spark, tmp_path):
    (tmp_path / "a_1.dbf").write_bytes(part(("D", "D", 8, 0), rows=[(b"20240101",)]))
    (tmp_path / "a_2.dbf").write_bytes(part(("D", "C", 8, 0), rows=[(b"20240101",)]))
    with pytest.raises(dbc.LayoutError, match=r"a_2.*'d' is string.*a_1.*date"):
        dbc.read_parts(spark, str(tmp_path), drift="widen")
    (tmp_path / "a_2.dbf").write_bytes(part(("D", "D", 8, 0), ("d ", "C", 1, 0), rows=[]))
    with pytest.raises(dbc.LayoutError, match="a_2.*two columns"):
        dbc.read_parts(spark, str(tmp_path), drift="widen")
    (tmp_path / "a_2.dbf").write_bytes(b"short")
    with pytest.raises(dbc.LayoutError, match="a_2"):
        dbc.read_parts(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        dbc.read_parts(spark, str(tmp_path / "*.none"))


def test_staging_of_parts(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out" / "sih"
    source.mkdir()
    for k, n in ((1, 3), (2, 5)):
        (source / f"BI_{k}.dbc").write_bytes(as_dbc(dbf([("PROC", "N", 4, 0), ("X", "N", 2, 0)], [(b" 368", b" 1")] * n, deleted={0})))
    scope = {"uf": "MG", "ano": 2024, "mes": 12}
    done = dbc.stage(spark, str(source), str(target), scope, "final", declared={"proc": "string", "x": "number"})
    assert (done.rows, done.files) == (6, 2) and done.bytes > 0
    rows = spark.read.parquet(str(target))
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema] == [("proc", "string"), ("x", "double"), ("uf", "string"), ("ano", "int"), ("mes", "int"), ("_source_release", "string")]
    assert {tuple(r) for r in rows.collect()} == {("368", 1.0, "MG", 2024, 12, "final")}
    raw = dbf([("PROC", "N", 4, 0), ("X", "N", 2, 0)], [(b" 368", b" 1")] * 4)
    (source / "BI_3.dbc").write_bytes(as_dbc(raw[:4] + struct.pack("<I", 9) + raw[8:]))
    with pytest.raises(Exception, match="9 records are declared"):
        dbc.stage(spark, str(source), str(target), scope, "final", declared={"proc": "string"})
    assert spark.read.parquet(str(target)).count() == 6 and [x.name for x in (tmp_path / "out").iterdir() if ".new-" in x.name] == []
    empty = dbc.stage(spark, str(source / "BI_1.dbc"), str(target), scope, "prelim")
    assert (empty.rows, spark.read.parquet(str(target)).count()) == (2, 2)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"20240229", b"00000000", b"        ", b"19991231", b"\0" * 8, b"00010101", b"99991231"]), max_size=6))
def test_dates(values):
    got = [x for b in dbc.batches(dbf([("D", "D", 8, 0)], [(v,) for v in values]), "latin-1") for x in b.column(0).to_pylist()]
    assert [None if x is None else f"{x:%Y%m%d}".rjust(8, "0") for x in got] == [None if not v.strip(b" 0\0") else v.decode() for v in values]


@pytest.mark.parametrize("wrong", [b"20230229", b"2024-1-1", b"00001231", b"20241301", b"x       "])
def test_dates_that_are_none(wrong):
    with pytest.raises(dbc.DbfIntegrityError):
        list(dbc.batches(dbf([("D", "D", 8, 0)], [(b"20240101",), (wrong,)]), "latin-1"))


@pytest.mark.parametrize("text,whole,want", [(b"  -1.50", False, -1.5), (b"   1,25", False, 1.25), (b"    +7 ", True, 7), (b"   7.0 ", True, 7), (b"  ***  ", True, None), (b" \0 5   ", True, 5), (b"   1e2 ", False, 100.0)])
def test_numbers_beside_others(text, whole, want):
    rows = [(b"     12",), (text,), (b"       ",)]
    got = [x for b in dbc.batches(dbf([("N", "N", 7, 0 if whole else 2)], rows), "latin-1") for x in b.column(0).to_pylist()]
    assert got == [12, want, None]


def test_fixed_width(spark):
    layout = files.fixed_layout("Coluna,Tamanho,Inicio,Fim,Tipo\nCO,3,1,3,VARCHAR2\nQT,4,4,7,NUMBER\n")
    df = spark.createDataFrame([("a  0012",), ("bc     ",)], "value string")
    assert [tuple(r) for r in files.fixed_width(df, layout).collect()] == [("a", 12), ("bc", None)]
    with pytest.raises(Exception, match="7 characters"):
        files.fixed_width(spark.createDataFrame([("short",)], "value string"), layout).collect()


def test_listing(spark):
    lines = ["01-31-20  02:48PM                76107 DOAC1996.dbc", "01-31-20  02:48PM       <DIR>          A B", "nonsense"]
    got = files.listing(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (got[0]["name"], got[0]["bytes"], got[0]["is_dir"], str(got[0]["modified_at"])) == ("DOAC1996.dbc", 76107, False, "2020-01-31 14:48:00")
    assert got[1]["is_dir"] and got[1]["name"] == "A B" and not got[2]["parsed"]


@pytest.mark.parametrize(
    "name,options,scope",
    [
        ("DORR2023.dbc", {"prefix": "DO", "monthly": False}, ("RR", 2023, None, None)),
        ("RDRR2401.dbc", {"prefix": "RD", "monthly": True, "first_year": 2008}, ("RR", 2024, 1, None)),
        ("RDSP9212.dbc", {"prefix": "RD", "monthly": True, "first_year": 1992}, ("SP", 1992, 12, None)),
        ("PASP2401_2.dbc", {"prefix": "PA", "monthly": True, "first_year": 2008}, ("SP", 2024, 1, "2")),
        ("PASP2401b.dbc", {"prefix": "PA", "monthly": True, "first_year": 2008}, ("SP", 2024, 1, "b")),
        ("CHAGBR23.dbc", {"prefix": "CHAG", "monthly": False, "national": "BR", "first_year": 2000}, (None, 2023, None, None)),
        ("DOEXT22.dbc", {"prefix": "DOEXT", "monthly": False, "national": "", "first_year": 1996}, (None, 2022, None, None)),
        ("DOXX2023.dbc", {"prefix": "DO", "monthly": False}, None),
        ("RDRR2413.dbc", {"prefix": "RD", "monthly": True}, None),
        ("RDRR2401.dbc\n", {"prefix": "RD", "monthly": True, "first_year": 2008}, None),
    ],
)
def test_file_names(spark, name, options, scope):
    got = spark.range(1).select(files.file_scope(F.lit(name), **options).alias("s")).first()["s"]
    assert (tuple(got) if got else None) == scope


def test_sources_by_scope(spark):
    schema = "uf string, ano int, mes int, part string, release string, path string, bytes long, modified_at string"
    rows = [("SP", 2024, 1, None, "final", "whole", 1, "x"), ("SP", 2024, 1, "10", "final", "p10", 1, "x"), ("SP", 2024, 1, "2", "final", "p2", 1, "x"), ("RR", 2024, 1, None, "final", "rr", 1, "x")]
    got = {r["uf"]: [f["path"] for f in r["files"]] for r in files.sources_by_scope(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"SP": ["p2", "p10"], "RR": ["rr"]}
    with pytest.raises(Exception, match="two releases"):
        files.sources_by_scope(spark.createDataFrame([*rows, ("RR", 2024, 1, None, "prelim", "rr2", 1, "x")], schema)).collect()


def test_population(spark):
    body = '[{"unidade": "Pessoas", "resultados": [{"series": [{"localidade": {"id": "1"}, "serie": {"2022": "%s"}}]}]}]'
    assert tuple(files.population(spark, body % "123", ["1"], 2022).first()) == ("1", 2022, 123)
    with pytest.raises(ValueError):
        files.population(spark, body % "1", ["1", "2"], 2022)
    with pytest.raises(Exception, match="not a population"):
        files.population(spark, body % "...", ["1"], 2022).collect()
    twice = files.one_population(spark.createDataFrame([("1", 2022, 5), ("1", 2022, 6)], "codigo_ibge string, ano int, populacao long"))
    assert twice.select("codigo_ibge").count() == 2
    with pytest.raises(Exception, match="several"):
        twice.collect()


def conversion_line(label, codes, category=1):
    return f"{category:>7}  {label:<51}{codes}"


def test_conversion_tables(spark):
    text = "\n".join(["  2 2", "; said by nobody", conversion_line("low", "01-03,07"), conversion_line("high", "08,0 "), conversion_line("again", "07"), conversion_line("blank", " ,  ")])
    width, lines = files.conversion_table(text)
    assert width == 2 and [x.category for x in lines] == [1, 1, 1, 1]
    assert files.expand_codes(lines, width) == {"01": "low", "02": "low", "03": "low", "07": "again", "08": "high", "0": "high", "": "blank"}
    assert files.range_codes(lines) == {"01", "02", "03"}
    assert files.conversion_ranges(spark, text).count() == 7


def test_conversion_codes_with_a_hyphen_are_kept_as_written():
    _, lines = files.conversion_table("\n".join(["3 5", conversion_line("a", "  -99"), conversion_line("b", " -Z"), conversion_line("c", "0-,1-3")]))
    assert [x.codes for x in lines] == [("  -99",), (" -Z",), ("0-",)] and lines[2].ranges == (("1", "3"),)


def test_conversion_layouts():
    full = "A" * 51
    _, lines = files.conversion_table("1 6 L\n" + f"{9:>7}  {full}114405")
    assert lines[0].label == full and lines[0].codes == ("114405",)
    width, lines = files.conversion_table("N 2 2 L\n" + f"{7:<11}" + "Pediatric".ljust(101) + "07\n" + f"{8:<11}" + "Other".ljust(101) + "08-09")
    assert (width, lines[0].label, files.expand_codes(lines, width)) == (2, "Pediatric", {"07": "Pediatric", "08": "Other", "09": "Other"})
    reserve = "2 6\n" + conversion_line("none", "000000-999999,      ") + "\n" + conversion_line("one", "000001")
    width, lines = files.conversion_table(reserve)
    assert lines[0].codes == ("      ",) and files.expand_codes(lines, width) == {"": "none", "000001": "one"}


@pytest.mark.parametrize(
    ("heading", "body", "message"),
    [
        ("1 3", conversion_line("x", "A00-A09"), "non-numeric range"),
        ("1 2", conversion_line("x", "1-A"), "non-numeric range"),
        ("1 2", conversion_line("x", " 1-2,3"), "non-numeric range"),
        ("1 2", conversion_line("x", "123"), "wider than the declared 2"),
        ("1 2", conversion_line("x", " -999"), "wider than the declared 2"),
        ("1 2", conversion_line("x", "0-99"), "unequal width"),
        ("1 6", conversion_line("x", "000000-999999"), "only code is a reserve range"),
        ("1 2", conversion_line("x", "")[:58] + " 1", "column layout"),
        ("said", conversion_line("x", "1"), "no heading"),
    ],
)
def test_conversion_tables_that_do_not_fit(heading, body, message):
    with pytest.raises(files.ConversionError, match=message):
        files.conversion_table(f"{heading}\n{body}\n")


def test_a_long_code_twice():
    width, lines = files.conversion_table("2 5\n" + conversion_line("a", "12345") + "\n" + conversion_line("b", "12345"))
    with pytest.raises(files.ConversionError, match="twice"):
        files.expand_codes(lines, width)


def test_remarks_and_lines_that_are_refused(spark):
    width, lines = files.conversion_table("1 2 ; remark\n\n" + conversion_line("low", "01;note") + "\n; 9\n")
    assert width == 2 and lines[0].codes == ("01",)
    for row, message in ((conversion_line("x", ""), "no codes"), (conversion_line("x", "1").replace("      1  ", "      1 x", 1), "column layout")):
        with pytest.raises(files.ConversionError, match=message):
            files.conversion_table(f"1 2\n{row}\n")
    _, lines = files.conversion_table("2 2\n" + conversion_line("a", "0") + "\n" + conversion_line("b", "0 "))
    with pytest.raises(files.ConversionError, match="with and without blanks"):
        files.expand_codes(lines, 2)


def test_related_tables(spark):
    related = spark.createDataFrame([("01  ", " one "), ("02", None)], "COD string, DS_TPFIN string")
    assert {tuple(r) for r in files.related_labels(related, "FAEC_TP", "ds_tpfin").collect()} == {("01", "one"), ("02", None)}
    assert files.related_labels(related.withColumnRenamed("COD", "other").withColumn("faec_tp", F.lit("9")).limit(1), "FAEC_TP", "DS_TPFIN").first()[0] == "9"
    with pytest.raises(Exception, match="listed twice"):
        files.related_labels(related.union(related), "COD", "DS_TPFIN").select("code").collect()
    with pytest.raises(files.ConversionError):
        files.related_labels(related, "COD", "NONE")


def test_definition_lookups():
    text = "\n".join([";X*old,OLD,1,OLD.CNV", "LSaida,cobranca,1,CNV\\SAIDA.CNV", "lSub,FAEC_TP,DS_TPFIN,CNV\\TP.CNV", "IValor,VAL"])
    got = files.definition_lookups(text)
    assert [(x["kind"], x["field"], x["start"], x["column"], x["table"]) for x in got] == [("L", "COBRANCA", 1, None, "CNV\\SAIDA.CNV"), ("l", "FAEC_TP", None, "DS_TPFIN", "CNV\\TP.CNV")]
    with pytest.raises(files.ConversionError, match="unknown shape"):
        files.definition_lookups("LTitle,FIELD,1,extra,CNV\\T.CNV")


def test_establishments(spark):
    schema = "CO_CNES string, TP_PFPJ string, NO_RAZAO_SOCIAL string, NO_FANTASIA string"
    df = spark.createDataFrame([("1", "3", "HOSPITAL", None), ("2", "1", "PESSOA", None), ("3", "3", "FULANO 529.982.247-25", None)], schema)
    assert [tuple(r) for r in files.establishment_names(df).collect()] == [("0000001", "HOSPITAL", None)]
    with pytest.raises(Exception, match="two names"):
        files.establishment_names(df.union(spark.createDataFrame([("1", "3", "OUTRO", None)], schema))).collect()
