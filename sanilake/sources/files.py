"""Text sources: fixed width, CSV in archives, JSON, conversion tables and server listings."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanilake.functions.text import contains_cpf, whole_match

# ---------------------------------------------------------------- fixed width


@dataclass(frozen=True)
class FixedField:
    name: str
    size: int
    start: int
    kind: str


def fixed_layout(text: str) -> list[FixedField]:
    """Fields of a layout file: a heading, then name, size, start, end and type."""
    out = []
    for line in text.splitlines()[1:]:
        if line.strip():
            name, size, start, end, kind = (x.strip() for x in line.split(",")[:5])
            if int(end) - int(start) + 1 != int(size):
                raise ValueError(f"{name}: size {size} is not {start} to {end}")
            out.append(FixedField(name.lower(), int(size), int(start), kind.upper()))
    return out


def fixed_width(lines: DataFrame, fields: Sequence[FixedField], value: str = "value") -> DataFrame:
    """Columns of fixed-width lines; a line of another width fails the job.

    NUMBER becomes a long (blank: null), everything else right-trimmed text.
    """
    width = max(f.start + f.size - 1 for f in fields)
    whole = F.when(F.length(value) == width, True).otherwise(F.raise_error(F.lit(f"a line is not {width} characters wide")).cast("boolean"))
    out = []
    for f in fields:
        cell = F.substring(value, f.start, f.size)
        out.append((F.nullif(F.btrim(cell), F.lit("")).cast("long") if f.kind == "NUMBER" else F.rtrim(cell)).alias(f.name))
    return lines.where(whole).select(*out)


def unpack(archive: str, member: str, folder: str) -> str:
    """Streams one member of a ZIP file, named by a pattern, into a folder that executors share."""
    with zipfile.ZipFile(archive) as z:
        found = [n for n in z.namelist() if re.fullmatch(member, n)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} members of {archive} are named {member}")
        return z.extract(found[0], folder)


# ---------------------------------------------------------------- establishments


def establishment_names(csv: DataFrame, code: str = "CO_CNES", kind: str = "TP_PFPJ", name: str = "NO_RAZAO_SOCIAL", alias: str = "NO_FANTASIA") -> DataFrame:
    """(cnes, nome, nome_fantasia) of legal entities whose names hold no person number.

    A code with two different names fails the job.
    """
    rows = csv.where(F.btrim(F.col(kind)) == "3").select(F.lpad(F.btrim(F.col(code)), 7, "0").alias("cnes"), F.nullif(F.btrim(F.col(name)), F.lit("")).alias("nome"), F.nullif(F.btrim(F.col(alias)), F.lit("")).alias("nome_fantasia"))
    rows = rows.where(~contains_cpf("nome") & ~contains_cpf("nome_fantasia"))
    per = rows.distinct().groupBy("cnes").agg(F.count("*").alias("n"), F.min(F.struct("nome", "nome_fantasia")).alias("x"))
    ok = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("two names for "), F.col("cnes"))).cast("boolean"))
    return per.where(ok).select("cnes", "x.nome", "x.nome_fantasia")


def read_establishments(spark: SparkSession, path: str) -> DataFrame:
    """The semicolon-separated file of a register, in latin-1."""
    return spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True)


def without_person_names(master: DataFrame, legal: DataFrame) -> DataFrame:
    """Register rows that may keep a name: codes that are legal entities in every file, and no person number.

    legal: cnes, pf_pj.
    """
    entities = legal.groupBy("cnes").agg(F.bool_and(F.coalesce("pf_pj", F.lit("")) == "3").alias("ok")).where("ok").select("cnes")
    return master.join(entities, "cnes", "left_semi").where(~contains_cpf("nome") & ~contains_cpf("nome_fantasia"))


# ---------------------------------------------------------------- population aggregates


def population(spark: SparkSession, payload: str | bytes, places: Iterable[str], year: int, unit: str = "Pessoas") -> DataFrame:
    """(codigo_ibge, ano, populacao) of an aggregate's JSON, fully checked.

    One variable in the expected unit, exactly the given places, digits only.
    """
    said = json.loads(payload)
    if len(said) != 1 or said[0].get("unidade") != unit:
        raise ValueError(f"one variable in {unit} is due")
    series = [s for r in said[0]["resultados"] for s in r["series"]]
    ids = [s["localidade"]["id"] for s in series]
    if sorted(ids) != sorted(set(places)):
        raise ValueError("the places are not those of the year")
    rows = spark.createDataFrame([(s["localidade"]["id"], year, s["serie"].get(str(year))) for s in series], "codigo_ibge string, ano int, said string")
    good = whole_match(F.coalesce("said", F.lit("")), "[0-9]{1,18}")
    ok = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not a population: "), F.coalesce("said", F.lit("null")))).cast("boolean"))
    return rows.where(ok).select("codigo_ibge", "ano", F.col("said").cast("long").alias("populacao"))


def one_population(rows: DataFrame) -> DataFrame:
    """populacao fails to be read where a place and year have several publications; other columns can be read."""
    from pyspark.sql import Window

    several = F.count("*").over(Window.partitionBy("codigo_ibge", "ano")) > 1
    return rows.withColumn("populacao", F.when(several, F.raise_error(F.lit("several populations for a place and year")).cast("long")).otherwise(F.col("populacao")))


def stock_page(spark: SparkSession, records: Sequence[Mapping], limit: int = 1000) -> DataFrame:
    """One page of a stock service as text columns; complete is false, as there may be more."""
    if len(records) > limit:
        raise ValueError(f"more than {limit} rows on a page")
    names = sorted({k for r in records for k in r})
    schema = ", ".join(f"`{n}` string" for n in names) or "empty string"
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records], schema).withColumn("complete", F.lit(False))


# ---------------------------------------------------------------- conversion tables


class ConversionError(ValueError):
    """A conversion table or definition file that doesn't fit its layout."""


@dataclass(frozen=True)
class Layout:
    """Where a line has its category, its label and its codes: places from 0, an end that is left out."""

    category: slice
    label: slice
    codes: int


#: The common layout, and that of tables whose heading begins with N.
COMMON, WIDE = Layout(slice(3, 7), slice(9, 59), 60), Layout(slice(0, 9), slice(11, 111), 112)
SHORT_CODE = 4  # characters up to which a later line takes a code over


@dataclass(frozen=True)
class Conversion:
    """A line: its codes as they are written, blanks included, and its ranges of numbers."""

    category: int
    label: str
    codes: tuple[str, ...]
    ranges: tuple[tuple[str, str], ...] = ()


def conversion_table(text: str) -> tuple[int, list[Conversion]]:
    """(width of codes, lines) of a tabulation table.

    A code with a hyphen between two characters that aren't blank is a range, of numbers only; with a blank or
    nothing on one side it is a code as written.  A range of all long codes (000000-999999) stands for
    whatever has no line and is left out.  What follows a semicolon is a remark; lines of remarks or blanks don't count.
    """
    said = (x.partition(";")[0].rstrip() if ";" in x else x for x in text.splitlines())
    rows = [x for x in said if x.strip()]
    heading = re.fullmatch(r"\s*(N\s+)?(\d+)\s+(\d+)(?:\s+\S+)*\s*", rows[0]) if rows else None
    if heading is None:
        raise ConversionError("no heading with the numbers of categories and of characters")
    layout, width = WIDE if heading[1] else COMMON, int(heading[3])
    return width, [_conversion(row, n, layout, width) for n, row in enumerate(rows[1:], 2)]


def _conversion(row: str, line: int, layout: Layout, width: int) -> Conversion:
    """One line.  A single character may stand before the codes and then belongs to the label."""

    def refuse(why: str) -> ConversionError:
        return ConversionError(f"line {line} {why}")

    head, before_label = row[: layout.category.stop].strip(), row[layout.category.stop : layout.label.start]
    between, listed = row[layout.label.stop : layout.codes], row[layout.codes :]
    if not (head.isdecimal() and not before_label.strip()) or (between.strip() and not listed.strip()):
        raise refuse("does not fit the column layout")
    codes, ranges, reserves = [], [], 0
    for said in listed.removesuffix(",").split(",") if listed else []:
        if max(len(side) for side in said.split("-")) > width:
            raise refuse(f"has {said!r}, wider than the declared {width}")
        if not re.search(r"\S-\S", said):  # blanks stand for one code, however many are written
            codes.append(said if said.strip() else " " * width)
            continue
        numbers = re.fullmatch(r"([0-9]+)-([0-9]+)", said)
        if numbers is None:
            raise refuse(f"has a non-numeric range {said!r}")
        first, last = numbers.groups()
        if len(first) != len(last):
            raise refuse(f"has a range of unequal width, {said!r}")
        if width > SHORT_CODE and not first.strip("0") and not last.strip("9") and len(first) == width:
            reserves += 1
        else:
            ranges.append((first, last))
    if not codes and not ranges:
        raise refuse("says that its only code is a reserve range" if reserves else "has no codes")
    return Conversion(int(head), (row[layout.label] + between).strip(), tuple(codes), tuple(ranges))


def expand_codes(lines: Sequence[Conversion], width: int) -> dict[str, str]:
    """Code, without blanks at its end, -> label.

    Of a short code the last line wins, a long one may not repeat.  Two codes that differ by blanks at
    their ends only are refused.
    """
    written: dict[str, str] = {}
    for line in lines:
        for code in [*line.codes, *(str(n).zfill(len(a)) for a, b in line.ranges for n in range(int(a), int(b) + 1))]:
            if code in written and width > SHORT_CODE:
                raise ConversionError(f"long code {code!r} twice")
            written[code] = line.label
    out: dict[str, str] = {}
    for code, label in written.items():
        if code.rstrip() in out:
            raise ConversionError(f"code {code.rstrip()!r} is written with and without blanks")
        out[code.rstrip()] = label
    return out


def related_labels(related: DataFrame, field: str, column: str) -> DataFrame:
    """(code, label) of a table that a definition file relates to a field.

    The key is the column named like the field, or the first one; names are
    compared without case.  A code listed twice stops the query, whatever is read of it.
    """
    by_name = {c.strip().upper(): c for c in related.columns}
    if column.upper() not in by_name:
        raise ConversionError(f"the related table has no column {column!r}")
    key = by_name.get(field.upper(), related.columns[0])
    rows = related.select(F.rtrim(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("code"), F.btrim(F.col(f"`{by_name[column.upper()]}`").cast("string")).alias("label"))
    per = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    once = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"{key} is listed twice: "), F.col("code"))).cast("boolean"))
    return per.where(once).select("code", "label")


def range_codes(lines: Sequence[Conversion]) -> set[str]:
    """Codes that only a range names."""
    listed = {c.rstrip() for line in lines for c in line.codes}
    return {str(n).zfill(len(a)) for line in lines for a, b in line.ranges for n in range(int(a), int(b) + 1)} - listed


def conversion_ranges(spark: SparkSession, text: str) -> DataFrame:
    """The same table as (first, last, label, line), for a range join; of several lines the last one holds."""
    _, lines = conversion_table(text)
    rows = [(a, b, x.label, n) for n, x in enumerate(lines) for a, b in [*((c.rstrip(), c.rstrip()) for c in x.codes), *x.ranges]]
    return spark.createDataFrame(rows, "first string, last string, label string, line int")


def definition_lookups(text: str) -> list[dict[str, str | int | None]]:
    """Entries of a definition file that name a table: kind, title, field, start of the code (null if unknown), table.

    A line that names a conversion table in another shape is an error.
    """
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        kind, rest = line[:1], [x.strip() for x in line[1:].split(",")]
        if not kind.strip() or kind == ";" or not re.search(r"\.(cnv|dbf)\s*$", line, re.I):
            continue
        if kind.upper() not in "LCSDXTI" or len(rest) != 4:
            raise ConversionError(f"line {n} names a table in an unknown shape")
        title, name, place, table = rest
        out.append({"kind": kind, "title": title, "field": name.upper(), "start": int(place) if place.isdecimal() else None, "column": None if place.isdecimal() else place, "table": table})
    return out


# ---------------------------------------------------------------- listings and file names

#: `01-31-20  02:48PM                76107 DOAC1996.dbc`
LISTING = r"^(\d{2}-\d{2}-\d{2})\s+(\d{2}:\d{2}[AP]M)\s+(<DIR>|\d+)\s+(.+?)\s*$"


def listing(lines: DataFrame, value: str = "value") -> DataFrame:
    """(name, is_dir, bytes, modified_at, parsed) of MS-DOS listing lines; other lines have parsed false."""
    part = lambda k: F.regexp_extract(value, LISTING, k)
    good = F.col(value).rlike(LISTING)
    when = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("MM-dd-yy hh:mma"))
    return lines.select(F.when(good, part(4)).alias("name"), F.when(good, part(3) == "<DIR>").alias("is_dir"), F.when(good & (part(3) != "<DIR>"), part(3)).cast("long").alias("bytes"), F.when(good, when.cast("timestamp_ntz")).alias("modified_at"), good.alias("parsed"))


#: The codes of the 27 federal units.
UFS = ("AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO")


def file_scope(name: Column, prefix: str, monthly: bool, national: str | None = None, year_digits: int = 4, first_year: int = 1979) -> Column:
    """struct(uf, ano, mes, part) of a file name, null if it isn't one of the dataset's.

    Two-digit years belong to the first century that doesn't come before first_year.
    A part is `_1` or a letter before the extension.
    """
    where = re.escape(national) if national is not None else "(?:" + "|".join(UFS) + ")"
    period = r"(\d{2})(\d{2})" if monthly else r"(\d{" + str(2 if national is not None else year_digits) + r"})()"
    shape = rf"(?i)\A{re.escape(prefix)}({where}){period}(?:_(\d+)|([a-z]))?\.db[cf]\z"
    year = F.regexp_extract(name, shape, 2).try_cast("int")
    if monthly or national is not None or year_digits == 2:
        year = F.when(year + 1900 >= first_year, year + 1900).otherwise(year + 2000)
    month = F.regexp_extract(name, shape, 3).try_cast("int")
    part = F.nullif(F.concat(F.regexp_extract(name, shape, 4), F.lower(F.regexp_extract(name, shape, 5))), F.lit(""))
    uf = F.upper(F.regexp_extract(name, shape, 1)) if national is None else F.lit(None).cast("string")
    good = name.rlike(shape) & (F.lit(not monthly) | F.coalesce(month.between(1, 12), F.lit(False)))
    return F.when(good, F.struct(uf.alias("uf"), year.alias("ano"), (month if monthly else F.lit(None).cast("int")).alias("mes"), part.alias("part")))


def sources_by_scope(files: DataFrame) -> DataFrame:
    """One row for each scope with its files in order; a split file's parts take the place of the whole.

    files: uf, ano, mes, part, release, path, bytes, modified_at.  A scope in two releases fails the job.
    """
    by = ["uf", "ano", "mes"]
    entry = F.struct(F.coalesce(F.col("part").try_cast("int"), F.ascii("part"), F.lit(0)).alias("order"), "part", "path", "bytes", "modified_at")
    found = files.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("files"), F.min("release").alias("release"), F.max("release").alias("_other"))
    ok = F.when(F.col("release").eqNullSafe(F.col("_other")), True).otherwise(F.raise_error(F.lit("a scope is in two releases")).cast("boolean"))
    split = F.filter("files", lambda f: f["part"].isNotNull())
    return found.where(ok).select(*by, "release", F.when(F.size(split) > 0, split).otherwise(F.col("files")).alias("files"))


def planned_scopes(spark: SparkSession, years: Sequence[int], ufs: Sequence[str | None], months: Sequence[int | None]) -> DataFrame:
    """Every combination of the given years, units and months."""
    one = lambda values, kind: spark.createDataFrame([(v,) for v in values], kind)
    return one(years, "ano int").crossJoin(one(ufs, "uf string")).crossJoin(one(months, "mes int"))


def base_name(path: str) -> str:
    return PurePosixPath(path).name
