"""A Spark data source for DBF files and their compressed form, DBC.

    spark.dataSource.register(DbcDataSource)
    spark.read.format("dbc").option("encoding", "latin-1").load("/data/*.dbc")

One file is one partition.  Files are read through pyarrow's file systems, so
the path can be in any store that all executors reach.  A file is read, inflated
and turned into Arrow batches a piece at a time, so a task's memory doesn't grow
with it.  Several files are read as one once their headers have settled a schema.
"""

from __future__ import annotations

import datetime
import functools
import io
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from sanilake.sources.schema import with_library_columns

BATCH_ROWS = 100_000
ENCODINGS = ("latin-1", "cp1252", "ascii", "utf-8")


class DbcError(ValueError):
    """A DBC file is damaged."""


class DbfIntegrityError(ValueError):
    """A DBF file doesn't hold what its header declares."""


# Fixed values of the DCL implode format: code lengths as (repeat - 1) * 16 + length, then the
# base values and extra bits of match lengths.
LITERAL_LENGTHS = bytes([11, 124, 8, 7, 28, 7, 188, 13, 76, 4, 10, 8, 12, 10, 12, 10, 8, 23, 8, 9, 7, 6, 7, 8, 7, 6, 55, 8, 23, 24, 12, 11, 7, 9, 11, 12, 6, 7, 22, 5, 7, 24, 6, 11, 9, 6, 7, 22, 7, 11, 38, 7, 9, 8, 25, 11, 8, 11, 9, 12, 8, 12, 5, 38, 5, 38, 5, 11, 7, 5, 6, 21, 6, 10, 53, 8, 7, 24, 10, 27, 44, 253, 253, 253, 252, 252, 252, 13, 12, 45, 12, 45, 12, 61, 12, 45, 44, 173])
MATCH_LENGTHS = bytes([2, 35, 36, 53, 38, 23])
DISTANCE_LENGTHS = bytes([2, 20, 53, 230, 247, 151, 248])
MATCH_BASE = (3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264)
MATCH_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)
END_LENGTH = 519
CODE_BITS = 13

WINDOW = 4096  # how far copies of the format reach back
IN_BYTES, OUT_BYTES = 1 << 16, 1 << 17  # read, and inflated, at a time
BATCH_BYTES = 8 << 20  # of records in a batch


def code_table(packed: bytes) -> list[tuple[int, int]]:
    """(symbol, bits) by the next 13 bits of the stream: canonical codes, stored inverted, first bit lowest."""
    lengths = [b & 15 for b in packed for _ in range((b >> 4) + 1)]
    table: list[tuple[int, int]] = [(-1, 0)] * (1 << CODE_BITS)
    code = 0
    for bits in range(1, CODE_BITS + 1):
        for symbol in (s for s, n in enumerate(lengths) if n == bits):
            first = sum((((code >> (bits - 1 - k)) & 1) ^ 1) << k for k in range(bits))
            for rest in range(1 << (CODE_BITS - bits)):
                table[first | rest << bits] = (symbol, bits)
            code += 1
        code <<= 1
    return table


@functools.lru_cache(maxsize=1)
def code_tables() -> tuple[list, list, list]:
    return code_table(LITERAL_LENGTHS), code_table(MATCH_LENGTHS), code_table(DISTANCE_LENGTHS)


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Inflates a DCL imploded stream that comes in chunks.

    Copies reach back WINDOW bytes at most, so no more than that and OUT_BYTES
    of output are held, however long the stream is.
    """
    source = iter(chunks)
    data = b""
    while len(data) < 2:
        more = next(source, b"")
        if not more:
            raise DbcError("the compressed part is cut off")
        data += more
    coded, dictionary = data[0], data[1]
    if coded > 1 or dictionary not in (4, 5, 6):
        raise DbcError(f"not an imploded stream: {coded}, {dictionary}")
    literals, matches, distances = code_tables()
    out, at, end = bytearray(), 2, len(data)
    held = bits = kept = 0  # kept: bytes at the front that were handed on and stay for copies
    while True:
        if bits < 48:
            if len(out) > OUT_BYTES:
                yield bytes(out[kept:])
                del out[:-WINDOW]
                kept = len(out)
            while end - at < 8 and (more := next(source, b"")):
                data, at = data[at:] + more, 0
                end = len(data)
            took = min(8, end - at)
            held |= int.from_bytes(data[at : at + took], "little") << bits
            at, bits = at + took, bits + 8 * took
        if bits < 9:
            raise DbcError("the compressed part is cut off")
        if held & 1:
            symbol, n = matches[held >> 1 & 0x1FFF]
            extra = MATCH_EXTRA[symbol]
            size = MATCH_BASE[symbol] + (held >> (1 + n) & ((1 << extra) - 1))
            n += 1 + extra
            held, bits = held >> n, bits - n
            if size == END_LENGTH:
                if bits < 0:
                    raise DbcError("the compressed part is cut off")
                yield bytes(out[kept:])
                return
            low = 2 if size == 2 else dictionary
            symbol, n = distances[held & 0x1FFF]
            distance = (symbol << low) + (held >> n & ((1 << low) - 1)) + 1
            held, bits = held >> (n + low), bits - n - low
            if symbol < 0 or bits < 0 or distance > len(out):
                raise DbcError("a copy reaches before the start")
            start = len(out) - distance
            if distance >= size:
                out += out[start : start + size]
            else:
                out += (out[start:] * (size // distance + 1))[:size]
        elif coded:
            symbol, n = literals[held >> 1 & 0x1FFF]
            if symbol < 0 or bits < n + 1:
                raise DbcError("the compressed part is damaged")
            out.append(symbol)
            held, bits = held >> (n + 1), bits - n - 1
        else:
            out.append(held >> 1 & 0xFF)
            held, bits = held >> 9, bits - 9


def explode(data: bytes) -> bytes:
    """Inflates a DCL imploded stream that is held whole."""
    return b"".join(inflate([data]))


def decompress(raw: bytes) -> bytes:
    """The DBF of a DBC that is held whole: its header, four bytes that count for nothing, and an imploded body."""
    return b"".join(unpacked(io.BytesIO(raw)))


def unpacked(file: BinaryIO) -> Iterator[bytes]:
    """The bytes of the DBF in a DBC file, as they are inflated."""
    start = file.read(33)
    if len(start) < 33:
        raise DbcError("too short for a header")
    size = int.from_bytes(start[8:10], "little")
    header = start + file.read(max(size - 33, 0))
    if size < 33 or len(header) < size or len(file.read(4)) < 4:
        raise DbcError("cut off in the header")
    yield header
    yield from inflate(iter(lambda: file.read(IN_BYTES), b""))


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    offset: int
    size: int
    decimals: int


@dataclass(frozen=True)
class Layout:
    records: int
    header: int
    record: int
    fields: tuple[Field, ...]


def layout(dbf: bytes) -> Layout:
    """Geometry and fields of a DBF header; a missing terminator byte is not asked for."""
    records, header, record = int.from_bytes(dbf[4:8], "little"), int.from_bytes(dbf[8:10], "little"), int.from_bytes(dbf[10:12], "little")
    if not record or header < 33:
        raise DbfIntegrityError("no record length")
    fields, offset = [], 1
    for at in range(32, header - 1, 32):
        entry = dbf[at : at + 32]
        if len(entry) < 32 or entry[0] == 0x0D:
            break
        name = entry[:11].split(b"\0")[0].decode("latin-1").strip()
        fields.append(Field(name, chr(entry[11]), offset, entry[16], entry[17]))
        offset += entry[16]
    if offset > record:
        raise DbfIntegrityError("fields are longer than a record")
    return Layout(records, header, record, tuple(fields))


def spark_type(field: Field) -> T.DataType:
    if field.kind == "N":
        return T.DoubleType() if field.decimals else T.LongType()
    types = {"D": T.DateType(), "L": T.BooleanType(), "F": T.DoubleType(), "O": T.DoubleType(), "I": T.LongType(), "+": T.LongType(), "T": T.TimestampNTZType(), "@": T.TimestampNTZType()}
    return types.get(field.kind, T.StringType())


def struct(found: Layout) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f), True) for f in found.fields])


def number(raw: bytes, whole: bool) -> int | float | None:
    """A number as text: blanks, NULs and stars are none; a comma is a point."""
    text = raw.replace(b"\0", b" ").decode("ascii", "replace").strip().strip("*").replace(",", ".")
    if not text:
        return None
    value = float(text)
    if not whole:
        return value
    exact = int(text) if re.fullmatch(r"[+-]?\d+", text) else int(value) if value == int(value) else None
    if exact is None or not -(1 << 63) <= exact < 1 << 63:
        raise DbfIntegrityError(f"not a 64-bit integer: {text!r}")
    return exact


PLAIN = np.zeros(256, bool)
PLAIN[list(b"0123456789+-., \0")] = True


def plain_dates(cells: np.ndarray, empty: np.ndarray) -> np.ndarray | None:
    """Days of eight digits, year first; None if one is no such date."""
    text = np.where(empty[:, None], np.frombuffer(b"19700101", np.uint8), cells)
    if not ((text >= 0x30) & (text <= 0x39)).all() or (text[:, :4] == 0x30).all(axis=1).any():
        return None
    dashed = np.full((len(text), 10), ord("-"), np.uint8)
    dashed[:, [0, 1, 2, 3, 5, 6, 8, 9]] = text
    try:
        return dashed.view("S10").ravel().astype("datetime64[D]")
    except ValueError:
        return None


def column(cells: np.ndarray, field: Field, encoding: str) -> pa.Array:
    """A field of all records as an Arrow array; plain values are converted at once, the rest one by one."""
    raw = np.ascontiguousarray(cells).view(f"S{field.size}").ravel() if field.size else np.zeros(len(cells), "S1")
    kind = spark_type(field)
    if isinstance(kind, T.StringType):
        text = np.char.rstrip(raw, b" \0")
        if encoding in ("ascii", "utf-8") or not (cells & 0x80).any():
            return pa.array(text.tolist(), pa.binary()).cast(pa.string())
        return pa.array([x.decode(encoding) for x in text.tolist()], pa.string())
    if isinstance(kind, (T.LongType, T.DoubleType)) and field.kind in "NFO":
        whole = isinstance(kind, T.LongType)
        text = np.char.strip(np.char.replace(raw, b"\0", b" "))
        empty = text == b""
        if field.size < 19 and PLAIN[cells].all():  # signs, digits and points only
            try:
                values = np.where(empty, b"0", text if whole else np.char.replace(text, b",", b".")).astype(np.int64 if whole else np.float64)
                return pa.array(values, mask=empty)
            except ValueError:  # such as a whole number with decimals
                pass
        return pa.array([number(x, whole) for x in raw.tolist()], pa.int64() if whole else pa.float64())
    if isinstance(kind, T.DateType):
        empty = np.char.strip(raw, b" 0\0") == b""
        if field.size == 8 and (found := plain_dates(cells, empty)) is not None:
            return pa.array(found, pa.date32(), mask=empty)
        try:
            return pa.array([None if not x.strip(b" 0\0") else datetime.datetime.strptime(x.decode("ascii"), "%Y%m%d").date() for x in raw.tolist()], pa.date32())
        except ValueError as e:
            raise DbfIntegrityError(f"a date of {field.name} is none: {e}") from e
    if isinstance(kind, T.BooleanType):
        return pa.array([True if x in b"TtYy" and x else False if x in b"FfNn" and x else None for x in raw.tolist()], pa.bool_())
    if field.kind in "I+":
        return pa.array(np.frombuffer(cells.tobytes(), "<i4").astype(np.int64))
    days = np.frombuffer(cells.tobytes(), "<u4").reshape(-1, 2).astype(np.int64)  # Julian day, milliseconds
    micros = (days[:, 0] - 2_440_588) * 86_400_000_000 + days[:, 1] * 1000
    return pa.array(micros, pa.timestamp("us"), mask=days[:, 0] == 0)


def record_batches(chunks: Iterable[bytes], encoding: str, rows: int = BATCH_ROWS) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(numbers from 0, records) of what isn't deleted in a DBF that comes in chunks.

    Fails unless all declared records are there and the stream ends well; what
    follows the last record isn't looked at.  A batch has BATCH_BYTES of records at most.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    source, held = iter(chunks), bytearray()

    def have(size: int) -> bool:
        while len(held) < size:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    if not have(32) or not have(int.from_bytes(held[8:10], "little")):
        raise DbfIntegrityError("cut off in the header")
    found = layout(bytes(held[: int.from_bytes(held[8:10], "little")]))
    del held[: found.header]
    names = [f.name for f in found.fields]
    rows = max(1, min(rows, BATCH_BYTES // found.record))
    for at in range(0, found.records, rows):
        n = min(rows, found.records - at)
        if not have(n * found.record):
            raise DbfIntegrityError(f"{found.records} records are declared, the file is too short")
        part = np.frombuffer(bytes(held[: n * found.record]), np.uint8).reshape(n, found.record)
        del held[: n * found.record]
        if not np.isin(part[:, 0], (0x20, 0x2A)).all():
            raise DbfIntegrityError("a record has no deletion mark")
        numbers = np.flatnonzero(part[:, 0] == 0x20)
        part = part[numbers]
        columns = [column(part[:, f.offset : f.offset + f.size], f, encoding) for f in found.fields]
        yield at + numbers, pa.RecordBatch.from_arrays(columns, names=names)
    for _ in source:  # to the end, which a damaged stream doesn't have
        pass


def batches(dbf: bytes, encoding: str, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The records of a DBF that is held whole."""
    for _, batch in record_batches([dbf], encoding, rows):
        yield batch


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def opened(uri: str) -> BinaryIO:
    store, path = store_of(uri)
    return store.open_input_stream(path)


def created(uri: str) -> BinaryIO:
    store, path = store_of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def chunks_of(uri: str) -> Iterator[bytes]:
    """The bytes of the DBF in a file, packed or not."""
    with opened(uri) as file:
        yield from unpacked(file) if uri.lower().endswith(".dbc") else iter(lambda: file.read(IN_BYTES), b"")


def read_header(uri: str) -> bytes:
    """The header of a DBF or DBC file, which neither packs."""
    with opened(uri) as file:
        start = file.read(32)
        return start + file.read(max(int.from_bytes(start[8:10], "little") - len(start), 0))


def files(uri: str) -> list[str]:
    """Files of a path: itself, a folder's DBF and DBC files, or those that a pattern names."""
    out = []
    for one in uri.split(","):
        store, path = store_of(one)
        scheme = one[: len(one) - len(path)] if one.endswith(path) else ""
        if "*" in path:
            base = path[: path.index("*")].rsplit("/", 1)[0]
            shape = re.compile(re.escape(path).replace(r"\*", "[^/]*") + r"\Z")
            out += [scheme + x.path for x in store.get_file_info(fs.FileSelector(base)) if shape.match(x.path)]
        elif store.get_file_info(path).type == fs.FileType.Directory:
            out += [scheme + x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.lower().endswith((".dbc", ".dbf"))]
        else:
            out.append(one)
    return sorted(out, key=in_part_order)


def in_part_order(uri: str) -> list[tuple[bool, int, str]]:
    """Names with their digits as numbers: part 2 before part 10."""
    return [(x.isdigit(), int(x) if x.isdigit() else 0, x) for x in re.findall(r"\d+|\D+", uri)]


# ---------------------------------------------------------------- several files, one schema


class LayoutError(DbfIntegrityError):
    """Files that are to be read as one don't fit together."""


#: What fields of two types are read as; a whole number becomes the text of the number.
COMMON = {frozenset(("bigint", "string")): T.StringType(), frozenset(("bigint", "double")): T.DoubleType()}
DECLARED = {"string": T.StringType(), "date": T.StringType(), "number": T.DoubleType()}
POSITION = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_record", T.LongType())])


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    return a if a == b else COMMON.get(frozenset((a.simpleString(), b.simpleString())))


def own_fields(header: bytes, uri: str) -> dict[str, T.DataType]:
    """Types by column name, trimmed and in lower case."""
    found: dict[str, T.DataType] = {}
    for f in layout(header).fields:
        name = f.name.strip().lower()
        if name in found:
            raise LayoutError(f"{uri}: two columns are named {name!r}")
        found[name] = spark_type(f)
    return found


def settle(headers: Iterable[tuple[str, dict[str, T.DataType]]], drift: str = "refuse", declared: Mapping[str, str] | None = None) -> T.StructType:
    """The schema of files read as one, from (file, its columns) in order.

    drift `refuse`: all files have the same columns and types.  `widen`: columns
    are those of any file, in order of appearance, null where a file has none; a
    whole number joins text as its digits and decimals as a number.  Whatever
    else differs is refused, by file and column.  Whole numbers that are declared
    string or date become text, those declared number become doubles.
    """
    if drift not in ("refuse", "widen"):
        raise ValueError(f"drift is refuse or widen, not {drift!r}")
    kinds: dict[str, T.DataType] = {}
    first: dict[str, str] = {}
    start: tuple[str, dict] | None = None
    for uri, own in headers:
        start = start or (uri, own)
        if drift == "refuse" and list(own.items()) != list(start[1].items()):
            odd = next((c for c in [*own, *start[1]] if own.get(c) != start[1].get(c)), "the order of columns")
            raise LayoutError(f"{uri} has another layout than {start[0]}: {odd}")
        for name, kind in own.items():
            both = common_type(kinds.get(name, kind), kind)
            if both is None:
                raise LayoutError(f"{uri}: column {name!r} is {kind.simpleString()}, in {first[name]} it is {kinds[name].simpleString()}")
            kinds[name] = both
            first.setdefault(name, uri)
    for name, kind in kinds.items():
        if kind == T.LongType():
            kinds[name] = DECLARED.get((declared or {}).get(name, ""), kind)
    return T.StructType([T.StructField(n, k, True) for n, k in kinds.items()])


def fitted(batch: pa.RecordBatch, uri: str, schema: T.StructType) -> list[pa.Array]:
    """The columns of a batch as the schema wants them."""
    own = {n.strip().lower(): batch.column(k) for k, n in enumerate(batch.schema.names)}
    if extra := [n for n in own if n not in {f.name.lower() for f in schema}]:
        raise LayoutError(f"{uri}: column {extra[0]!r} isn't in the schema")
    out = []
    for f in schema:
        kind = to_arrow_type(f.dataType)
        have = own.get(f.name.lower())
        if have is None:
            out.append(pa.nulls(batch.num_rows, kind))
        elif have.type == kind:
            out.append(have)
        elif pa.types.is_int64(have.type) and (pa.types.is_string(kind) or pa.types.is_float64(kind)):
            out.append(have.cast(kind, safe=True))
        else:
            raise LayoutError(f"{uri}: column {f.name!r} is {have.type}, the schema has {f.dataType.simpleString()}")
    return out


def survey(spark: SparkSession, uri: str, tasks: int = 200) -> DataFrame:
    """(part, file, place, name, kind, size, decimals, records) of every field of every header, read in parallel.

    A file that can't be read has one row with an error instead.
    """
    found = files(uri)
    schema = "part int, file string, place int, name string, kind string, size int, decimals int, records long, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, one in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
                try:
                    had = layout(read_header(one))
                    rows += [(part, one, k, f.name.strip().lower(), f.kind, f.size, f.decimals, had.records, None) for k, f in enumerate(had.fields)]
                except (OSError, ValueError) as e:
                    rows.append((part, one, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(to_arrow_schema(kinds).names, r, strict=True)) for r in rows], schema=to_arrow_schema(kinds))

    kinds = T._parse_datatype_string(schema)
    listed = spark.createDataFrame(list(enumerate(found)), "part int, file string").repartition(max(1, min(tasks, len(found))))
    return listed.mapInArrow(run, schema)


def settled_schema(spark: SparkSession, uri: str, drift: str = "refuse", declared: Mapping[str, str] | None = None) -> T.StructType:
    """settle() over a survey: Spark reads the headers and gathers them by what they declare.

    What comes to the driver is one row for each different header, however many files have it.
    """
    fields = survey(spark, uri)
    own = F.array_sort(F.collect_list(F.struct("place", "name", "kind", "decimals")))
    each = fields.groupBy("part", "file").agg(own.alias("fields"), F.max("error").alias("error"))
    kinds = each.groupBy("fields", "error").agg(F.min(F.struct("part", "file")).alias("first")).orderBy("first.part").collect()
    headers = []
    for r in kinds:
        if r["error"]:
            raise LayoutError(f"{r['first']['file']}: {r['error']}")
        found: dict[str, T.DataType] = {}
        for f in r["fields"]:
            if f["name"] in found:
                raise LayoutError(f"{r['first']['file']}: two columns are named {f['name']!r}")
            found[f["name"]] = spark_type(Field(f["name"], f["kind"], 0, 0, f["decimals"]))
        headers.append((r["first"]["file"], found))
    if not headers:
        raise FileNotFoundError(uri)
    return settle(headers, drift, declared)


def read_parts(spark: SparkSession, uri: str, drift: str = "refuse", declared: Mapping[str, str] | None = None, encoding: str = "latin-1", position: bool = False) -> DataFrame:
    """All files of a path as one table, whose schema is settled from every header first.

    position: adds _file and _record, by which rows can be put in the order of
    the parts.  Columns are in lower case.
    """
    spark.dataSource.register(DbcDataSource)
    schema = settled_schema(spark, uri, drift, declared)
    if position:
        schema = T.StructType([*schema, *POSITION])
    return spark.read.format("dbc").schema(schema).option("encoding", encoding).option("position", str(position).lower()).load(uri)


@dataclass(frozen=True)
class Staged:
    rows: int
    bytes: int
    files: int


def stage(spark: SparkSession, uri: str, path: str, scope: Mapping[str, Any], release: str, declared: Mapping[str, str] | None = None, drift: str = "refuse", encoding: str = "latin-1") -> Staged:
    """The parts of one scope as one Parquet folder with the library's columns.

    It is written beside the path and takes its place at the end, so a part that
    is damaged or doesn't fit leaves what was there.  Rows are those of all
    headers less the deleted ones; every part is checked against its own header.
    """
    rows = with_library_columns(read_parts(spark, uri, drift, declared, encoding), dict(scope), release)
    seen = Observation()
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh_path = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    store = target.getFileSystem(conf)
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(new)
        size = store.getContentSummary(fresh_path).getLength()
        if store.exists(target) and not store.delete(target, True):
            raise OSError(f"{path} can't be replaced")
        if not store.rename(fresh_path, target):
            raise OSError(f"{path} can't be written")
    finally:
        store.delete(fresh_path, True)
    return Staged(seen.get["n"], size, len(files(uri)))


# ---------------------------------------------------------------- writing


def written_field(field: T.StructField, width: int) -> Field:
    """How a column is written: text in `width` bytes, whole numbers in 18 digits, doubles with 4 decimals, decimals as they are."""
    kind = field.dataType
    if isinstance(kind, T.IntegralType):
        return Field(field.name, "N", 0, 18, 0)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return Field(field.name, "N", 0, 19, 4)
    if isinstance(kind, T.DecimalType):
        return Field(field.name, "N", 0, kind.precision + 2, kind.scale)
    plain = {T.DateType: ("D", 8), T.BooleanType: ("L", 1), T.StringType: ("C", width)}
    if type(kind) not in plain:
        raise TypeError(f"column {field.name!r}: a DBF has no {kind.simpleString()}")
    return Field(field.name, plain[type(kind)][0], 0, plain[type(kind)][1], 0)


def cells(column: pa.Array, field: Field, encoding: str) -> np.ndarray:
    """A column as fixed-width bytes; what doesn't fit is refused, null is blank."""
    values = column.to_pylist()
    if field.kind == "C":
        said = ["" if v is None else v for v in values]
    elif field.kind == "D":
        said = ["" if v is None else f"{v:%Y%m%d}" for v in values]
    elif field.kind == "L":
        said = ["?" if v is None else "T" if v else "F" for v in values]
    else:
        said = ["" if v is None else f"{v:.{field.decimals}f}" if field.decimals else str(v) for v in values]
    raw = [x.encode(encoding) for x in said]
    if wide := next((x for x in raw if len(x) > field.size), None):
        raise DbfIntegrityError(f"column {field.name!r}: {wide[:40]!r} is longer than {field.size} bytes")
    raw = [x.rjust(field.size) if field.kind == "N" else x.ljust(field.size) for x in raw]
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), field.size)


def dbf_header(fields: Iterable[Field], records: int) -> bytes:
    fields = list(fields)
    sizes = (records, 33 + 32 * len(fields), 1 + sum(f.size for f in fields))
    out = bytes([3, 0, 1, 1]) + sizes[0].to_bytes(4, "little") + sizes[1].to_bytes(2, "little") + sizes[2].to_bytes(2, "little") + bytes(20)
    for f in fields:
        name = f.name.encode("latin-1")
        if len(name) > 10:
            raise DbfIntegrityError(f"column name {f.name!r} is longer than 10 bytes")
        out += name.ljust(11, b"\0") + f.kind.encode() + bytes(4) + bytes([f.size, f.decimals]) + bytes(14)
    return out + b"\r"


def implode(body: bytes) -> bytes:
    """An imploded stream of literals alone: valid, not small."""
    bits = np.zeros((len(body), 9), np.uint8)  # a 0, then the byte, its lowest bit first
    bits[:, 1:] = np.unpackbits(np.frombuffer(body, np.uint8)[:, None], axis=1, bitorder="little")
    code, size = next((k, n) for k, (s, n) in enumerate(code_tables()[1]) if s == 15)
    end = [1, *(code >> k & 1 for k in range(size)), *[1] * 8]
    return bytes([0, 6]) + np.packbits(np.concatenate((bits.ravel(), np.array(end, np.uint8))), bitorder="little").tobytes() + b"\0"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it lies, where it goes


class DbcWriter(DataSourceArrowWriter):
    """A task writes a file for each rowsPerFile rows, which is all that it holds; files get their names when all tasks are done."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.fields = [written_field(f, int(options.get("width", 60))) for f in schema]
        self.folder, self.encoding = options["path"].rstrip("/"), options.get("encoding", "latin-1")
        self.rows, self.packed = int(options.get("rowsperfile", BATCH_ROWS)), options.get("packed", "true") == "true"
        self.run = uuid.uuid4().hex

    def file(self, records: list[np.ndarray], number: int) -> tuple[str, str]:
        body = b"".join(x.tobytes() for x in records)
        head, kind = dbf_header(self.fields, sum(len(x) for x in records)), "dbc" if self.packed else "dbf"
        task = TaskContext.get()
        at = f"{self.folder}/.{self.run}-{task.taskAttemptId()}-{number}"
        with created(at) as out:
            out.write(head + bytes(4) + implode(body) if self.packed else head + body + b"\x1a")
        return at, f"{self.folder}/{self.run[:8]}_{task.partitionId()}_{number}.{kind}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held, count, made = [], 0, []
        for batch in iterator:
            columns = [cells(c, f, self.encoding) for c, f in zip(batch.columns, self.fields, strict=True)]
            records = np.concatenate([np.full((batch.num_rows, 1), 0x20, np.uint8), *columns], axis=1)
            while len(records):
                part, records = records[: self.rows - count], records[self.rows - count :]
                held.append(part)
                count += len(part)
                if count == self.rows:
                    made.append(self.file(held, len(made)))
                    held, count = [], 0
        if count or not made:
            made.append(self.file(held or [np.zeros((0, 1), np.uint8)], len(made)))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for at, to in m.files if m else ():
                store, path = store_of(at)
                store.move(path, store_of(to)[1])

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for at, _ in m.files if m else ():
                store, path = store_of(at)
                store.delete_file(path)


# ---------------------------------------------------------------- the data source


class DbcDataSource(DataSource):
    """format("dbc"): path, encoding (latin-1), rows in a batch (batchRows), drift (refuse or widen), position (true adds _file and _record).

    Without a schema the headers of all files settle it, many at a time; read_parts()
    lets Spark read them instead.
    """

    @classmethod
    def name(cls) -> str:
        return "dbc"

    def schema(self) -> T.StructType:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(read_header, found))
        settled = settle(((u, own_fields(h, u)) for u, h in zip(found, headers, strict=True)), self.options.get("drift", "refuse"))
        names = {f.name.strip().lower(): f.name for f in layout(headers[0]).fields}  # as the first file writes them
        settled = T.StructType([T.StructField(names.get(f.name, f.name), f.dataType, True) for f in settled])
        return T.StructType([*settled, *POSITION]) if self.options.get("position") == "true" else settled

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DbcWriter:
        """Adds files to a folder; options: packed (true: DBC), width of text, encoding, rowsPerFile."""
        if overwrite:
            raise ValueError("files are added, so the mode is append")
        return DbcWriter(schema, dict(self.options))


@dataclass
class FilePartition(InputPartition):
    uri: str


class DbcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in files(self.options["path"])]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        """One file at a time, in memory that doesn't grow with it."""
        position = self.options.get("position") == "true"
        wanted = T.StructType([f for f in self.schema if not position or f.name not in POSITION.names])
        uri, names = partition.uri, self.schema.names
        for numbers, batch in record_batches(chunks_of(uri), self.options.get("encoding", "latin-1"), int(self.options.get("batchrows", BATCH_ROWS))):
            own = dict(zip(wanted.names, fitted(batch, uri, wanted), strict=True))
            if position:
                own |= {"_file": pa.array([uri] * len(numbers), pa.string()), "_record": pa.array(numbers, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names=names)
