"""How operators of this package read a text column and add columns to a table.

Null, empty and very long texts, repeated rows and extra columns are treated
alike everywhere: a null text counts as an empty one unless an operator says
otherwise, rows are kept as often as they occur, and an input column with the
name of a result column gives way to the result.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import textvec

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # at the end of a query
MARKS = 1 << 23  # bits that tell most keys apart from those that are looked for: 131072 rows of a broadcast, at most


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, text: str, fields: T.StructType, compute: Callable[[textvec.Slice], list], drop_text: bool = False) -> DataFrame:
    """Adds the fields that compute() returns for each slice of the text column.

    One pass in Arrow batches, without a shuffle.  compute() gets whole texts
    and returns one array, or list, for each field.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in new and not (drop_text and f.name == text)]
    src = fresh(df, "text_in")
    names = [f.name for f in kept]
    schema = T.StructType(kept + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(src))
            for s in textvec.slices(column):
                part = batch.slice(s.lo, s.hi - s.lo)
                arrays = [part.column(part.schema.get_field_index(n)) for n in names]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(s)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").alias(src)).mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in tests one of Spark's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark._jvm.java.io.File(spark._jvm.java.lang.System.getProperty("java.io.tmpdir"), "sanilake-shared").toURI().toString()
    return folder.rstrip("/")


_records: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """Lists the tables that stored() writes meanwhile, so that they can be discarded together."""
    made: list[DataFrame] = []
    _records.append(made)
    try:
        yield made
    finally:
        _records.remove(made)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    What follows starts from files that outlive any executor, and nothing
    above is computed twice.  So the write's shuffle files are deleted at once,
    not when the driver's garbage happens to be collected.
    """
    return stored_in_turn([df], name, compression)


def stored_in_turn(parts: list[DataFrame], name: str, compression: str = "snappy") -> DataFrame:
    """All rows of tables with the same columns as one; the shuffle files of each write go before the next one begins."""
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        for df in parts:
            df.write.mode("append").option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(parts[0].schema).parquet(path)
    for made in _records:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once all that is derived from it has been written too."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(df: DataFrame, by: str, slices: int) -> list[DataFrame]:
    """The rows of df in slices by a 64-bit hash; no value of it is in two of them, and none is left out."""
    return [df.where(F.pmod(F.coalesce(by, F.lit(0)), F.lit(slices)) == k) for k in range(slices)]


def likely_among(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """All rows of df whose key, a 64-bit hash, is one of the chosen ones (one column, distinct), and few others; no row is shuffled.

    A table of MARKS bits, whatever the number of rows, is sent to all tasks.
    """
    words = F.lit(MARKS // 64)
    place = F.pmod(F.col(key), words).alias("mark_word")
    at = F.floor(F.pmod(F.col(key), F.lit(MARKS)) / words).cast("int").alias("mark_bit")
    marks = chosen.select(place, at).groupBy("mark_word").agg(F.bit_or(F.expr("shiftleft(1L, mark_bit)")).alias("mark_bits"))
    likely = df.withColumns({"mark_word": place, "mark_bit": at}).join(F.broadcast(marks), "mark_word").where("shiftrightunsigned(mark_bits, mark_bit) & 1 = 1")
    return likely.select(*df.columns)


def among(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The rows of df whose key is one of the chosen ones, as above; few of the others are shuffled."""
    return likely_among(df, key, chosen).join(chosen, key)  # a left_semi join would be moved below the marks
