"""From files to publications: parts of a scope, runs that can be cited, and population editions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanilake.functions.text import uri_parts
from sanilake.operators.relational import one_row_each
from sanilake.plans.lake import Lake, Publication, PublicationError, SourceFile, cite
from sanilake.sources import aggregates, dbc
from sanilake.sources.schema import with_library_columns

RETRY_SAFE = ("skip_same", "error_if_exists", "replace")


def source_files(spark: SparkSession, uri: str) -> list[SourceFile]:
    """The files of a path in the order of their parts, each with its digest and size, read by Spark a piece at a time.

    What comes to the driver is a row for each file of a scope.
    """
    found = dbc.files(uri)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, one in zip(batch.column("part").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                hashed, size = hashlib.sha256(), 0
                with dbc.opened(one) as file:
                    while chunk := file.read(dbc.IN_BYTES):
                        hashed.update(chunk)
                        size += len(chunk)
                rows.append((part, one, hashed.hexdigest(), size))
            parts, uris, hashes, sizes = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(uris, pa.string()), pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], names=["part", "uri", "sha256", "bytes"])

    listed = spark.createDataFrame(list(enumerate(found)), "part int, uri string").repartition(max(1, len(found)))
    return [SourceFile(r["uri"], r["sha256"], r["bytes"]) for r in listed.mapInArrow(digest, "part int, uri string, sha256 string, bytes long").orderBy("part").collect()]


def publish_parts(lake: Lake, table: str, uri: str, scope: Mapping[str, Any], parser_version: str, release: str = "final", policy: str = "error_if_exists", run_id: str | None = None, declared: Mapping[str, str] | None = None, drift: str = "refuse", encoding: str = "latin-1") -> Publication | None:
    """The parts of one scope as one publication, every part recorded in order.

    All parts must be of one folder.  None if the policy is skip_same and the same parts
    were published by the same parser.  A failure is recorded as an attempt.
    """
    spark = lake.spark
    try:
        sources = source_files(spark, uri)
        if not sources:
            raise FileNotFoundError(uri)
        folders = {s.uri.rpartition("/")[0] for s in sources}
        if len(folders) > 1:
            raise PublicationError(f"parts of one scope are in several folders: {sorted(folders)}")
        rows = with_library_columns(dbc.read_parts(spark, ",".join(s.uri for s in sources), drift, declared, encoding), dict(scope), release)
        return lake.publish(table, rows, dict(scope), sources, parser_version, policy, run_id, release)
    except Exception as e:
        lake.record_attempt(table, dict(scope), f"{type(e).__name__}: {e}"[:500], run_id)
        raise


@dataclass(frozen=True)
class Imported:
    """What a run did, by scope: published, or unchanged, or the error that stopped it."""

    run_id: str
    published: tuple[Publication, ...]
    unchanged: tuple[dict, ...]
    failed: tuple[tuple[dict, str], ...]


def import_research(lake: Lake, table: str, uris: Sequence[tuple[Mapping[str, Any], str]], run_id: str, parser_version: str, policy: str = "skip_same", **options: Any) -> Imported:
    """Imports scopes under a run id that is chosen before anything is read, so that the run can be cited and taken up again.

    uris: (scope, where its parts are).  append is refused: a second try would double rows.
    A scope that fails doesn't stop the others.
    """
    if not run_id.strip():
        raise ValueError("a run needs an id")
    if policy not in RETRY_SAFE:
        raise ValueError(f"policy {policy!r} isn't one that can be tried again: {', '.join(RETRY_SAFE)}")
    published, unchanged, failed = [], [], []
    for scope, uri in uris:
        try:
            made = publish_parts(lake, table, uri, scope, parser_version, policy=policy, run_id=run_id, **options)
        except Exception as e:  # recorded as an attempt
            failed.append((dict(scope), f"{type(e).__name__}: {e}"[:500]))
            continue
        if made is None:
            unchanged.append(dict(scope))
        else:
            published.append(made)
    return Imported(run_id, tuple(published), tuple(unchanged), tuple(failed))


def save_result(df: DataFrame, folder: str, publications: Sequence[Publication], snapshot_id: int | None, title: str) -> None:
    """A result as one CSV file with a heading, and beside it what to cite.

    For results, which are small: one task writes the file, so that it is one.  The folder is replaced as a whole.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, place = path(f"{folder.rstrip('/')}.new-{uuid.uuid4().hex}"), path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    df.coalesce(1).write.option("header", True).option("emptyValue", "").csv(f"{new}/result")
    spark.createDataFrame([(cite(publications, snapshot_id, title),)], "value string").coalesce(1).write.text(f"{new}/citation")
    store.delete(place, True)
    if not store.rename(new, place):
        raise OSError(f"{folder} can't be written")


# ---------------------------------------------------------------- population

POPULATION, MANIFEST = "ibge_population", "ibge_population_manifest"
ROWS = ("codigo_ibge", "ano", "populacao", "publication_id")


def append_population(lake: Lake, documents: DataFrame, rule: aggregates.Aggregate, parser_version: str = "population-1") -> str:
    """Appends an edition's population with its manifest, both in one snapshot or neither; returns the publication id.

    documents: those of one edition, see aggregates.  A table of that name that has
    other columns, or no manifest beside it, is not ours and is refused.
    """
    names = lake.tables()
    if (POPULATION in names) != (MANIFEST in names) or (POPULATION in names and set(lake.table(POPULATION).columns) != set(ROWS)):
        raise PublicationError(f"{POPULATION} is there already and wasn't made here")
    publication = uuid.uuid4().hex
    found = aggregates.reconciled(documents, rule)
    rows = found.select(F.col("code").alias("codigo_ibge"), F.col("year").alias("ano"), F.col("population").alias("populacao"), F.lit(publication).alias("publication_id"))
    evidence = F.array_sort(F.collect_list(F.struct("role", F.sha2("body", 256).alias("sha256"))))  # five documents
    manifest = documents.groupBy("edition", "year").agg(evidence.alias("evidence"))
    revision = found.groupBy("edition", "year").agg(F.min("revision").alias("revision"), F.count("*").alias("rows"))
    manifest = manifest.join(revision, ["edition", "year"]).select(F.lit(publication).alias("publication_id"), "edition", F.col("year").alias("ano"), "revision", "rows", F.lit(parser_version).alias("parser_version"), "evidence")
    with lake.transaction():
        if not lake.ingest(POPULATION, rows):
            raise PublicationError("the edition has no population")
        if lake.ingest(MANIFEST, manifest) != 1:
            raise PublicationError("one edition at a time")
    return publication


def population(lake: Lake, snapshot_id: int | None = None) -> DataFrame:
    """(codigo_ibge, ano, populacao); a place and year that several publications have stops every read."""
    return one_row_each(lake.table(POPULATION, snapshot_id), ("codigo_ibge", "ano"), ("populacao",), "population")


def citation_files(sources: DataFrame, uri: str = "uri") -> DataFrame:
    """Adds host, folder and file name of a source's address."""
    parts = uri_parts(F.col(uri))
    return sources.withColumns({"host": parts["host"], "folder": parts["folder"], "file": parts["name"]})
