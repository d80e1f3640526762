"""A corpus pipeline over documents: rules, lines, copies, test items, tokens.

Each stage reads what its predecessor wrote.  All but the last return the
columns of documents; the last returns the token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanilake.llm import bpe, decontamination, line_dedup, ngram_join
from sanilake.llm.quality import quality_rules
from sanilake.llm.queries import tokenizer_file
from sanilake.llm.texts import stored

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the compression bands."""
    return quality_rules(docs.select(*DOCUMENTS)).where("kept").select(*DOCUMENTS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near-equal lines; documents that had only lines of others go."""
    left = line_dedup.dedup_lines(docs.select(*DOCUMENTS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENTS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: shingles of five words, a similarity of 0.8 or more.

    Each row counts for itself.  The smallest doc_id of a group stays, rows without one come last.
    """
    rows = stored(docs.select(*DOCUMENTS, F.monotonically_increasing_id().alias("row_no")), "numbered", compression="zstd")
    groups = ngram_join.groups(rows, ngram_join.Rule(k=5, num=80, den=100), doc_id="row_no").select("row_no", "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", F.xxhash64("text").alias("body"), "row_no").alias("place")
    first = rows.select("row_no", place).join(groups, "row_no").groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(first.select("place.row_no"), "row_no", "left_semi").select(*DOCUMENTS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*DOCUMENTS, F.col("text").alias("read_text"))
    found = decontamination.contamination(decontamination.build(rows, items, text="read_text"))
    return found.where("not contaminated").select(*DOCUMENTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of what they decode to."""
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), tokenizer_file())
    read = bpe.decode_ids(encoded, tokenizer_file())
    return read.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", copies), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", tokens)]

#: Compression bands, SimHash and BPE cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
