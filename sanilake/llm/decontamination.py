"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings (term, document, position) of the training texts
for terms that test items use.  A posting can only be part of a window if its
neighbours are test terms too, so positions outside runs of test terms as long
as a window are left out; nothing that could match is.  Proximity matches may
have foreign words between, so they have postings of their own: those within
reach of a place where the three terms of a window that the fewest items have stand together.

A window is looked up from its rarest term: the term's postings, shifted by
its place in the item, say where the item could lie in a document, and the
shifted postings of the item's other terms say which of its words do lie there.
Runs of such words as long as a window are the exact phrase matches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.texts import add_columns, discard, fresh, recorded, stored

WINDOW = 10
SLOP = 5  # foreign words among those of a proximity match
GATE = 1 << 22  # the filter of test terms: so many bytes, however many the terms


def _words(s: textvec.Slice) -> textvec.Words:
    return textvec.words(s, textvec.ALNUM)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, size, terms): one row for each item with a word.  Rows without an id are left out."""

    def compute(s: textvec.Slice) -> list:
        w = _words(s)
        return [pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(w.bounds.astype(np.int32)), pa.array(textvec.as_long(w.values)))]

    fields = T.StructType([T.StructField("size", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType()))])
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return stored(add_columns(rows.withColumn("item", F.monotonically_increasing_id()), "text", fields, compute, drop_text=True).where("size > 0"), "items")


def gates(items: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters of the terms of long and of short items, and the least size of a short one."""
    short = F.col("size") < window
    bits = items.select(short.alias("short"), F.explode("terms").alias("t")).select("short", (F.col("t").bitwiseAND(GATE - 1)).alias("bit")).distinct().toArrow()
    out = []
    for kind in (False, True):
        gate = np.zeros(GATE, bool)
        gate[bits["bit"].to_numpy()[np.array(bits["short"].to_pylist(), bool) == kind]] = True
        out.append(gate)
    least = items.where(short).agg(F.min("size")).first()[0]
    return out[0], out[1], int(least or window)


def in_runs(flags: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Which flags stand in a run of k or more within their row."""
    n = len(flags)
    if not n:
        return flags
    breaks = np.append(True, (flags[1:] != flags[:-1]) | (rows[1:] != rows[:-1]))
    first = np.flatnonzero(breaks)
    size = np.diff(np.append(first, n))
    return np.repeat(flags[first] & (size >= k), size)


def leading(items: DataFrame, window: int) -> pa.Table:
    """(t0, t1, t2), each once: of each window three terms that the fewest items have; fewer if it has fewer."""
    df = items.select("item", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    asked = windows(items, window).select("item", "first", F.explode("terms").alias("term")).join(df, "term")
    ranked = asked.groupBy("item", "first").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("terms"))
    return ranked.select(*(F.coalesce(F.get("terms.term", F.lit(k)), F.get("terms.term", F.lit(0))).alias(f"t{k}") for k in range(3))).distinct().toArrow()


def pair_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a ^ (b >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed >> np.uint64(64 - GATE.bit_length() + 1)


def lead_gates(lead: pa.Table) -> list[np.ndarray]:
    """Filters of the first leading terms of windows, and of the pairs of these with the second and third ones."""
    t = [lead[f"t{k}"].to_numpy().view(np.uint64) for k in range(3)]
    out = [np.zeros(GATE, bool) for _ in t]
    for gate, bits in zip(out, (t[0] & np.uint64(GATE - 1), pair_bits(t[0], t[1]), pair_bits(t[0], t[2])), strict=True):
        gate[bits] = True
    return out


def near_leads(flags: np.ndarray, values: np.ndarray, rows: np.ndarray, bounds: np.ndarray, reach: int, gates: list[np.ndarray]) -> np.ndarray:
    """Which flags stand within `reach` words of a first leading term that has the second and the third of a window within reach too.

    A window that lies within `reach` words has its leading terms there, so nothing of it is left out.
    """
    at = np.flatnonzero(gates[0][values & np.uint64(GATE - 1)])
    for gate in gates[1:]:
        seen = np.zeros(len(at), bool)
        for d in range(1 - reach, reach):
            there = np.flatnonzero(~seen & (at + d >= bounds[rows[at]]) & (at + d < bounds[rows[at] + 1]))
            seen[there] = gate[pair_bits(values[at[there]], values[at[there] + d])]
        at = at[seen]
    steps = np.zeros(len(flags) + 1, np.int64)
    np.add.at(steps, np.maximum(at - reach + 1, bounds[rows[at]]), 1)
    np.add.at(steps, np.minimum(at + reach, bounds[rows[at] + 1]), -1)
    return flags & (np.cumsum(steps[:-1]) > 0)


#: Columns that an input's give way to.
RESULTS = ("n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


@dataclass
class Index:
    docs: DataFrame  # one row for each document row: row_no, n_words, and the columns of the input but the text
    postings: DataFrame  # term, row_no, pos: those of phrases
    near: DataFrame  # the same, of proximity matches with a slop up to that of the index
    items: DataFrame
    window: int
    slop: int
    row_no: str


def build(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP) -> Index:
    """Stores the postings of docs that items could match.

    Null and empty texts have no postings.  Repeated document rows each have
    their own; repeated items are looked up again and reported once.
    """
    spark = docs.sparkSession
    items = item_terms(items, item_id, item_text)
    long_gate, short_gate, least = gates(items, window)
    any_short = bool(short_gate.any())
    kept = [long_gate, short_gate, *lead_gates(leading(items, window))]
    sent = spark.sparkContext.broadcast([np.packbits(x) for x in kept])
    docs = docs.drop(*(c for c in docs.columns if c.lower() in RESULTS))
    term, place, phrase = (fresh(docs, c) for c in ("terms", "places", "phrase"))
    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField(term, T.ArrayType(T.LongType())), T.StructField(place, T.ArrayType(T.IntegerType())), T.StructField(phrase, T.ArrayType(T.BooleanType()))])
    unpacked: dict[int, np.ndarray] = {}

    def compute(s: textvec.Slice) -> list:
        if not unpacked:
            unpacked.update(enumerate(np.unpackbits(x).view(bool) for x in sent.value))
        w = _words(s)
        rows, bit = w.rows, w.values & np.uint64(GATE - 1)
        keep = in_runs(unpacked[0][bit], rows, window)
        if any_short:
            keep |= in_runs(unpacked[1][bit], rows, least)
        near = near_leads(unpacked[0][bit] | unpacked[1][bit], w.values, rows, w.bounds, window + slop, [unpacked[k] for k in (2, 3, 4)])
        at = np.flatnonzero(keep | near)
        bounds = pa.array(np.searchsorted(at, w.bounds).astype(np.int32))
        places = (at - w.bounds[rows[at]]).astype(np.int32)
        return [pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(textvec.as_long(w.values[at]))), pa.ListArray.from_arrays(bounds, pa.array(places)), pa.ListArray.from_arrays(bounds, pa.array(keep[at]))]

    row_no = fresh(docs, "row_no")
    table = stored(add_columns(docs.withColumn(row_no, F.monotonically_increasing_id()), text, fields, compute, drop_text=True), "postings", compression="zstd")
    near = table.select(F.col(row_no).alias("row_no"), F.explode(F.arrays_zip(F.col(term).alias("term"), F.col(place).alias("pos"), F.col(phrase).alias("phrase"))).alias("p")).select("p.term", "row_no", "p.pos", "p.phrase")
    return Index(table.drop(term, place, phrase), near.where("phrase").drop("phrase"), near.drop("phrase"), items, window, slop, row_no)


def places(items: DataFrame) -> DataFrame:
    return items.select("item", "item_id", "size", F.posexplode("terms").alias("ipos", "term"))


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item, item_id, size, first, terms): the windows of each item with their distinct terms."""
    ahead = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, window - 1)
    seen = places(items).withColumn("terms", F.array_distinct(F.collect_list("term").over(ahead)))
    whole = F.col("ipos") + F.least(F.lit(window), F.col("size")) <= F.col("size")
    return seen.where(whole).select("item", "item_id", "size", F.col("ipos").alias("first"), "terms")


def anchors(index: Index) -> DataFrame:
    """(item, ipos, term): the rarest term of each window, once for each place in an item."""
    df = index.postings.join(places(index.items).select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    seen = places(index.items).join(df, "term", "left")
    ahead = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, index.window - 1)
    rarest = seen.withColumns({"rarest": F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("ipos").alias("ipos"), F.col("term").alias("term"))).over(ahead)})
    whole = F.col("ipos") + F.least(F.lit(index.window), F.col("size")) <= F.col("size")
    return rarest.where(whole & (F.col("rarest.df") > 0)).select("item", "rarest.ipos", "rarest.term").distinct()


def phrases(index: Index) -> DataFrame:
    """(row_no, item, item_id, start, end): runs of document words that are windows of an item.

    start and end are positions of words, both included.
    """
    candidates = index.postings.join(anchors(index), "term").select("row_no", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    laid = candidates.join(index.items, "item").select("row_no", "item", "item_id", "size", "shift", F.posexplode("terms").alias("ipos", "term"))
    laid = laid.withColumn("pos", F.col("shift") + F.col("ipos"))
    met = laid.join(index.postings, ["row_no", "pos", "term"], "left_semi")
    in_item = Window.partitionBy("row_no", "item", "shift").orderBy("ipos")
    runs = met.withColumn("run", F.col("ipos") - F.row_number().over(in_item)).groupBy("row_no", "item", "item_id", "size", "shift", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return runs.where(F.col("end") - F.col("start") + 1 >= F.least(F.lit(index.window), F.col("size"))).select("row_no", "item", "item_id", "start", "end")


def proximity(index: Index, slop: int | None = None) -> DataFrame:
    """(row_no, item, item_id, ipos): windows all of whose distinct terms a document has in some stretch of their words + slop.

    Looked up from the rarest three terms, once for all windows that share them;
    the others are only asked for where those stand within reach.
    """
    slop = index.slop if slop is None else slop
    if slop > index.slop:
        raise ValueError(f"the index was built for a slop of {index.slop}")
    df = index.near.groupBy("term").agg(F.count("*").alias("df"))
    asked = windows(index.items, index.window).withColumn("reach", F.least(F.lit(index.window), F.col("size")) + slop)
    asked = asked.select("item", "item_id", "first", "reach", F.size("terms").alias("needed"), F.explode("terms").alias("term")).join(df, "term")
    asked = asked.groupBy("item", "item_id", "first", "reach", "needed").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("terms")).where(F.size("terms") == F.col("needed"))
    asked = stored(asked.withColumn("terms", F.col("terms.term")), "windows")
    key = ["row_no", "item", "item_id", "first", "reach", "needed", "at"]
    lead = ["t0", "t1", "t2"]  # the rarest terms, with which many windows begin; fewer if a window has fewer
    asked = asked.withColumns({t: F.coalesce(F.get("terms", F.lit(k)), F.get("terms", F.lit(0))) for k, t in enumerate(lead)})
    met = asked.select("reach", *lead).distinct().join(index.near.select(F.col("term").alias("t0"), "row_no", F.col("pos").alias("at")), "t0")
    for t in lead[1:]:
        other = index.near.select(F.col("term").alias(t), "row_no", "pos")
        met = met.join(other, ["row_no", t]).where(F.abs(F.col("pos") - F.col("at")) < F.col("reach")).select("row_no", "at", "reach", *lead).distinct()
    both = stored(met, "near").join(asked, ["reach", *lead])
    hits = both.select(*key, F.explode("terms").alias("term")).join(index.near, ["row_no", "term"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
    hits = hits.groupBy(*key).agg(F.collect_list(F.struct("pos", "term")).alias("hits"))
    in_reach = F.expr("exists(hits, a -> size(array_distinct(transform(filter(hits, b -> b.pos >= a.pos and b.pos < a.pos + reach), b -> b.term))) = needed)")
    return hits.where(in_reach).select("row_no", "item", "item_id", F.col("first").alias("ipos")).distinct()


def near_items(index: Index) -> DataFrame:
    """contamination() with n_near_items: how many items have a window within the slop, exact ones included."""
    with recorded() as made:
        near = stored(proximity(index).groupBy("row_no").agg(F.countDistinct("item_id").alias("n_near_items")), "near-items")
    discard(*made[:-1])
    rows = contamination(index, keep_row=True).join(near.withColumnRenamed("row_no", index.row_no), index.row_no, "left")
    return rows.withColumn("n_near_items", F.coalesce("n_near_items", F.lit(0))).drop(index.row_no)


def contamination(index: Index, keep_row: bool = False) -> DataFrame:
    """Every document row with n_words, n_hit, n_items, items_sha256 and contaminated; input columns with these names give way."""
    found = stored(phrases(index), "phrases")
    hit = found.select("row_no", F.explode(F.sequence("start", "end")).alias("pos")).groupBy("row_no").agg(F.countDistinct("pos").alias("n_hit"))
    own = fresh(index.docs, "item_ids")
    items = found.select("row_no", "item_id").distinct().groupBy("row_no").agg(F.array_sort(F.collect_list("item_id")).alias(own))
    seen = hit.join(items, "row_no").withColumnRenamed("row_no", index.row_no)
    out = index.docs.join(seen, index.row_no, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), own: F.coalesce(own, F.array().cast("array<string>"))})
    out = out.withColumns({"n_items": F.size(own).cast("long"), "items_sha256": F.sha2(F.concat_ws(",", own).cast("binary"), 256), "contaminated": F.col("n_hit") > 0})
    return out.drop(own, *([] if keep_row else [index.row_no]))
