"""Groups of documents whose n-gram sets have a Jaccard similarity of at least t.

The overlaps of all pairs are the product of the document by n-gram incidence
matrix with its transpose.  Only few entries can reach t, and the columns are
dealt into blocks so that they show themselves.  Sets of at most U n-grams
with a similarity of t differ in at most d = 2U(1-t)/(1+t) of them, so of more
than d blocks of columns one is the same in both sets.  Pairs that
agree in no block are never multiplied, nor are those that bounds from the sizes, and
from n-grams that no other candidate has, rule out.  For the others the rows
are multiplied one block of columns after another: overlaps are added up by pair, and a
pair is dropped as soon as what is left of both sets can't bring it to t.

Sizes fall into classes, and a set is dealt as its own class and as those of the
largest sets that it could be linked with, so both sets of a pair are dealt alike once.

Equal sets are one node.  Groups of near copies aren't expanded into pairs:
each list of sets that agree in a block is first linked with one member, and
then only those pairs are multiplied that are still in different components.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.components import components
from sanilake.llm.texts import add_columns, discard, recorded, stored

GROWTH = 1.3  # of the largest size from one class to the next
COLUMN_BITS = 3  # 8 blocks of columns, one multiplied after another
PAIRS = 256  # pairs that are multiplied together
MET = 1 << 20  # sets that a task remembers


@dataclass(frozen=True)
class Rule:
    """Shingles of k words; linked if den * |intersection| >= num * |union|."""

    k: int = 3
    num: int = 90
    den: int = 100


def class_tops(most: int) -> list[int]:
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    return tops


def dealing(top: int, rule: Rule) -> tuple[int, int]:
    """(d, blocks) of a class: how many n-grams can differ, and into how many blocks they are dealt.

    Some blocks of a set are empty; enough are dealt that more than d are not.
    """
    d = 2 * top * (rule.den - rule.num) // (rule.den + rule.num)
    if not d:
        return 0, 0
    return d, d + 3 + int(np.ceil(3 * d * np.exp(-top / (GROWTH * (d + 1)))))


def shingles(s: textvec.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the k-word shingles of all rows, one row after another, and where each row's begin.

    A row of fewer words, but not none, has one: all its words.
    """
    w = textvec.words(s)
    first, values = textvec.windows(w, k)
    counts = w.counts
    per = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = []
        for r in short:
            own = w.values[w.bounds[r] : w.bounds[r + 1]]
            whole.append(textvec.mix((own * (textvec.seeded(len(own), 13) | np.uint64(1))).sum(keepdims=True) + np.uint64(len(own)))[0])
        before = np.concatenate(([0], np.cumsum(per)))
        values = np.insert(values, before[short], np.array(whole, np.uint64))
        per[short] = 1
    return values, np.concatenate(([0], np.cumsum(per)))


def block_keys(own: np.ndarray, n: int, tops: list[int], rule: Rule) -> list[np.ndarray]:
    """One value for each block of columns that holds n-grams of the set."""
    out = []
    low, high = bisect_left(tops, n), bisect_left(tops, n * rule.den // rule.num)
    for c in range(low, high + 1):
        d, blocks = dealing(tops[c], rule)
        if not blocks:
            continue
        seed = np.uint64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        block = (textvec.mix(own ^ seed) >> np.uint64(33)).astype(np.int64) % blocks
        order = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(block[order]) > 0))
        sums = np.add.reduceat(textvec.mix(own[order] + seed), first)
        filled = block[order][first]
        out.append(textvec.mix(sums ^ textvec.mix(seed + filled.astype(np.uint64))))
        if len(filled) <= d:  # too many blocks are empty: those count as blocks too
            empty = np.setdiff1d(np.arange(blocks), filled).astype(np.uint64)
            out.append(textvec.mix(~textvec.mix(seed + empty)))
    return out


def node_value(own: np.ndarray) -> np.int64:
    return np.int64(textvec.as_long(textvec.mix(textvec.mix(own).sum(keepdims=True) ^ textvec.mix(own + np.uint64(5)).sum(keepdims=True) * np.uint64(3)))[0])


def sets_table(docs: DataFrame, text: str, rule: Rule, contents: bool) -> DataFrame:
    """Replaces the text by n_shingles, node (a value of the set) and its block keys, or its n-grams.

    A set that its task has met already has no block keys again, so copies of
    one text send them once for each task, not for each copy.
    """
    met: set[int] = set()
    fields = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def compute(s: textvec.Slice) -> list:
        values, bounds = shingles(s, rule.k)
        sizes, nodes, keys = [], [], []
        tops = class_tops(int(np.diff(bounds).max(initial=0)) * rule.den // rule.num + 1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.unique(values[a:b])
            node = int(node_value(own)) if len(own) else None
            sizes.append(len(own))
            nodes.append(node)
            again = node is None or node in met
            keys.append(own if contents else np.concatenate([np.zeros(0, np.uint64), *([] if again else block_keys(own, len(own), tops, rule))]))
            if node is not None and not contents:
                if len(met) >= MET:
                    met.clear()
                met.add(node)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *keys])
        return [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(textvec.as_long(flat)))]

    return add_columns(docs, text, fields, compute, drop_text=True)


def could_link(rule: Rule, a: str, b: str):
    """The size bounds: both sizes, and what either shares with any other set, allow a link of rows a and b."""
    na, nb, sa, sb = (F.col(f"{x}.{c}") for c in ("n", "shared") for x in (a, b))
    return (rule.den * F.least(na, nb) >= rule.num * F.greatest(na, nb)) & ((rule.num + rule.den) * F.least(sa, sb) >= rule.num * (na + nb))


def offsets_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, one list after another, and where each begins."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[bounds[0] : bounds[-1]].view(np.uint64), bounds - bounds[0]


def overlaps(left: pa.Array, right: pa.Array, rule: Rule) -> np.ndarray:
    """Which pairs of rows are linked: the product of two incidence matrices, by blocks of columns.

    Columns are dealt into COLUMN_BLOCKS by their value.  What a pair has in common is
    added up over blocks; after each, pairs are dropped that their size bound rules out.
    """
    sides = [offsets_of(x) for x in (left, right)]
    sizes = [np.diff(b) for _, b in sides]
    least = -(-rule.num * (sizes[0] + sizes[1]) // (rule.num + rule.den))  # the overlap that links
    n = len(least)
    rows = [np.repeat(np.arange(n), x) for x in sizes]
    block = [(v >> np.uint64(64 - COLUMN_BITS)).astype(np.int64) for v, _ in sides]
    met, seen, alive = np.zeros(n, np.int64), [np.zeros(n, np.int64) for _ in sides], np.minimum(*sizes) >= least
    for k in range(1 << COLUMN_BITS):
        here = [np.flatnonzero((b == k) & alive[r]) for b, r in zip(block, rows, strict=True)]
        row = np.concatenate([r[h] for r, h in zip(rows, here, strict=True)])
        column = np.concatenate([v[h] for (v, _), h in zip(sides, here, strict=True)])
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        both = np.flatnonzero((row[1:] == row[:-1]) & (column[1:] == column[:-1]))  # sets have a column once
        met += np.bincount(row[both], minlength=n)
        for s, r, h in zip(seen, rows, here, strict=True):
            s += np.bincount(r[h], minlength=n)
        alive &= met + np.minimum(sizes[0] - seen[0], sizes[1] - seen[1]) >= least
    return alive


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those pairs (a, b) whose overlap is large enough."""
    left = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                keep = pa.array(overlaps(part.column(2), part.column(3), rule))
                yield part.select(["a", "b"]).filter(keep)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb").mapInArrow(multiply, "a long, b long")


def several(members: DataFrame, by: str) -> DataFrame:
    """Keys under which more than one value of `by` stands."""
    return members.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo < hi").select("key")


def meetings(rows: DataFrame) -> DataFrame:
    """(node, key), each once, of the keys under which more than one node stands.

    Rows are shuffled once by key and read in order, in batches: what is
    held is a batch, however many nodes a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys)], names=["node", "key"])

        held = np.zeros((2, 0), np.int64)  # the last row so far
        linked = False  # whether the row before it has its key too
        for batch in batches:
            keys, nodes = (np.concatenate((h, batch.column(k).to_numpy())) for k, h in zip(("key", "node"), held, strict=True))
            new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
            keys, nodes = keys[new], nodes[new]
            if not len(keys):
                continue
            with_next = np.append(keys[1:] == keys[:-1], False)
            with_last = np.append(linked and held.size > 0, with_next[:-1])
            keep = (with_next | with_last)[:-1]
            yield out(keys[:-1][keep], nodes[:-1][keep])
            held, linked = np.array([keys[-1:], nodes[-1:]]), bool(with_last[-1])
        if linked:
            yield out(*held)

    return rows.select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "node long, key long")


def rare_meetings(nodes: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of different roots that share an n-gram among the rarest of both.

    Of the smaller of two linked sets at most n - 2tn/(1+t) n-grams are not in
    the other, of the larger at most n - tn.  So if one more of the rarest is
    taken, one of them is in both.  What lies behind the shared n-gram bounds the
    overlap as well.  Edits make n-grams rare, so near copies of one text
    that are too far apart don't meet.
    """
    grams = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("keys").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.join(counts, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("ranked"))
    probe = F.col("n") - F.ceil(rule.num * F.col("n") / rule.den) + 1
    first = ranked.join(nodes, "node").select("node", "n", "shared", "root", F.posexplode(F.slice("ranked", F.lit(1), probe.cast("int"))).alias("at", "x"))
    first = stored(first.select("node", "n", "shared", "root", "at", F.col("x.gram").alias("key")), "rare")
    first = stored(first.join(several(first, "root"), "key", "left_semi"), "rare")
    m, c = F.struct("m.n", "m.node"), F.struct("c.n", "c.node")
    index = F.col("m.at") <= F.col("m.n") - F.ceil(2 * rule.num * F.col("m.n") / (rule.num + rule.den))
    reach = 1 + F.least(F.col("m.n") - F.col("m.at"), F.col("c.n") - F.col("c.at")) - 1
    enough = (rule.num + rule.den) * reach >= rule.num * (F.col("m.n") + F.col("c.n"))
    met = first.alias("m").join(first.alias("c"), "key").where((m < c) & (F.col("m.root") != F.col("c.root")) & index & enough & could_link(rule, "m", "c"))
    return met.select(F.least("m.node", "c.node").alias("a"), F.greatest("m.node", "c.node").alias("b")).distinct()


def groups(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and links of each row; its other columns are left out.

    component_id is the smallest doc_id of the component, the row's own if it
    has no links.  Null and empty texts have no shingles and no links.  Rows
    without a doc_id are linked with rows of the same set only.  links tells
    whether the row's set is linked with another, equal sets included.
    """
    docs_ = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    with recorded() as made:
        table = stored(sets_table(docs_, "text", rule, contents=False), "sets")
        members = stored(meetings(table.select("node", F.explode("keys").alias("key"))), "members")
        rows = stored(table.drop("keys"), "rows")
        discard(table)  # its keys are most of what this needs on disk
        nodes = stored(components_of(docs_, rows, members, rule), "groups")
    discard(*(t for t in made if t is not rows and t is not nodes))
    named = rows.join(nodes, "node", "left")
    return named.select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("least_id", "id").alias("component_id"), (F.coalesce("rows", F.lit(1)) > 1).alias("links"))


def components_of(docs_: DataFrame, table: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """(node, least_id, rows): for each set the smallest id of its component and how many rows that has."""
    chosen = members.select("node").distinct()
    first = table.groupBy("node").agg(F.min("id").alias("id")).join(chosen, "node", "left_semi").where("id is not null")
    again = docs_.join(first.select("id").distinct(), "id", "left_semi")
    sets = sets_table(again, "text", rule, contents=True).join(chosen, "node", "left_semi").dropDuplicates(["node"])
    sets = stored(sets.select("node", F.col("n_shingles").alias("n"), "keys"), "candidates")
    alone = sets.select("node", F.explode("keys").alias("gram")).groupBy("gram").agg(F.count("*").alias("sets"), F.min("node").alias("node")).where("sets = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    able = sizes.where(rule.den * F.col("shared") >= rule.num * F.col("n"))  # the rest can be linked with nothing
    members = stored(members.join(able, "node"), "members")

    central = members.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("shared")).alias("alone"), F.col("node"), F.col("n"), F.col("shared"))).alias("c"))
    central = central.select("key", "c.*")
    pair = (F.least("m.node", "c.node").alias("a"), F.greatest("m.node", "c.node").alias("b"))
    met = members.alias("m").join(central.alias("c"), "key").where((F.col("m.node") != F.col("c.node")) & could_link(rule, "m", "c"))
    tried = stored(met.select(*pair).distinct(), "pairs")
    edges = stored(linked(tried, sets, rule), "links")

    roots = components(edges)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.join(several(rooted, "root"), "key", "left_semi"), "rooted")
    least = rooted.groupBy("key").agg(F.min("n").alias("least"))
    open_ = rooted.join(least, "key").where((rule.num + rule.den) * F.col("shared") >= rule.num * (F.col("n") + F.greatest(F.col("least"), F.ceil(rule.num * F.col("n") / rule.den))))
    met = rare_meetings(open_.select("node", "n", "shared", "root").distinct(), sets, rule)
    more = linked(met.join(tried, ["a", "b"], "left_anti"), sets, rule)
    edges = stored(edges.unionByName(more), "links")

    roots = components(edges)
    nodes = table.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("rows"))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))  # one row for each set, however many documents have it
    ids = nodes.groupBy("root").agg(F.min("least_id").alias("least_id"), F.sum("rows").alias("rows"))
    return nodes.select("node", "root").join(ids, "root").select("node", "least_id", "rows")
