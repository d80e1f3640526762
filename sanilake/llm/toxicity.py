"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over the words, and beginnings of words, that the
labelled examples show to matter.  The nearest examples by exact cosine are
found in an inverted index cut into blocks of examples: a block is scored only
if its terms' largest weights could bring an example among the nearest.  Their
votes, weighted by nearness, are calibrated on the examples themselves, each
scored without itself.

The examples are a sample of at most EXAMPLES labelled texts of each class, so
the index is of bounded size and every task holds it.  Document frequencies
count all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.counting import count_keys
from sanilake.llm.texts import add_columns

EXAMPLES = 2000  # labelled texts of each class, at most
TERMS = 512  # terms kept, at most
LEAST_CHI2 = 25.0
LEAST_DOCS = 5
BLOCK = 64  # examples in a block
NEAREST = 32
EVIDENCE = 3  # examples named for each text
STEMS = (4, 5, 6, 8)  # bytes of the beginnings of words


def terms_of(s: textvec.Slice, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) for every word and beginning of a word; of wanted terms only, if given."""
    w = textvec.words(s, textvec.ALNUM)
    rows, out = w.rows, []
    if wanted is not None:
        gate = np.zeros(1 << 16, bool)
        gate[wanted & np.uint64(0xFFFF)] = True
    for k in (0, *STEMS):
        values, own = w.values, rows
        if k:
            longer = w.ends - w.starts > k
            starts, own = w.starts[longer], rows[longer]
            values = textvec.mix(textvec.span_values(s.data, starts, starts + k, fold=True) + np.uint64(k))
        if wanted is not None:
            at = np.flatnonzero(gate[values & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(wanted, values[at]), len(wanted) - 1)
            there = wanted[place] == values[at]
            values, own = place[there].astype(np.uint64), own[at[there]]
        out.append((own, values))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def distinct_pairs(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return rows, values
    order = np.lexsort((rows, values))
    rows, values = rows[order], values[order]
    once = np.append(True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1]))
    return rows[once], values[once]


def vectors(s: textvec.Slice, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length, (1 + log tf) * idf; zero where a text has none of the terms."""
    n = len(s.offsets) - 1
    if not len(terms):
        return np.zeros((n, 0))
    rows, ids = terms_of(s, terms)
    tf = np.bincount(rows * len(terms) + ids.astype(np.int64), minlength=n * len(terms)).reshape(n, -1).astype(float)
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Index:
    """An inverted index over the examples, in blocks.

    Examples with the same heaviest terms lie in the same blocks.  limits has
    each term's largest weight in each block; blocks hold their own terms only.
    """

    ids: np.ndarray
    labels: np.ndarray  # share of toxic labels of each example text
    weights: np.ndarray  # how many texts of its class an example stands for
    limits: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # examples, terms, weights

    @staticmethod
    def build(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Index:
        used = np.flatnonzero(x.any(1)) if x.size else np.zeros(0, np.int64)
        heaviest = np.argsort(-x[used], axis=1, kind="stable")[:, :2] if len(used) else np.zeros((0, 2), np.int64)
        order = used[np.lexsort((used, *heaviest.T[::-1]))] if len(used) else used
        blocks, limits = [], []
        for at in range(0, len(order), BLOCK):
            own = order[at : at + BLOCK]
            terms = np.flatnonzero(x[own].any(0))
            blocks.append((own, terms, x[np.ix_(own, terms)]))
            limits.append(x[own].max(0))
        return Index(ids, labels, weights, np.array(limits).T if limits else np.zeros((x.shape[1], 0)), blocks)

    def nearest(self, q: np.ndarray, k: int = NEAREST, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine over 0 for each row; -1 where there are fewer.

        Equal cosines (to 9 places) go by example number.  Exact: a block is left out only
        for rows whose k-th best cosine its limit cannot reach.
        """
        n = len(q)
        sims, found = np.full((n, k), -1.0), np.full((n, k), len(self.ids), np.int64)
        if not self.blocks or not n:
            return sims, np.full((n, k), -1)
        limits = q @ self.limits
        best_first = np.argsort(-limits, axis=1, kind="stable")
        done = np.zeros(limits.shape, bool)

        def look(block: int, rows: np.ndarray) -> None:
            own, terms, weights = self.blocks[block]
            got = np.round(q[np.ix_(rows, terms)] @ weights.T, 9)
            if without is not None:
                got[own[None, :] == without[rows][:, None]] = -1.0
            got[got <= 0] = -1.0
            all_sims = np.concatenate((sims[rows], got), 1)
            all_found = np.concatenate((found[rows], np.broadcast_to(own, got.shape)), 1)
            order = np.lexsort((all_found, -all_sims), axis=1)[:, :k]
            sims[rows], found[rows] = np.take_along_axis(all_sims, order, 1), np.take_along_axis(all_found, order, 1)
            done[rows, block] = True

        for rank in range(min(2, limits.shape[1])):  # the likeliest blocks set the bar
            for block in np.unique(best_first[:, rank]):
                rows = np.flatnonzero((best_first[:, rank] == block) & (limits[:, block] > 0))
                if len(rows):
                    look(block, rows)
        for block in range(limits.shape[1]):
            rows = np.flatnonzero(~done[:, block] & (limits[:, block] > 0) & (limits[:, block] + 2e-9 >= sims[:, -1]))
            if len(rows):
                look(block, rows)
        return sims, np.where(sims > 0, found, -1)

    def votes(self, sims: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Share of toxic votes among the nearest, -1 where there are none.  Votes count by squared cosine."""
        known = found >= 0
        at = np.where(known, found, 0)
        weight = np.where(known, sims**2, 0) * (self.weights[at] if len(self.weights) else 0)
        total = weight.sum(1)
        return np.where(total > 0, (weight * (self.labels[at] if len(self.labels) else 0)).sum(1) / np.where(total > 0, total, 1), -1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve nearest to y, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class Model:
    terms: np.ndarray
    idf: np.ndarray
    index: Index
    curve: tuple[np.ndarray, np.ndarray]
    no_votes: float  # score of texts that share no term with an example

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        x, y = self.curve
        return np.where(votes < 0, self.no_votes, np.interp(votes, x, y) if len(x) else self.no_votes)


def examples(docs: DataFrame, labels: DataFrame, text: str, label: str, each: int) -> DataFrame:
    """At most `each` texts of each class, by hash; equal texts are one, with the mean of their labels.

    Texts themselves aren't shuffled: hashes are joined with the labels, and the
    few that are chosen are sent to where the texts are.
    """
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    marks = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    keys = hashed.join(marks, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"))
    keys = keys.withColumn("toxic", F.col("y") >= 0.5)
    sizes = keys.groupBy("toxic").agg(F.count("*").alias("of_class"))
    chosen = None
    for toxic in (True, False):
        part = keys.where(F.col("toxic") == toxic).orderBy(F.xxhash64("key"), "key").limit(each)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.join(F.broadcast(sizes), "toxic")
    texts = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    return texts.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "text", "y", "toxic", "of_class")


def fit(docs: DataFrame, labels: DataFrame, all_docs: DataFrame, text: str = "text", label: str = "toxic", each: int = EXAMPLES) -> Model:
    """Learns from docs (doc_id, text) that labels (doc_id, label) has; all_docs are all documents.

    Rows without a label or an id are left out.  Without any example every text scores 0.
    """
    got = examples(docs, labels, text, label, each).orderBy("doc_id").toArrow()  # 2 * each rows at most
    y, toxic = got["y"].to_numpy(), np.array(got["toxic"].to_pylist(), bool)
    per_class = {c: int((toxic == c).sum()) for c in (True, False)}
    weights = np.array([n / per_class[c] for n, c in zip(got["of_class"].to_pylist(), toxic, strict=True)], float)
    column = got["text"].combine_chunks()

    seen = [(t.lo + r, v) for t in textvec.slices(column) for r, v in (distinct_pairs(*terms_of(t)),)] if got.num_rows else []
    rows = np.concatenate([x[0] for x in seen]) if seen else np.zeros(0, np.int64)
    values = np.concatenate([x[1] for x in seen]) if seen else np.zeros(0, np.uint64)
    keys, at = np.unique(values, return_inverse=True)
    df, pos = np.bincount(at, minlength=len(keys)).astype(float), np.bincount(at, weights=y[rows], minlength=len(keys))
    n, p = float(len(y)), float(y.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (pos * (n - p - df + pos) - (df - pos) * (p - pos)) ** 2 / (p * (n - p) * df * (n - df))
    chi2 = np.where((df >= LEAST_DOCS) & np.isfinite(chi2), chi2, 0)
    best = np.lexsort((keys, -chi2))[:TERMS]
    terms = np.sort(keys[best[chi2[best] >= LEAST_CHI2]])

    sent = all_docs.sparkSession.sparkContext.broadcast(terms)

    def once_a_row(s: textvec.Slice) -> np.ndarray:
        if not len(sent.value):
            return np.zeros(0, np.uint64)
        r, ids = terms_of(s, sent.value)
        return np.unique(r * len(sent.value) + ids.astype(np.int64)).astype(np.uint64) % np.uint64(len(sent.value))

    total = all_docs.count()
    idf = np.full(len(terms), np.log(total + 1.0) + 1)
    for r in count_keys(all_docs, text, once_a_row).collect():  # TERMS rows at most
        idf[r["key"]] = np.log((total + 1) / (r["n"] + 1)) + 1
    x = np.concatenate([vectors(t, terms, idf) for t in textvec.slices(column)]) if got.num_rows else np.zeros((0, 0))
    index = Index.build(x, got["doc_id"].to_numpy(), y, weights)
    votes = index.votes(*index.nearest(x, without=np.arange(len(x))))
    lone = votes < 0
    no_votes = float(np.average(y[lone], weights=weights[lone])) if lone.any() else 0.0
    curve = isotonic(votes[~lone], y[~lone], weights[~lone]) if (~lone).any() else (np.zeros(0), np.zeros(0))
    return Model(terms, idf, index, curve, no_votes)


FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("votes", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("evidence_cosine", T.ArrayType(T.DoubleType()))])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds FIELDS to each row: the calibrated score, and the nearest examples as evidence.

    Null and empty texts share no term with any example and get that score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(s: textvec.Slice) -> list:
        m = sent.value
        q = vectors(s, m.terms, m.idf)
        sims, found = np.zeros((len(q), NEAREST)), np.full((len(q), NEAREST), -1)
        some = np.flatnonzero(q.any(1)) if q.size else np.zeros(0, np.int64)
        if len(some):
            sims[some], found[some] = m.index.nearest(q[some])
        votes = m.index.votes(sims, found)
        near = [[int(m.index.ids[j]) for j in row if j >= 0] for row in found[:, :EVIDENCE]]
        return [m.calibrated(votes), votes, pa.array(near, pa.list_(pa.int64())), pa.array([list(a[: len(b)]) for a, b in zip(sims, near, strict=True)], pa.list_(pa.float64()))]

    return add_columns(docs, text, FIELDS, compute)
