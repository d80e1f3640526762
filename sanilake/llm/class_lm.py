"""Scores texts by a Brown class-based bigram model.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).  Counts of words and of
neighbouring words come from the whole training part.  Exchange clustering
moves the most frequent words between classes while the likelihood of the class
bigrams grows.  Every other word is then assigned to the class that raises
it most, classes fixed: the HOT most frequent ones each by their own neighbours, words
beyond by those of all such words with the same ending.  So every word, seen or
not, has a class by its neighbours; transitions are counted anew with all of them.

Sizes.  The counts of all words stay in a table; bounded pieces of it reach
the driver and the tasks: the HOT most frequent words with their counts and classes,
and the classes of BINS endings.  Words beyond HOT have their counts by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.counting import count_keys
from sanilake.llm.texts import add_columns, fresh, stored

HOT = 1 << 18  # words whose counts and classes each task holds, at most: 5 MB
CORE = 1 << 13  # of these, the words that exchange classes, at most
BINS = 1 << 12  # of endings, by which the other words have their class
ENDING = 3  # bytes
CLASSES = 64
ROUNDS = 8
ADD = 0.1  # added to each count
PULL = 20.0  # weight of the class's own share in its transitions
SLOTS = 1 << 14  # neighbours of words that are weighed at once, each with a number for every class: 8 MB a table

END = np.uint64(0x5EED0FE4D0C5E4D1)  # stands for the end of a text


def tokens(s: textvec.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row and then its end; and where each row's tokens begin.

    The low bits of a word's value are the bin of its ending.
    """
    w = textvec.words(s)
    ending = textvec.span_values(s.data, np.maximum(w.ends - ENDING, w.starts), w.ends, fold=True)
    values = (w.values & ~np.uint64(BINS - 1)) | (ending & np.uint64(BINS - 1))
    n = len(w.bounds) - 1
    bounds = w.bounds + np.arange(n + 1)
    out = np.full(int(bounds[-1]), END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[bounds[1:] - 1] = False
    out[is_word] = values
    return out, bounds


def lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


@dataclass
class Model:
    hot: np.ndarray  # sorted values of the most frequent words
    hot_counts: np.ndarray
    hot_classes: np.ndarray
    bin_classes: np.ndarray  # classes of all other words, by their endings
    types: np.ndarray  # how many words each class has seen
    pairs: np.ndarray  # counts of neighbouring classes
    train_tokens: int
    vocabulary: int
    counts: DataFrame = field(repr=False)
    likelihood: list[float] = field(default_factory=list)  # of the core words' classes, round by round

    def parts(self) -> dict:
        """What tasks need; all of it is bounded by HOT, BINS and CLASSES."""
        mass = self.pairs.sum(0)  # tokens of each class
        room = mass + ADD * (self.types + np.isin(np.arange(CLASSES), self.bin_classes))  # and one unseen word of each class that can have some
        share = room / room.sum()
        moves = (self.pairs + PULL * share) / (self.pairs.sum(1, keepdims=True) + PULL)
        with np.errstate(divide="ignore"):
            return {"hot": self.hot, "hot_counts": self.hot_counts, "hot_classes": self.hot_classes, "bin_classes": self.bin_classes, "moves": np.log10(moves), "room": np.log10(room), "base_room": float(np.log10(self.train_tokens + ADD * (self.vocabulary + 1)))}


def class_ids(values: np.ndarray, hot: np.ndarray, hot_classes: np.ndarray, bin_classes: np.ndarray) -> np.ndarray:
    at, there = lookup(hot, values)
    others = bin_classes[(values & np.uint64(BINS - 1)).astype(np.int64)]
    return np.where(there, hot_classes[at], others) if len(hot) else others


def before_each(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; a text begins after an end."""
    before = np.roll(ids, 1)
    before[bounds[:-1]] = end
    return before


def f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_classes(own: np.ndarray, left: np.ndarray, right: np.ndarray, self_pairs: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the class where the likelihood is highest, and by how much.

    own: its class now; left, right: how often each class stands before and
    after it, without itself; self_pairs: how often it follows itself.
    """
    size = pairs.shape[0]
    best, gain = own.copy(), np.zeros(len(own))
    mass, logged = pairs.sum(0), f(pairs)
    for i, g in enumerate(own):
        before, after, s = left[i], right[i], self_pairs[i]
        n = before.sum() + s
        without, known, rest = pairs.copy(), logged.copy(), mass.copy()
        without[g] -= after
        without[:, g] -= before
        without[g, g] -= s
        known[g], known[:, g] = f(without[g]), f(without[:, g])
        rest[g] -= n
        a, b, corner = np.flatnonzero(after), np.flatnonzero(before), np.diag(without)
        change = (f(without[:, a] + after[a]) - known[:, a]).sum(1)  # the word joins each class's row
        change += (f(without[b] + before[b, None]) - known[b]).sum(0)
        change -= (f(corner + after) - f(corner)) + (f(corner + before) - f(corner))
        change += f(corner + after + before + s) - f(corner) - 2 * (f(rest + n) - f(rest))
        change[size - 1] = -np.inf  # that of all other words takes no members yet
        h = int(np.argmax(change))
        best[i], gain[i] = h, change[h] - change[g]
    return best, gain


def exchange(bigrams: DataFrame, clustered: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Moves words between classes, a part of them in each round.

    Words that move together don't know of each other.  If a round lowers the
    likelihood it is taken back, and fewer words move together from then on.

    The counts of neighbours by class, and each word's best class, are worked
    out by Spark; what comes back is a row for each core word.
    """
    spark, size, other, parts = bigrams.sparkSession, CLASSES + 1, clustered, 2
    likelihood: list[float] = []
    kept_pairs, kept = np.zeros((size, size)), classes

    def by_class(classes: np.ndarray) -> DataFrame:
        ids = spark.createDataFrame(pa.table({"w": np.arange(other + 1), "c": np.append(classes, CLASSES)}))
        a, b = ids.select(F.col("w").alias("a"), F.col("c").alias("ca")), ids.select(F.col("w").alias("b"), F.col("c").alias("cb"))
        return bigrams.join(F.broadcast(a), "a").join(F.broadcast(b), "b")  # CORE rows at most

    for k in range(ROUNDS + 1):
        named = by_class(classes)
        got = named.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect()  # CLASSES squared rows at most
        pairs = np.zeros((size, size))
        for r in got:
            pairs[r["ca"], r["cb"]] = r["n"]
        reached = float(f(pairs).sum() - f(pairs.sum(0)).sum() - f(pairs.sum(1)).sum())
        if likelihood and reached < likelihood[-1]:
            parts *= 4
        else:
            likelihood.append(reached)
            kept_pairs, kept = pairs, classes
        if k == ROUNDS or not clustered:
            break
        if classes is not kept:
            classes, pairs = kept, kept_pairs
            named = by_class(classes)
        beside = F.explode(
            F.array(
                F.struct(F.col("b").alias("w"), F.col("cb").alias("own"), (F.when(F.col("a") == F.col("b"), 2 * size).otherwise(F.col("ca"))).alias("slot"), F.col("n").alias("n")),
                F.struct(F.col("a").alias("w"), F.col("ca").alias("own"), (F.when(F.col("a") == F.col("b"), 2 * size + 1).otherwise(size + F.col("cb"))).alias("slot"), F.col("n").alias("n")),
            )
        ).alias("x")
        moving = named.select(beside).select("x.*").where((F.col("w") != other) & (F.pmod(F.xxhash64(F.lit(k), "w"), F.lit(parts)) == 0))
        vectors = moving.groupBy("w", "own", "slot").agg(F.sum("n").alias("n")).groupBy("w", "own").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))

        def choose(frames, pairs=pairs, size=size):
            for x in frames:
                dense = np.zeros((len(x), 2 * size + 2))
                for i, (slots, ns) in enumerate(zip(x["slots"], x["ns"], strict=True)):
                    dense[i, slots] = ns
                best, gain = best_classes(x["own"].to_numpy(), dense[:, :size], dense[:, size : 2 * size], dense[:, 2 * size], pairs)
                yield pd.DataFrame({"w": x["w"], "best": best, "gain": gain})

        moves = vectors.mapInPandas(choose, "w long, best long, gain double").where("gain > 1e-6").toArrow()
        classes = classes.copy()
        classes[moves["w"].to_numpy()] = moves["best"].to_numpy()
    return kept, kept_pairs, likelihood


def most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT words, the most frequent first: all that reach a least count, found from a histogram."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, words in sizes:  # 1024 steps at most
        total += words
        if total > HOT:
            break
        least = at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(step >= least).toArrow()
    keys, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((keys, -n))
    return keys[order], n[order]


def assigned(slots: np.ndarray, counts: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each word the class that it raises the likelihood most in, the classes of others fixed.

    slots: the class before the word, or CLASSES + 1 + the class after it, CLASSES
    being that of words without one; first: where each word's slots begin.
    """
    size = CLASSES + 1
    after = slots >= size
    known = np.where(after[:, None], pairs[:CLASSES, slots % size].T, pairs[slots % size, :CLASSES])
    gain = np.add.reduceat(f(known + counts[:, None]) - f(known), first, axis=0)
    n_after = np.add.reduceat(np.where(after, counts, 0), first)[:, None]
    n_before = np.add.reduceat(np.where(after, 0, counts), first)[:, None]
    out, into = pairs.sum(1)[:CLASSES], pairs.sum(0)[:CLASSES]
    return np.argmax(gain - (f(out + n_after) - f(out)) - (f(into + n_before) - f(into)), axis=1)


def assigned_in_parts(slots: np.ndarray, counts: np.ndarray, bounds: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """assigned() of some words at a time, with all slots of each: those that begin among the same SLOTS ones."""
    cuts = np.append(np.flatnonzero(np.diff(bounds[:-1] // SLOTS, prepend=-1)), len(bounds) - 1)
    parts = [assigned(slots[bounds[i] : bounds[j]], counts[bounds[i] : bounds[j]], bounds[i:j] - bounds[i], pairs) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def assign(neighbours: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(w, class) from (w, slot, n)."""

    def choose(frames):
        for x in frames:
            sizes = x["slots"].map(len).to_numpy()
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            slots, ns = np.concatenate(x["slots"].to_list()), np.concatenate(x["ns"].to_list()).astype(float)
            yield pd.DataFrame({"w": x["w"], "class": assigned_in_parts(slots, ns, bounds, pairs)})

    lists = neighbours.groupBy("w").agg(F.collect_list(F.struct("slot", "n")).alias("x")).select("w", F.col("x.slot").alias("slots"), F.col("x.n").alias("ns"))
    return lists.mapInPandas(choose, "w long, class long")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learns from all rows of docs.  An empty table gives a model that knows no word.

    Null and empty texts are one token, their end; repeated rows count again.
    """
    spark = docs.sparkSession
    counts = stored(count_keys(docs, text, lambda s: tokens(s)[0]), "word-counts")
    all_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot, hot_n = most_frequent(counts)
    core = np.sort(hot[:CORE])
    order = np.argsort(hot)
    hot, hot_n = hot[order], hot_n[order]
    other = len(core)
    sent = spark.sparkContext.broadcast((core, hot))

    def core_ids(values: np.ndarray) -> np.ndarray:
        at, there = lookup(sent.value[0], values)
        return np.where(there, at, other)

    def pairs_of(s: textvec.Slice) -> np.ndarray:
        values, bounds = tokens(s)
        ids = core_ids(values)
        return (before_each(ids, bounds, core_ids(np.array([END]))[0]) * (other + 1) + ids).astype(np.uint64)

    bigrams = count_keys(docs, text, pairs_of).select(F.expr(f"key div {other + 1}").alias("a"), (F.col("key") % (other + 1)).alias("b"), "n")
    ranks = np.empty(other, np.int64)  # classes begin with the words dealt by how frequent they are
    ranks[np.argsort(-hot_n[np.searchsorted(hot, core)], kind="stable")] = np.arange(other)
    classes, pairs, likelihood = exchange(stored(bigrams, "word-pairs"), other, ranks % CLASSES)

    slots, with_other = 2 * (CLASSES + 1), np.append(classes, CLASSES)

    def neighbours_of(s: textvec.Slice) -> np.ndarray:
        """For every word that is not of the core: (its place among the hot words, or its bin) and a slot."""
        values, bounds = tokens(s)
        ids = core_ids(values)
        named = with_other[ids]
        at, there = lookup(sent.value[1], values)
        unit = np.where(there, at, len(sent.value[1]) + (values & np.uint64(BINS - 1)).astype(np.int64))
        left = before_each(named, bounds, with_other[core_ids(np.array([END]))[0]])
        right = np.roll(named, -1)
        own = np.flatnonzero(ids == other)  # the last token of a text is an end, so what is to the right is in the text
        if not len(sent.value[0]) or END not in sent.value[0]:
            right[bounds[1:] - 1] = CLASSES
        return np.concatenate((unit[own] * slots + left[own], unit[own] * slots + CLASSES + 1 + right[own])).astype(np.uint64)

    near = count_keys(docs, text, neighbours_of).select(F.expr(f"key div {slots}").alias("w"), (F.col("key") % slots).alias("slot"), "n")
    found = assign(near, pairs).toArrow()  # HOT + BINS rows at most
    usual = int(np.argmax(pairs.sum(0)[:CLASSES]))  # of endings that no word has
    every = np.full(len(hot) + BINS, usual)
    every[np.searchsorted(hot, core)] = classes
    every[found["w"].to_numpy()] = found["class"].to_numpy()
    hot_classes, bin_classes = every[: len(hot)], every[len(hot) :]
    sent_classes = spark.sparkContext.broadcast((hot_classes, bin_classes))

    def class_pairs_of(s: textvec.Slice) -> np.ndarray:
        values, bounds = tokens(s)
        named = class_ids(values, sent.value[1], *sent_classes.value)
        end = class_ids(np.array([END]), sent.value[1], *sent_classes.value)[0]
        return (before_each(named, bounds, end) * CLASSES + named).astype(np.uint64)

    pairs = np.zeros((CLASSES, CLASSES))
    for r in count_keys(docs, text, class_pairs_of).collect():  # CLASSES squared rows at most
        pairs[r["key"] // CLASSES, r["key"] % CLASSES] = r["n"]
    of_bins = counts.groupBy(F.col("key").bitwiseAND(F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("words")).collect()  # BINS rows at most
    words = np.zeros(BINS, np.int64)
    words[[r["bin"] for r in of_bins]] = [r["words"] for r in of_bins]
    words -= np.bincount((hot & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    types = np.bincount(hot_classes, minlength=CLASSES) + np.bincount(bin_classes, weights=words, minlength=CLASSES)
    return Model(hot, hot_n, hot_classes, bin_classes, types, pairs, int(all_["n"]), int(all_["v"]), counts, likelihood)


SCORED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("perplexity", T.DoubleType()),
    ]
)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds SCORED to each row: log10 probabilities by the unigram base and by the model.

    Null and empty texts are one token, the end.  Repeated rows score alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {f.name for f in SCORED}))
    others, weight_of, known_of = (fresh(docs, c) for c in ("rare", "rare_weight", "rare_known"))
    partial = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField(others, T.ArrayType(T.LongType()))])

    def compute(s: textvec.Slice) -> list:
        m = sent.value
        values, bounds = tokens(s)
        classes = class_ids(values, m["hot"], m["hot_classes"], m["bin_classes"])
        before = before_each(classes, bounds, class_ids(np.array([END]), m["hot"], m["hot_classes"], m["bin_classes"])[0])
        at, there = lookup(m["hot"], values)
        weight = np.log10((m["hot_counts"][at] if len(m["hot"]) else np.zeros(len(at))) + ADD) * there
        base = weight - m["base_room"]
        own = weight - m["room"][classes] + m["moves"][before, classes]
        rare = textvec.as_long(values[~there])
        rare_bounds = np.concatenate(([0], np.cumsum(~there)))[bounds]
        return [
            np.diff(bounds),
            textvec.per_row(there, bounds),
            np.add.reduceat(base, bounds[:-1]),
            np.add.reduceat(own, bounds[:-1]),
            pa.ListArray.from_arrays(pa.array(rare_bounds.astype(np.int32)), pa.array(rare)),
        ]

    row = fresh(docs, "row_no")
    first = stored(add_columns(docs.withColumn(row, F.monotonically_increasing_id()), text, partial, compute, drop_text=True), "scored")
    rare = first.select(F.col(row), F.explode(others).alias("key")).groupBy("key", row).agg(F.count("*").alias("tf"))
    found = rare.join(model.counts, "key", "left").select(row, "tf", F.coalesce("n", F.lit(0)).alias("n"))
    sums = found.groupBy(row).agg(F.sum(F.col("tf") * F.log10(F.col("n") + ADD)).alias(weight_of), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias(known_of))
    joined = first.join(sums, row, "left")
    weight, known = F.coalesce(weight_of, F.lit(0.0)), F.coalesce(known_of, F.lit(0))
    out = {"n_known": F.col("n_known") + known, "base_score": F.col("base_score") + weight, "score": F.col("score") + weight}
    return joined.withColumns(out).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).drop(others, weight_of, known_of, row)
