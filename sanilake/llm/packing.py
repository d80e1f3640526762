"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id.  What is longer than a sequence is
cut, so that every piece has a length between 1 and the capacity: however many
documents there are, only the counts by length come to the driver, at most one
for each length.  From these counts a plan is made by linear grouping:

1. Large lengths are dealt by rank into groups of equal cardinality, and each is
   rounded up to the largest of its group.
2. For these few sizes the best configurations of a sequence are found: the
   linear program of cutting stock, by columns from a knapsack.
3. Configurations are filled with the actual lengths, rank by rank, all but the
   place of the smallest size: the room there is what the actual others leave.
4. These last large pieces, what no whole configuration takes, and all small
   ones go where the least room is left that fits, from the longest on.

The plan speaks of runs of equal pieces in runs of equal sequences, so its size
depends on the number of lengths, not of documents.  Pieces then find their
places by their number among the pieces of their length.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import bpe, textvec
from sanilake.llm.texts import fresh, stored

CACHED = 600_000  # words a worker remembers


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a sequence.  small: up to this length a piece is small.

    groups: how many sizes large lengths are rounded to, of at least
    `each` pieces.  columns: at most so many steps of the linear program, which
    is feasible after each; it also ends when as many as it has sizes bring nothing.
    """

    capacity: int = 2048
    small: int = 512
    groups: int = 160
    each: int = 8
    columns: int = 2000
    end_id: int = 0


# ---------------------------------------------------------------- tokens


class Encoder:
    """Token ids of whole texts, equal to the merge list's: words are looked up, new ones encoded once."""

    def __init__(self, path: str) -> None:
        self.list = bpe.load(path)
        self.words: dict[str, bytes] = {}
        by_rank = all(a < b for a, b in zip(self.list.made, self.list.made[1:], strict=False))
        ranks = {t: i for i, t in enumerate(self.list.bytes_of) if t and i not in set(self.list.special.values())}
        self.plain = tiktoken.Encoding("merges", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if by_rank else None

    def ids(self, text: str) -> bytes:
        return array("I", self.plain(text)).tobytes() if self.plain else self.list.encode(text)

    def new(self, word: str) -> bytes | None:
        """A word after a space; None if it isn't one that always begins and ends a piece."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        found = self.ids(" " + word)
        if len(word) <= 64:
            if len(self.words) >= CACHED:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        for part in self.list.split_special.split(text) if self.list.split_special else [text]:
            if part in self.list.special:
                out.append(array("I", [self.list.special[part]]).tobytes())
                continue
            first, *rest = part.split(" ")
            get = self.words.get
            each = [get(w) or self.new(w) for w in rest]
            if None in each or (rest and (not first or first[-1].isspace())):
                out.extend(self.ids(x) for x in self.list.chunks(part))  # spaces beside white space belong together
            else:
                out.append(self.ids(first))
                out.extend(each)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, rule: Packing = Packing(), text: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each piece: the columns of docs without the text, then piece, start, length, ids_crc32, and ids if kept.

    path: a tokenizers JSON file that every worker can open.  Null and empty
    texts are one piece, the end id.  Repeated rows are documents of their own.
    Input columns with these names give way.  An empty table has no pieces.
    """
    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields = [T.StructField(n, t) for n, t in made] + [T.StructField("ids", T.BinaryType())] * keep_ids
    taken = {f.name for f in fields}
    kept = [f for f in docs.schema if f.name.lower() not in taken and f.name != text]
    src, cap = fresh(docs, "text_in"), rule.capacity
    end = array("I", [rule.end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for s in textvec.slices(batch.column(batch.schema.get_field_index(src))):
                raw = s.data.tobytes()
                rows, cut = [], []
                for row, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
                    ids = words.encode(raw[a:b].decode(errors="replace")) + end
                    n = len(ids) // 4
                    at = [0, *range(n % cap or cap, n, cap), n]
                    for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                        part = ids[4 * lo : 4 * hi]
                        rows.append(row)
                        cut.append((k, lo, hi - lo, zlib.crc32(part), part if keep_ids else None))
                whole = batch.slice(s.lo, s.hi - s.lo).take(pa.array(rows, pa.int64()))
                columns = [whole.column(whole.schema.get_field_index(f.name)) for f in kept]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns += [pa.array([x[i] for x in cut], kinds[i]) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*kept, *fields]])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias(src)).mapInArrow(run, T.StructType([*kept, *fields]))


# ---------------------------------------------------------------- the plan


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: how often each size is in it."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (s, y) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if y <= 1e-12:
            continue
        for _ in range(capacity // s):
            more = best[:-s] + y
            better = np.flatnonzero(more > best[s:] + 1e-12) + s
            if not len(better):
                break
            taken[i, better] = taken[i, better - s] + 1
            best[better] = more[better - s]
    count, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        count[i] = taken[i, room]
        room -= int(count[i] * sizes[i])
    return float(count @ worth), count


def configurations(sizes: np.ndarray, demand: np.ndarray, rule: Packing) -> list[tuple[np.ndarray, int]]:
    """(how often each size, how many sequences): the linear program's solution, rounded down."""
    n = len(sizes)
    basis = np.diag(rule.capacity // sizes).astype(float)  # a column for each configuration
    inverse = np.linalg.inv(basis)
    amount = inverse @ demand
    least, idle = np.inf, 0
    for step in range(rule.columns):
        value, column = knapsack(sizes, inverse.sum(axis=0), rule.capacity)
        idle = 0 if amount.sum() < least - 1e-6 else idle + 1
        least = min(least, amount.sum())
        if value <= 1 + 1e-7 or idle > n:
            break
        d = inverse @ column
        ratio = np.full(n, np.inf)
        np.divide(amount, d, out=ratio, where=d > 1e-9)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
        amount = np.maximum(inverse @ demand, 0)
    left, found = demand.copy(), []
    for k in np.argsort(-amount):
        column = np.rint(basis[:, k]).astype(np.int64)
        inside = column > 0
        times = min(int(amount[k] + 1e-6), int((left[inside] // column[inside]).min()))
        if times > 0:
            found.append((column, times))
            left = left - times * column
    return found


class Plan:
    """Places of runs of equal pieces.

    A run is (length, first, count, sequence, each, offset): of the pieces of
    that length, numbers first to first + count go into sequences from
    `sequence` on, `each` of them in one, side by side from offset on.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
        self.rooms: list[int] = []
        self.next = Counter()

    def leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self.room[room]:
                insort(self.rooms, room)
            self.room[room].append((first, count))

    def take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.next[length], count, sequence, each, offset))
        self.next[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def fill(self, slots: list[list[tuple[int, int]]], times: int) -> None:
        """New sequences with a piece for each slot, whose actual lengths come as runs (length, count)."""
        first, done = self.open(times), 0
        queues = [list(reversed(x)) for x in slots]
        while done < times:
            step, offset = min(q[-1][1] for q in queues), 0
            for q in queues:
                length, count = q.pop()
                self.take(length, step, first + done, 1, offset)
                offset += length
                if count > step:
                    q.append((length, count - step))
            self.leave(self.capacity - offset, first + done, step)
            done += step

    def best_fit(self, length: int, count: int) -> None:
        """Pieces of one length: each where the least room is left that fits."""
        while count:
            k = bisect_left(self.rooms, length)
            if k < len(self.rooms):
                room = self.rooms[k]
                first, many = self.room[room].pop()
                if not self.room[room]:
                    del self.rooms[k]
            else:
                room, many = self.capacity, -(-count // (self.capacity // length))
                first = self.open(many)
            each, offset = room // length, self.capacity - room
            full = min(many, count // each)
            if full:
                self.take(length, full * each, first, each, offset)
                self.leave(room - each * length, first, full)
                count -= full * each
            if full < many:
                if count:  # fewer than fill one more
                    self.take(length, count, first + full, count, offset)
                    self.leave(room - count * length, first + full, 1)
                    full, count = full + 1, 0
                self.leave(room, first + full, many - full)


def plan(counts: dict[int, int], rule: Packing = Packing()) -> Plan:
    """Where the pieces go, from how many there are of each length (1 to the capacity)."""
    out = Plan(rule.capacity)
    whole = counts.get(rule.capacity, 0)
    if whole:
        out.take(rule.capacity, whole, out.open(whole), 1, 0)
    large = [(s, counts[s]) for s in sorted(counts, reverse=True) if rule.small < s < rule.capacity and counts[s]]
    total = sum(n for _, n in large)
    if total:
        groups, at = [], 0  # of equal cardinality by rank: runs (length, count), the longest first
        many = max(1, min(rule.groups, total // rule.each))
        edges = [total * k // many for k in range(1, many + 1)]
        queue = list(reversed(large))
        for edge in dict.fromkeys(edges):
            own = []
            while at < edge:
                s, n = queue.pop()
                m = min(n, edge - at)
                own.append((s, m))
                at += m
                if n > m:
                    queue.append((s, n - m))
            if groups and own and groups[-1][0][0] == own[0][0]:  # the same size: one group
                groups[-1] += own
            elif own:
                groups.append(own)
        sizes = np.array([g[0][0] for g in groups])
        demand = np.array([sum(n for _, n in g) for g in groups])
        queues = [list(reversed(g)) for g in groups]
        for column, times in configurations(sizes, demand, rule):
            slots = []
            parts = np.repeat(np.arange(len(column)), column).tolist()
            if len(parts) == 1:  # nothing stands beside it: it is placed with the rest
                continue
            for g in parts[:-1]:
                own, need = [], times
                while need:
                    s, n = queues[g].pop()
                    m = min(n, need)
                    own.append((s, m))
                    need -= m
                    if n > m:
                        queues[g].append((s, n - m))
                slots.append(own)
            out.fill(slots, times)
    for s in sorted((s for s in counts if s < rule.capacity), reverse=True):
        if left := counts[s] - out.next[s]:
            out.best_fit(s, left)
    return out


# ---------------------------------------------------------------- places


def place(cut: DataFrame, rule: Packing = Packing()) -> DataFrame:
    """Adds sequence_id and offset to the pieces of pieces().

    Pieces are written to the shared folder with their number among those of
    their length in their task; counts by task and length give the numbers over
    all.  No length, however common, is gathered in one task.
    """
    length, part, no = "length", fresh(cut, "part_no"), fresh(cut, "own_no")
    names = [f.name for f in cut.schema if f.name not in ("sequence_id", "offset")]
    schema = T.StructType([f for f in cut.schema if f.name in names] + [T.StructField(part, T.IntegerType()), T.StructField(no, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(rule.capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(length)).to_numpy()
            order = np.argsort(sizes, kind="stable")
            in_order = sizes[order]
            first = np.searchsorted(in_order, in_order)
            own = np.empty(len(sizes), np.int64)
            own[order] = np.arange(len(sizes)) - first + seen[in_order]
            seen += np.bincount(sizes, minlength=rule.capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), task, np.int32)), pa.array(own)], names=[*batch.schema.names, part, no])

    rows = stored(cut.select(*names).mapInArrow(number, schema), "pieces")
    tasks = rows.groupBy(length, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(length, part, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    counts = {r[0]: r[1] for r in tasks.groupBy(length).agg(F.sum("n")).collect()}  # at most one row for each length
    runs = np.array(sorted(plan(counts, rule).runs), np.int64).reshape(-1, 6)
    base = np.concatenate(([0], np.cumsum(np.bincount(runs[:, 0], runs[:, 2], rule.capacity + 1).astype(np.int64))))
    begins = base[runs[:, 0]] + runs[:, 1]
    at = fresh(rows, "n_before")
    numbered = rows.join(tasks.select(length, part, F.col("n_before").alias(at)), [length, part])
    final = T.StructType([f for f in cut.schema if f.name in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            sizes, mine = value[length].to_numpy(), value[no].to_numpy() + value[at].to_numpy()
            run = runs[np.searchsorted(begins, base[sizes] + mine, "right") - 1]
            k = mine - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(value[n] for n in names), pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * sizes)], names=[f.name for f in final])

    return numbered.mapInArrow(look_up, final)


def sequences(packed: DataFrame) -> DataFrame:
    """A row for each sequence: sequence_id, n_pieces, n_tokens and its ids, from placed pieces that kept theirs."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    each = packed.groupBy("sequence_id").agg(inside.alias("inside"))
    joined = F.aggregate("inside.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return each.select("sequence_id", F.size("inside").cast("long").alias("n_pieces"), F.aggregate("inside.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), joined.alias("ids"))
