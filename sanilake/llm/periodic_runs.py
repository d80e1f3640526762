"""Periodic runs of words: stretches that say the same thing three times or more.

A run is a stretch of consecutive words with smallest period q, at least
`exponent` periods and `least` words long, that no neighbouring word extends.
Such a stretch equals itself q words on over its length less q.  The least such
overlap over all periods is k, so each word of a run lies in a k-gram that the
document has twice.  Words outside repeated k-grams can't join runs and are
masked; in what survives, k-grams that don't repeat within their own segment
are masked in the same way.  Main and Lorentz's divide and conquer then finds
the runs of the segments that are left: it looks on either side of the middle
for repetitions that cross it, by prefix (Z) tables, in n log n steps.

Masking compares 64-bit values of words, which can only leave more words than
need be; runs are found on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.texts import add_columns


@dataclass(frozen=True)
class RunRule:
    """least: words of a run.  exponent: whole periods that it has at least, 2 or more."""

    least: int = 24
    exponent: int = 3

    @property
    def k(self) -> int:
        """The least overlap of a run with itself, over all periods."""
        return min(max(self.least, self.exponent * q) - q for q in range(1, self.least + 1))


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("top_run", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
)


# ---------------------------------------------------------------- masking


def segments(values: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches of words in k-grams that occur twice with the same owner.

    owner: a number for each word, the same for words that belong together,
    which stand side by side.
    """
    n = len(values)
    if n <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n - k + 1, np.uint64)
    for j, c in enumerate(textvec.seeded(k, 11) | np.uint64(1)):
        grams += values[j : n - k + 1 + j] * c
    first = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    grams = textvec.mix(grams[first] ^ textvec.mix((owner[first] + 1).astype(np.uint64)))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first[twice], 1)
    np.add.at(steps, first[twice] + k, -1)
    inside = np.cumsum(steps[:-1]) > 0
    begins = inside & np.append(True, ~inside[:-1] | (owner[1:] != owner[:-1]))
    ends = inside & np.append(~inside[1:] | (owner[1:] != owner[:-1]), True)
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def surviving(values: np.ndarray, rows: np.ndarray, rule: RunRule) -> list[tuple[int, int]]:
    """The segments that can hold runs: masked until hardly a word goes any more."""
    where, owner = np.arange(len(values)), rows
    first, end = segments(values, owner, rule.k)
    while True:
        long = end - first >= rule.least
        first, end = where[first[long]], where[end[long] - 1] + 1
        sizes = end - first
        left = int(sizes.sum())
        if left > 0.9 * len(where) or not left:
            return list(zip(first.tolist(), end.tolist(), strict=True))
        owner = np.repeat(np.arange(len(first)), sizes)
        where = np.arange(left) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
        first, end = segments(values[where], owner, rule.k)


# ---------------------------------------------------------------- Main and Lorentz


def common_prefixes(pattern: Sequence[int], text: Sequence[int]) -> list[int]:
    """For each place of text: how long it agrees with the start of pattern."""
    whole = [*pattern, -1, *text]
    n, lo, hi = len(whole), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and whole[k] == whole[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z[len(pattern) + 1 :]


def crossing(words: list[int], lo: int, mid: int, hi: int, rule: RunRule) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches within lo to hi, long enough, that cross the middle."""
    most = (hi - lo) // rule.exponent  # the longest period
    left, right = words[lo:mid], words[mid:hi]
    back = left[::-1]
    q_right, q_left = min(most, len(right)), min(most, len(left))
    # a whole period right of the middle: how far it goes on beyond itself, and back beyond the middle
    onward = common_prefixes(right, right[1 : q_right + 1] + right[q_right + 1 :])
    behind = common_prefixes(back, (left + right[:q_right])[::-1])  # at q_right - q: back from mid + q
    for q in range(1, q_right + 1):
        end = mid + q + (onward[q - 1] if q < len(right) else 0)
        start = mid - min(behind[q_right - q], mid - lo)
        if end - start >= max(rule.least, rule.exponent * q):
            yield start, end, q
    # a whole period left of it
    ahead = common_prefixes(right, words[mid - q_left : hi])  # at q_left - q: from mid - q
    before = common_prefixes(back, back[1:])
    for q in range(1, q_left + 1):
        end = mid + min(ahead[q_left - q], hi - mid)
        start = mid - q - (before[q - 1] if q < len(left) else 0)
        if end - start >= max(rule.least, rule.exponent * q):
            yield start, end, q


def find_runs(words: list[int], rule: RunRule = RunRule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of numbers from 0 on, by start, then period."""
    n, found, todo = len(words), {}, [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < rule.least:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        for start, end, q in crossing(words, lo, mid, hi, rule):
            goes_on = start and words[start - 1] == words[start - 1 + q] or end < n and words[end] == words[end - q]
            if not goes_on:  # a stretch with several periods has its smallest only
                found[start, end - start] = min(q, found.get((start, end - start), q))
    return sorted((s, length, q) for (s, length), q in found.items())


# ---------------------------------------------------------------- texts


def top(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact exponent; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, text: str = "text", rule: RunRule = RunRule()) -> DataFrame:
    """Adds FIELDS to each row: its runs, the one of greatest exponent, and the text with each run said once.

    Words are `[^\\x20\\x09-\\x0D]+`, counted from 0.  collapsed: the words that no
    run has after its first period, joined by one space.  Null, empty and blank
    texts: no words, no runs, top_run null, collapsed empty.  Repeated rows each
    get the same result.  An empty table stays empty.  One pass over whole
    texts, without a shuffle; a very long text is a matter of its own task.
    """

    def compute(s: textvec.Slice) -> list:
        w = textvec.words(s, textvec.NOT_SPACE, fold=False)
        raw, bounds = s.data.tobytes(), w.bounds.tolist()
        in_row: dict[int, list[tuple[int, int]]] = {}
        for first, end in surviving(w.values, w.rows, rule):
            in_row.setdefault(int(np.searchsorted(w.bounds, first, "right")) - 1, []).append((first, end))
        runs: list[list[dict]] = []
        tops: list[dict | None] = []
        texts: list[str] = []
        named = lambda run: dict(zip(("start", "length", "period"), run, strict=True))
        for row, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
            words, own = raw[a:b].split(), []
            for first, end in in_row.get(row, ()):
                number: dict[bytes, int] = {}
                at = first - bounds[row]
                part = [number.setdefault(x, len(number)) for x in words[at : end - bounds[row]]]
                own += [(start + at, length, q) for start, length, q in find_runs(part, rule)]
            if own:
                steps = np.zeros(len(words) + 1, np.int64)
                for start, length, q in own:
                    steps[start + q] += 1
                    steps[start + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
            best = top(own)
            runs.append([named(x) for x in own])
            tops.append(named(best) if best else None)
            texts.append(b" ".join(words).decode(errors="replace"))
        kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        return [w.counts, pa.array(runs, pa.list_(kind)), pa.array(tops, kind), pa.array(texts, pa.string())]

    return add_columns(docs, text, FIELDS, compute)
