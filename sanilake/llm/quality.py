"""Quality rules by compression bands.

zstandard is run over each whole document and over its fixed chunks.  Text that
says the same thing again compresses to far less than prose of its length, and
random or encoded data to far more.  How far prose compresses depends on its
length, so the limits are given by length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.texts import add_columns


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size, by size in bytes.

    Each row is (from this many bytes, lowest ratio, highest ratio).  In the
    shortest texts headers of the format outweigh what the text shows, so
    their bands are wide.  A document is also rejected if more than bad_share
    of its bytes are in chunks that lie outside the band of a whole text
    of the chunk's size, widened by chunk_slack.  The last chunk is what is left.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.25, 20.0),
        (25, 0.40, 1.75),
        (50, 0.45, 1.40),
        (100, 0.50, 1.20),
        (200, 0.48, 0.95),
        (400, 0.46, 0.80),
        (800, 0.42, 0.72),
        (1600, 0.39, 0.66),
        (3200, 0.36, 0.60),
        (6400, 0.33, 0.58),
    )
    chunk_bytes: int = 4096
    chunk_slack: float = 0.05
    bad_share: float = 0.34
    level: int = 3
    min_words: int = 20
    max_repeat: float = 0.30

    def of(self, size: int) -> tuple[float, float]:
        low, high = 0.0, float("inf")
        for least, a, b in self.limits:
            if size >= least:
                low, high = a, b
        return low, high


FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("bad_chunks", T.LongType()),
        T.StructField("verdict", T.StringType()),
    ]
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.uint64(0xA24BAED4963EE407)


def _distinct_in_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return textvec.mix(values ^ textvec.mix((rows + 1).astype(np.uint64) * _LINE))


def dup_lines(s: textvec.Slice, w: textvec.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    n = len(s.offsets) - 1
    breaks = np.flatnonzero(s.data == 10)
    starts = np.unique(np.concatenate((s.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(s.data)]
    rows = np.searchsorted(s.offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(s.data)), s.offsets[rows + 1])
    at_break = (ends > starts) & (s.data[np.maximum(ends - 1, 0)] == 10)
    ends = ends - at_break
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, rows = starts[worded], ends[worded], rows[worded]
    keys = _distinct_in_row(textvec.span_values(s.data, starts, ends), rows)
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def repeat_words(w: textvec.Words, k: int = 8) -> np.ndarray:
    """Words inside k-word windows that their row has twice or more."""
    first, values = textvec.windows(w, k)
    rows = w.rows
    keys = _distinct_in_row(values, rows[first])
    in_order = np.sort(keys)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    steps = np.zeros(len(w.values) + 1, np.int64)
    if len(twice):
        hit = first[np.isin(keys, twice)]
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + k, -1)
    return textvec.per_row(np.cumsum(steps[:-1]) > 0, w.bounds)


def judge(raw: memoryview, zstd: zstandard.ZstdCompressor, bands: Bands) -> tuple[float | None, int, str]:
    """Ratio of the whole text, chunks outside their band, and the verdict."""
    size = len(raw)
    if not size:
        return None, 0, "ok"
    ratio = len(zstd.compress(raw)) / size
    low, high = bands.of(size)
    bad = bad_bytes = 0
    for at in range(0, size, bands.chunk_bytes):
        chunk = raw[at : at + bands.chunk_bytes]
        r = ratio if len(chunk) == size else len(zstd.compress(chunk)) / len(chunk)
        low_c, high_c = bands.of(len(chunk))
        if not low_c - bands.chunk_slack <= r <= high_c + bands.chunk_slack:
            bad, bad_bytes = bad + 1, bad_bytes + len(chunk)
    if ratio < low:
        return ratio, bad, "repetitive"
    if ratio > high:
        return ratio, bad, "incompressible"
    return ratio, bad, "chunks" if bad_bytes > bands.bad_share * size else "ok"


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Adds FIELDS to each row of docs.

    Null and empty texts: no words, base_failed, not kept, ratio null.
    Repeated rows each get the same verdict.  An empty table stays empty.
    """

    def compute(s: textvec.Slice) -> list:
        w = textvec.words(s, textvec.NOT_SPACE, fold=False)
        n, repeat = w.counts, repeat_words(w)
        inside = np.zeros(len(s.data) + 1, np.int8)
        inside[w.starts] += 1
        inside[w.ends] -= 1
        in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
        failed = (n < bands.min_words) | (100 * repeat > 100 * bands.max_repeat * n)
        zstd = zstandard.ZstdCompressor(level=bands.level)
        raw = memoryview(np.ascontiguousarray(s.data))
        seen = [judge(raw[a:b], zstd, bands) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
        ok = np.array([x[2] == "ok" for x in seen], bool)
        return [
            n,
            textvec.per_row(in_word & ((s.data & 0xC0) != 0x80), s.offsets),
            textvec.per_row(_SYMBOL[s.data], s.offsets),
            dup_lines(s, w),
            repeat,
            failed,
            ~failed & ok,
            [x[0] for x in seen],
            np.array([x[1] for x in seen], np.int64),
            [x[2] for x in seen],
        ]

    return add_columns(docs, text, FIELDS, compute)
