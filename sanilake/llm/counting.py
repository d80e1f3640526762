"""Counts of 64-bit keys: merged within each task first, then by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanilake.llm import textvec

PENDING = 1 << 22  # keys a task holds before it merges or hands them on


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of keys, in memory bounded by PENDING."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(keys):
            part = np.unique(keys, return_counts=True)
            self.parts.append(part)
            self.held += len(part[0])
        if self.held > PENDING:
            keys, counts = self.merge()
            if len(keys) > PENDING // 2:
                yield keys, counts
            else:
                self.parts, self.held = [(keys, counts)], len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([x[0] for x in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([x[1] for x in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.parts, self.held = [], 0
        return merged(keys, counts) if len(keys) else (keys, counts)


def count_keys(docs: DataFrame, text: str, keys_of: Callable[[textvec.Slice], np.ndarray]) -> DataFrame:
    """(key, n) over the keys of all texts.  An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(textvec.as_long(part[0])), pa.array(part[1].astype(np.int64))], names=["key", "n"])

        tally = Tally()
        for batch in batches:
            for s in textvec.slices(batch.column(0)):
                for part in tally.add(keys_of(s)):
                    yield rows(part)
        last = tally.merge()
        if len(last[0]):
            yield rows(last)

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
