"""Bounded samples of distinct texts, the same whatever the order and the number of copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sample(rows: DataFrame, text: Column, size: int) -> list[str]:
    """The ``size`` distinct texts whose hashes are least, in the order of their hashes. Each
    task passes on at most ``size`` of them, so a text with many copies counts once and
    nothing unbounded is gathered. Null texts are left out."""
    hashed = rows.select(text.alias("text")).where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), "text")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, str] = {}
        bound = None
        for b in batches:
            h = b.column(0).to_numpy()
            at = np.flatnonzero(h <= bound) if bound is not None else np.arange(len(h))
            held.update(zip(h[at].tolist(), b.column(1).take(pa.array(at)).to_pylist()))
            if len(held) > 2 * size:
                held = dict(sorted(held.items())[:size])
                bound = max(held)
        kept = sorted(held.items())[:size]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string())], names=["h", "text"])

    found = hashed.mapInArrow(least, "h long, text string").distinct().orderBy("h", "text").limit(size)
    return [r["text"] for r in found.collect()]
