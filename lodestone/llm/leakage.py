"""Evaluation passages in a corpus, by Wu-Manber search over words.

Every run of 12 words of an item is a search string. Words are the symbols; blocks of three
words carry the shift table, so that impossible positions are skipped, up to a whole run at a
time. A block with shift 0 names a bucket of strings with that suffix, the hash of the run
selects among them, and a direct comparison confirms each occurrence. The tables are flat
arrays that are built once and sent to the workers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.lookalikes import _quoted, duckdb_map, form_sql
from lodestone.session import cut, for_workers

RUN = 12
BLOCK = 3
#: Words of items that are searched for at once; more are searched for in further passes.
WORDS_PER_PASS = 2_000_000

# Markup that may stand between words - tags, commands, character entities.
MARKUP = r"</?[A-Za-z][^<>]{0,200}>|\\[A-Za-z]+\*?|&(?:[A-Za-z]{2,10}|#[0-9]{2,6});"


def words_sql(text: str) -> str:
    """A DuckDB expression: the words of a text in its consistent form, lower case, joined
    by single spaces. Markup, punctuation and line breaks are gone."""
    plain = f"regexp_replace({form_sql(text)}, {_quoted(MARKUP)}, ' ', 'g')"
    return f"trim(regexp_replace(lower({plain}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_WHOLE = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15
#: Entries of the shift table, one byte each. Blocks that share one get the smaller shift.
SHIFTS = 1 << 22


def _hash(ids: Iterable[int]) -> int:
    h = 0
    for i in ids:
        h = ((h ^ (i + 1)) * _FACTOR) & _WHOLE
        h ^= h >> 29
    return h


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` ids."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1))) * np.uint64(_FACTOR)
        h ^= h >> np.uint64(29)
    return h


class WordSearch:
    """Wu-Manber tables for all runs of ``run`` words of the given items: about 40 bytes a
    word and 4 MB for the shifts, beside the items' vocabulary."""

    def __init__(self, items: Iterable[tuple[object, list[str]]], run: int = RUN, block: int = BLOCK):
        self.run, self.block = run, min(block, run)
        self.far = run - self.block + 1
        self.ids: dict[str, int] = {}
        self.items: list[object] = []
        b, shift = self.block, np.full(SHIFTS, min(255, self.far), np.uint8)
        parts, ends, owners, blocks, runs, at = [], [], [], [], [], 0
        for item, words in items:
            if len(words) < run:
                continue
            ids = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), np.int32, len(words))
            of_block, of_run = _hashes(ids, b), _hashes(ids, run)
            # A block that ends k words into a run may be shifted by the run's other words; all
            # blocks but the first few of an item end a run themselves.
            for k in range(b, run):
                i = int(of_block[k - b] & np.uint64(SHIFTS - 1))
                shift[i] = min(int(shift[i]), run - k)
            last = of_block[run - b :]
            shift[(last & np.uint64(SHIFTS - 1)).astype(np.int64)] = 0
            parts.append(ids)
            ends.append(np.arange(at + run, at + len(ids) + 1))
            owners.append(np.full(len(last), len(self.items), np.int32))
            blocks.append(last)
            runs.append(of_run)
            self.items.append(item)
            at += len(ids)
        none = np.zeros(0, np.int64)
        self.flat = np.concatenate(parts) if parts else none
        block_of = np.concatenate(blocks) if blocks else none.astype(np.uint64)
        order = np.argsort(block_of, kind="stable")
        self.suffixes = block_of[order]
        self.runs = (np.concatenate(runs) if runs else none.astype(np.uint64))[order]
        self.ends = (np.concatenate(ends) if ends else none)[order]
        self.owners = (np.concatenate(owners) if owners else none)[order]
        self.shift = shift.tobytes()

    def found(self, words: list[str]) -> set:
        """The items of which a run stands in ``words``."""
        out: set = set()
        b, run, get, shift, mask = self.block, self.run, self.ids.get, self.shift, SHIFTS - 1
        end, n = run, len(words)
        while end <= n:
            # A word that no item has rules out every run over it.
            key = [get(w) for w in words[end - b : end]]
            if None in key:
                end += run - key[::-1].index(None)
                continue
            h = _hash(key)
            step = shift[h & mask]
            if step:
                end += step
                continue
            low, high = np.searchsorted(self.suffixes, np.uint64(h), "left"), np.searchsorted(self.suffixes, np.uint64(h), "right")
            if low < high:
                ids = [get(w) for w in words[end - run : end]]
                if None not in ids:
                    for k in low + np.flatnonzero(self.runs[low:high] == np.uint64(_hash(ids))):
                        stop = self.ends[k]
                        if self.flat[stop - run : stop].tolist() == ids:
                            out.add(self.items[self.owners[k]])
            end += 1
        return out


def _passes(items: DataFrame, item_id: Column, text: Column, run: int) -> Iterator[list]:
    """Blocks of (id, words) of bounded size, by way of the driver: the query set alone. An
    item longer than a block goes in overlapping parts."""
    kind = items.select(item_id.alias("id")).schema["id"].dataType.simpleString()
    rows = items.select(item_id.alias("id"), text.cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    words = rows.mapInArrow(duckdb_map(f"SELECT id, {words_sql('text')} AS w FROM batch"), f"id {kind}, w string")
    held, size = [], 0
    for r in words.toLocalIterator():
        whole = r["w"].split(" ")
        for at in range(0, max(1, len(whole) - run + 1), WORDS_PER_PASS):
            w = whole[at : at + WORDS_PER_PASS + run - 1]
            if len(w) >= run:
                held.append((r["id"], w))
                size += len(w)
                if size >= WORDS_PER_PASS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


@for_workers
def leaked_items(
    documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, run: int = RUN
) -> DataFrame:
    """id, item: the documents that share ``run`` consecutive words with an item, once each.

    Words are maximal runs of letters and digits, lower-cased, of the texts in their
    consistent form. Null and shorter texts have none. Null item ids take no part. The items
    are the query set: they are searched for in passes of at most WORDS_PER_PASS words, each
    over all documents, so what is sent to the workers is bounded. Repeated documents and
    items give one row. Other columns play no part.
    """
    id_type = documents.select(doc_id.alias("id")).schema["id"].dataType
    item_type = items.select(item_id.alias("id")).schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("item", item_type)])
    rows = documents.select(doc_id.alias("id"), text.cast("string").alias("text")).where("text IS NOT NULL")
    spark = documents.sparkSession
    item_arrow = to_arrow_type(item_type)
    normal = duckdb_map(f"SELECT id, {words_sql('text')} AS w FROM batch")
    blocks = _passes(items, item_id, item_text, run)
    block, following = next(blocks, None), next(blocks, None)
    if following is not None:  # several passes: the corpus is brought to its form once
        rows = cut(rows.mapInArrow(normal, T.StructType([T.StructField("id", id_type), T.StructField("w", T.StringType())])))
        normal = iter
    out = None
    while block is not None:
        sent = spark.sparkContext.broadcast(WordSearch(block, run))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            for b in normal(batches):
                ids, found = [], []
                for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    hit = tables.found(w.split(" "))
                    ids.extend([i] * len(hit))
                    found.extend(hit)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, b.schema.field(0).type), pa.array(found, item_arrow)], names=["id", "item"]
                    )

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
        block, following = following, next(blocks, None)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.distinct()
