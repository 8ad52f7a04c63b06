"""Token windows: fixed ones by expression, flexible ones at natural ends."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import for_workers

_TOKEN = re.compile(r"\s*\S+")
_PROTECTED = re.compile(
    r"\\begin\{(?P<env>equation|align|table|figure|tabular|algorithm)\*?\}.*?\\end\{(?P=env)\*?\}|\$\$.*?\$\$|(?:^[ \t]*\|.*\|[ \t]*(?:\n|$)){2,}",
    re.S | re.M,
)


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, tokens) windows of ``size`` white-space tokens, overlapping."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), 0)
    n = F.size(words)
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, size).alias("tokens"))))


def protected_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of tables, environments and display formulas, merged where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for m in _PROTECTED.finditer(text)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Kinds of natural ends, the one that is preferred last: no end, line, paragraph, sentence.
NO_END, LINE, PARAGRAPH, SENTENCE = range(4)


class Boundaries:
    """The tokens of a text with the kind of end behind each, and the span that must not be
    cut around it."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        begins = [b - len(text[a:b].lstrip()) for a, b in self.spans]
        self.kinds = np.zeros(len(self.spans) + 1, np.int8)
        for i, (_, b) in enumerate(self.spans[:-1]):
            gap = text[b : begins[i + 1]]
            self.kinds[i + 1] = SENTENCE if text[b - 1] in ".!?" else PARAGRAPH if gap.count("\n") > 1 else LINE if "\n" in gap else NO_END
        self.guards: dict[int, tuple[int, int]] = {}
        ends = [b for _, b in self.spans]
        for a, b in protected_spans(text):
            first, behind = bisect.bisect_right(ends, a), bisect.bisect_right(ends, b)
            self.guards.update(dict.fromkeys(range(first + 1, behind + 1), (first, behind)))

    def cut(self, start: int, size: int, overlap: int, flex: float) -> int:
        """Where a chunk from ``start`` on ends: at the last of the best natural ends in the
        flexible zone, else after ``size`` tokens; not within a protected span if that can be."""
        whole = start + size
        if whole >= len(self.spans):
            return len(self.spans)
        zone = self.kinds[start + int(size * (1 - flex)) + 1 : whole + 1]
        best = int(zone.max(initial=NO_END))
        end = whole if best == NO_END else whole - int(np.argmax(zone[::-1] == best))
        first, behind = self.guards.get(end, (end, end))
        if behind <= start + 2 * size:
            return behind
        return first if first > start + overlap else end


def flexible_chunks(text: str, size: int = 800, overlap: int = 100, flex: float = 0.15) -> list[tuple[int, int, str]]:
    """(first token, end token, text) of each chunk: windows of ``size`` tokens that end at
    natural ends within their last ``flex`` where there are any (sentences before paragraphs
    before lines), keep tables, environments and display formulas whole, and overlap."""
    b = Boundaries(text)
    total = len(b.spans)
    if total <= size:
        return [(0, total, text)] if total else []
    out, start, end = [], 0, 0
    while end < total:
        end = b.cut(start, size, overlap, flex)
        out.append((start, end, text[b.spans[start][0] : b.spans[end - 1][1]].strip()))
        start = max(end - overlap, start + 1)
    return out


@for_workers
def section_windows(pages: DataFrame, paper: str, page: str, section: str, text: str, size: int, overlap: int, flex: float = 0.15) -> DataFrame:
    """paper, chunk, section, pages, token_start, token_end, text: chunks of the papers' pages
    that never cross a section. Runs of pages of one section (null: preamble) are joined by
    line ends and chunked by themselves; chunks are numbered through each paper. Pages of a
    paper meet in one task; null texts count as empty."""
    kind = pages.schema[paper].dataType.simpleString()
    ordered = pages.groupBy(F.col(paper).alias("paper")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), F.coalesce(section, F.lit("preamble")).alias("section"), F.coalesce(text, F.lit("")).alias("text")))).alias("pages")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                number = 0
                for heading, group in itertools.groupby(held, key=lambda p: p["section"]):
                    group = list(group)
                    for a, z, t in flexible_chunks("\n".join(p["text"] for p in group), size, overlap, flex):
                        rows.append((name, number, heading, [p["page"] for p in group], a, z, t))
                        number += 1
            types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string()]
            names = ["paper", "chunk", "section", "pages", "token_start", "token_end", "text"]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return ordered.mapInArrow(run, f"paper {kind}, chunk int, section string, pages array<int>, token_start int, token_end int, text string")


@for_workers
def flexible_windows(rows: DataFrame, row_id: str, text: str, size: int, overlap: int, flex: float) -> DataFrame:
    """id, chunk, token_start, token_end, text for every row, in Arrow batches."""
    kind = rows.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (i, k, a, z, t)
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for k, (a, z, t) in enumerate(flexible_chunks(x, size, overlap, flex))
            ]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "chunk", "token_start", "token_end", "text"])

    return rows.where(F.col(text).isNotNull()).select(row_id, text).mapInArrow(run, f"id {kind}, chunk int, token_start int, token_end int, text string")
