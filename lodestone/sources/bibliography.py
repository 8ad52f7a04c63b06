"""BibTeX text as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,", re.S)
_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*")


def _value(text: str, at: int) -> tuple[str, int]:
    """A braced, quoted or bare field value from a position on, and where it ends."""
    if at < len(text) and text[at] in '{"':
        quote, depth, i = text[at] == '"', 0, at
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0 and not quote:
                    return text[at + 1 : i], i + 1
            elif c == '"' and quote and depth == 0 and i > at:
                return text[at + 1 : i], i + 1
            i += 1
        return text[at + 1 :], len(text)
    m = re.compile(r"[^,}\n]*").match(text, at)
    return m.group().strip(), m.end()


def parse_bib(text: str) -> list[tuple[str, str, int, dict[str, str]]]:
    """(type, key, line, fields) of each entry; field names in lower case, nested braces kept.
    Comments, preambles and strings are no entries."""
    out = []
    at = 0
    while m := _ENTRY.search(text, at):
        at = m.end()
        kind = m.group(1).lower()
        if kind in ("comment", "preamble", "string"):
            continue
        fields: dict[str, str] = {}
        while f := _FIELD.match(text, at):
            value, at = _value(text, f.end())
            fields[f.group(1).lower()] = re.sub(r"\s+", " ", value).strip()
        out.append((kind, m.group(2), text.count("\n", 0, m.start()) + 1, fields))
    return out


def bib_entries(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """id, entry_type, key, line, fields: the entries of bibliographies, one text per row."""
    kind = rows.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in parse_bib(t or "")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], b.schema.field(0).type),
                    pa.array([o[1] for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.int32()),
                    pa.array([list(o[4].items()) for o in out], pa.map_(pa.string(), pa.string())),
                ],
                names=["id", "entry_type", "key", "line", "fields"],
            )

    return rows.select(row_id, text).mapInArrow(run, f"id {kind}, entry_type string, key string, line int, fields map<string,string>")
