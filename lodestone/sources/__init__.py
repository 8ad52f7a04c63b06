"""Readers and writers of the knowledge base's file formats."""

from lodestone.sources.bibliography import bib_entries, parse_bib
from lodestone.sources.files import (
    append_trace,
    jsonl_count,
    read_atom,
    read_citations,
    read_json,
    read_jsonl,
    read_pdf_names,
    read_reference_export,
    write_citations,
    write_json,
    write_jsonl,
)
from lodestone.sources.records import arxiv_id, bare_doi, open_records, scholar_records

__all__ = [
    "arxiv_id", "bare_doi", "open_records", "scholar_records",
    "append_trace", "bib_entries", "jsonl_count", "parse_bib", "read_atom", "read_citations", "read_json", "read_jsonl",
    "read_pdf_names", "read_reference_export", "write_citations", "write_json", "write_jsonl",
]
