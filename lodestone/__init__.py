"""PySpark engine for literature knowledge bases: retrieval, text analytics, curation."""

__version__ = "0.1.0"
