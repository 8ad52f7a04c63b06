"""Incremental maintenance: fingerprints, change detection, upsert, reuse, ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> list[Column]:
    """Aggregates n, f1, f2 that fingerprint the rows of a group whatever their order: sums of
    two 60-bit pieces of each row's digest. Unlike a digest of the sorted rows they need not
    gather a group in one task."""
    row = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    piece = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("n"), piece(1).alias("f1"), piece(16).alias("f2")]


def changes(old: DataFrame, new: DataFrame, key: str, *parts: Column) -> DataFrame:
    """key, change: new, deleted, changed or unchanged, by count and fingerprint."""
    o = old.groupBy(key).agg(*fingerprint(*parts))
    n = new.groupBy(key).agg(*fingerprint(*parts))
    o = o.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in ("n", "f1", "f2")])
    same = (F.col("n") == F.col("old_n")) & (F.col("f1") == F.col("old_f1")) & (F.col("f2") == F.col("old_f2"))
    kind = F.when(F.col("old_n").isNull(), "new").when(F.col("n").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return n.join(o, key, "full_outer").select(key, kind.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows whose keys are not in the new ones, and the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def override(rows: DataFrame, better: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the given columns replaced where ``better`` has a value for their key."""
    b = better.select(key, *[F.col(c).alias(f"better_{c}") for c in columns])
    keep = [F.coalesce(f"better_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(b, key, "left").select(*keep)


def reuse(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, action: reuse (same content), changed or added - what must be embedded again."""
    o = old.select(key, F.col(content).alias("old_content"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "added").when(F.col(content).eqNullSafe(F.col("old_content")), "reuse").otherwise("changed")
    return new.join(o, key, "left").select(key, action.alias("action"))


def ledger(sightings: DataFrame, key: str, at: str, score: str) -> DataFrame:
    """One entry per key: first and last sighting, their number and the best score."""
    return sightings.groupBy(key).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("times_seen"), F.max(score).alias("best_score")
    )


def fill_empty(rows: DataFrame, other: DataFrame, key: str, columns: Sequence[str], least: int = 1) -> DataFrame:
    """Rows whose given columns take the value of ``other`` where their own is null, blank or,
    as a string, shorter than ``least`` characters. ``other`` has a row per key."""
    o = other.select(key, *[F.col(c).alias(f"other_{c}") for c in columns])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def filled(c: str) -> Column:
        own = F.when(F.length(F.trim(c)) >= max(1, least), F.col(c)) if kind[c] == "string" else F.col(c)
        return F.coalesce(own, F.col(f"other_{c}"), F.col(c)).alias(c)

    return rows.join(o, key, "left").select(*[filled(c) if c in columns else F.col(c) for c in rows.columns])


def preferred(unified: DataFrame, raw: DataFrame, owner: str, record: str, improved: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """The unified records of every owner that has any; for the other owners the raw ones, with
    the columns of ``improved`` (record and any of the raw columns) in place of theirs, and the
    records of ``added``. All but ``improved`` have the same columns."""
    rest = raw.join(unified.select(owner).distinct(), owner, "left_anti")
    if improved is not None:
        rest = override(rest, improved, record, [c for c in improved.columns if c not in (owner, record)])
    if added is not None:
        rest = rest.unionByName(added.join(raw.select(owner).distinct(), owner, "left_semi").join(unified.select(owner).distinct(), owner, "left_anti"))
    return unified.unionByName(rest.select(*unified.columns))


def enriched(papers: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Papers with empty columns filled from outside records, and ``how`` they were matched: by
    arXiv id, else DOI, else title (1, 2, 3; null for no match). ``papers`` has paper_key,
    arxiv, doi, title (normalised, null for none) and the columns; ``records`` the same but for
    paper_key. Of several records of one identifier the least by its columns is taken."""
    out = papers
    best = None
    for rank, name in enumerate(("arxiv", "doi", "title"), 1):
        r = records.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(F.struct(*columns)).alias(f"r{rank}"))
        out = out.join(r, name, "left")
        here = F.when(F.col(f"r{rank}").isNotNull(), F.lit(rank))
        best = here if best is None else F.coalesce(best, here)
    found = F.coalesce("r1", "r2", "r3")
    return out.select("paper_key", best.alias("how"), *[F.coalesce(F.col(c), found[c]).alias(c) for c in columns])


def ledger_order(entries: DataFrame, by: str, key: str = "paper_key") -> DataFrame:
    """Ledger entries with their rank by score, citations, recent (last sighting) or seen
    (number of sightings), greatest first, nulls last, ties by key."""
    column = {"score": "best_score", "citations": "citations", "recent": "last_seen", "seen": "times_seen"}[by]
    return entries.orderBy(F.col(column).desc_nulls_last(), key)
