"""References to records that do not exist (orphans), per table and period.

Composite keys with partial nulls: the references are grouped by the mask of their null key
columns; each mask is anti-joined on its non-null columns alone, under a declared match rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut

MATCH_RULES = ("simple", "partial", "full")


def _never(c: Column) -> Column:
    return F.lit(None).cast("timestamp") if c is None else c.cast("timestamp")


def target_spans(
    targets: DataFrame,
    keys: Sequence[Column],
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One row per target key: k0..kn, first_start, open_from and the closed life spans.

    ``open_from`` is the least start of a row that never ends, ``spans`` are the distinct
    (start, end) pairs of rows that do. A row without a start has always existed. Exact
    repetitions of a row collapse before the shuffle (partial aggregation), and a key's rows
    that never end shrink to one value, so a hot key costs one row per map task.
    """
    always = F.lit("0001-01-01 00:00:00").cast("timestamp")
    named = targets.select(
        *[k.alias(f"k{i}") for i, k in enumerate(keys)],
        F.coalesce(_never(start), always).alias("s"),
        _never(end).alias("e"),
    ).where(" OR ".join(f"k{i} IS NOT NULL" for i in range(len(keys))))
    ids = [f"k{i}" for i in range(len(keys))]
    return named.groupBy(*ids).agg(
        F.min("s").alias("first_start"),
        F.min(F.when(F.col("e").isNull(), F.col("s"))).alias("open_from"),
        F.collect_set(F.when(F.col("e").isNotNull() & (F.col("e") > F.col("s")), F.struct("s", "e"))).alias("spans"),
    )


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    ref_keys: Sequence[Column],
    target_keys: Sequence[Column],
    *,
    ref_id: str,
    ref_table: str,
    ref_time: Column | None = None,
    target_start: Column | None = None,
    target_end: Column | None = None,
    match: str = "simple",
) -> DataFrame:
    """Rows of ``refs`` that resolve to nothing: ref_table, ref_id, reason, period.

    reason is ``missing`` (no target row has the key), ``late`` (all target rows begin after
    the reference's time) or ``deleted`` (neither, and no target row is live at that time;
    rows are live from their start, inclusive, to their end, exclusive). A reference without
    a time can only be ``missing``. period is the UTC month of its time, or ``unknown``.

    ``match`` is the rule for keys of several columns with nulls among them: ``simple`` - any
    null means that nothing is referred to; ``partial`` - the non-null columns must match,
    nothing is referred to where all are null; ``full`` - all or none must be null, a mixed
    key is ``missing``. Null and blank key columns should be null already. Empty tables give
    the obvious results (no targets: all references are missing). Repeated references each
    give their row; repeated targets count once. Other columns are never looked at, so extra
    columns and clashing names are harmless. A null id is put out as null.
    """
    if match not in MATCH_RULES:
        raise ValueError(f"match must be one of {MATCH_RULES}")
    n = len(ref_keys)
    names = [f"k{i}" for i in range(n)]
    r = refs.select(
        F.col(f"`{ref_id}`").alias("ref_id"),
        *[k.alias(f"k{i}") for i, k in enumerate(ref_keys)],
        _never(ref_time).alias("t"),
    )
    t = targets.select(
        *[k.alias(f"k{i}") for i, k in enumerate(target_keys)],
        _never(target_start).alias("s"),
        _never(target_end).alias("e"),
    )
    masks = [m for m in product((True, False), repeat=n) if any(m)]
    if match != "partial":
        masks = [m for m in masks if all(m)]
    parts = []
    for mask in masks:
        held = [c for c, keep in zip(names, mask) if keep]
        condition = None
        for c, keep in zip(names, mask):
            this = F.col(c).isNotNull() if keep else F.col(c).isNull()
            condition = this if condition is None else condition & this
        side = r.where(condition).select("ref_id", "t", *held)
        spans = target_spans(t, [F.col(c) for c in held], F.col("s"), F.col("e"))
        if n > 1:
            spans = spans.where(" AND ".join(f"k{i} IS NOT NULL" for i in range(len(held))))
        spans = spans.select(
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(held)], "first_start", "open_from", "spans"
        )
        parts.append(_classified(side, spans, held))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if match == "full" and n > 1:
        nulls = sum((F.col(c).isNull().cast("int") for c in names), F.lit(0))
        mixed = r.where((nulls > 0) & (nulls < n)).select("ref_id", "t", F.lit("missing").alias("reason"))
        out = out.unionByName(mixed)
    return out.select(
        F.lit(ref_table).alias("ref_table"),
        "ref_id",
        "reason",
        F.coalesce(F.date_format("t", "yyyy-MM"), F.lit("unknown")).alias("period"),
    )


def _classified(refs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    # A third of the references may name one key. AQE splits such a partition only where
    # both sides of the join come straight from their own exchanges; the spans, one row per
    # key, are therefore written before the join instead of joined as a running aggregate.
    joined = refs.join(cut(spans), keys, "left")
    live = (F.col("open_from") <= F.col("t")) | F.exists(
        F.col("spans"), lambda x: (x["s"] <= F.col("t")) & (F.col("t") < x["e"])
    )
    reason = (
        F.when(F.col("first_start").isNull(), F.lit("missing"))
        .when(F.col("t").isNull(), None)
        .when(F.col("first_start") > F.col("t"), F.lit("late"))
        .when(~F.coalesce(live, F.lit(False)), F.lit("deleted"))
    )
    return joined.select("ref_id", "t", reason.alias("reason")).where("reason IS NOT NULL")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, period and reason: ref_table, period, reason, orphans."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def iso_utc(c: Column | str) -> Column:
    """A timestamp from ISO text; text without an offset is UTC, anything else is null.

    The session's time zone plays no part: text without an offset gets one before the cast.
    """
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    zoned = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{2}:\d{2}")
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
    whole = F.coalesce(dated, F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))
    fixed = F.regexp_replace(F.regexp_replace(whole, "z$", "Z"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return fixed.try_cast("timestamp")

