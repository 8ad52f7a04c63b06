"""Capping records per dominant contributor by parallel bisection.

Score bounds are kept per contributor. Each round counts the records above every midpoint
together (one grouped count with partial aggregation over all contributors that are still
open), halves the bounds and stops when one score value is left: the cutoff. Scores are
bisected on the order-preserving integer image of the double, so 64 rounds are the most there
can be, whatever the scores; unusable scores are counted apart. Rows outside their
contributor's bounds and settled contributors leave the table that the next round reads.
Records tied at the cutoff are resolved by the same bisection over identifiers. No
contributor's records ever meet in one task; only counts do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, for_workers, written

#: Score given to records whose score is null, NaN or out of range.
WORST = float("-inf")


def usable_score(score: Column, low: float, high: float) -> Column:
    """The score where it is a number in [low, high], else a value below every other."""
    number = score.cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (number >= low) & (number <= high)
    return F.when(fine, number + F.lit(0.0)).otherwise(F.lit(WORST))


def ordered_image(number: Column) -> Column:
    """A long in the order of the doubles: their bits, those of negative numbers turned round."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def _midpoint(low: str, high: str) -> Column:
    """The middle of two longs, rounded down, without overflow."""
    return F.expr(f"shiftright({low}, 1) + shiftright({high}, 1) + ({low} & {high} & 1)")


def _narrowed(active: DataFrame, state: DataFrame, value: str) -> DataFrame:
    """The rows of open contributors within their new bounds."""
    return active.select("owner", value, "n").join(state.where("low < high"), "owner").where(F.col(value).between(F.col("low"), F.col("high")))


def _score_cutoffs(counts: DataFrame) -> DataFrame:
    """owner, score, keep_at: the boundary score of each contributor and how many records of
    exactly that score stay. ``counts`` has owner, score, n, cap; each owner has more than
    ``cap`` records."""
    usable = F.col("score") != WORST
    state = counts.groupBy("owner").agg(
        F.coalesce(F.sum(F.when(usable, F.col("n"))), F.lit(0)).alias("usable"), F.first("cap").alias("left"),
        F.min(F.when(usable, F.col("v"))).alias("low"), F.max(F.when(usable, F.col("v"))).alias("high"),
    )
    state = cut(state)
    bottom = state.where("usable < left").select("owner", F.lit(WORST).alias("score"), (F.col("left") - F.col("usable")).alias("keep_at"))
    state = state.where("usable >= left").select("owner", "low", "high", "left")
    done = None
    active = counts.where(usable).select("owner", "v", "n")
    while True:
        fixed = state.where("low = high").select("owner", F.col("low").alias("v"), F.col("left").alias("keep_at"))
        done = fixed if done is None else done.unionByName(fixed)
        active = written(_narrowed(active, state, "v"))
        if active.isEmpty():
            scores = counts.where(usable).select("owner", "v", "score")
            return done.join(scores, ["owner", "v"]).select("owner", "score", "keep_at").unionByName(bottom)
        above = F.col("v") > _midpoint("low", "high")
        state = cut(
            active.groupBy("owner")
            .agg(
                F.first("left").alias("left"),
                F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("n_above"),
                F.min(F.when(above, F.col("v"))).alias("above_low"),
                F.max(F.when(above, F.col("v"))).alias("above_high"),
                F.min(F.when(~above, F.col("v"))).alias("below_low"),
                F.max(F.when(~above, F.col("v"))).alias("below_high"),
            )
            .select(
                "owner",
                F.expr("IF(n_above >= left, above_low, below_low)").alias("low"),
                F.expr("IF(n_above >= left, above_high, below_high)").alias("high"),
                F.expr("IF(n_above >= left, left, left - n_above)").alias("left"),
            )
        )


def _middle(low: str, high: str) -> str | None:
    """A string m with low < m <= high: the common prefix and a middle next character."""
    if low == high:
        return None
    i = 0
    while i < len(low) and low[i] == high[i]:
        i += 1
    a = ord(low[i]) if i < len(low) else -1
    b = ord(high[i])
    m = a + (b - a + 1) // 2
    if 0xD800 <= m <= 0xDFFF:  # no characters there
        m = 0xE000 if b >= 0xE000 else 0xD7FF
    return high[: i + 1] if m >= b else high[:i] + chr(m)


def _tie_cutoffs(ties: DataFrame) -> DataFrame:
    """owner, last_id: the greatest identifier that stays among the ties of each contributor.

    ``ties`` has owner, id, keep_at with 0 < keep_at < number of ties.
    """

    @F.pandas_udf("string")
    def middle(low: pd.Series, high: pd.Series) -> pd.Series:  # a row per open contributor, not per record
        return pd.Series([_middle(a, b) for a, b in zip(low, high)], dtype=object)

    state = cut(ties.groupBy("owner").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("keep_at").alias("left")))
    active = ties.select("owner", "id", F.lit(1).alias("n"))
    done = None
    while True:
        fixed = state.where("low = high").select("owner", F.col("low").alias("last_id"))
        done = fixed if done is None else done.unionByName(fixed)
        undecided = cut(state.where("low < high"))
        if undecided.isEmpty():
            return done
        active = written(_narrowed(active, undecided.withColumn("mid", middle("low", "high")), "id"))
        below = F.col("id") < F.col("mid")
        state = cut(
            active.groupBy("owner")
            .agg(
                F.first("left").alias("left"),
                F.count(F.when(below, True)).alias("n_below"),
                F.min(F.when(below, F.col("id"))).alias("below_low"),
                F.max(F.when(below, F.col("id"))).alias("below_high"),
                F.min(F.when(~below, F.col("id"))).alias("above_low"),
                F.max(F.when(~below, F.col("id"))).alias("above_high"),
            )
            .select(
                "owner",
                F.expr("IF(n_below >= left, below_low, above_low)").alias("low"),
                F.expr("IF(n_below >= left, below_high, above_high)").alias("high"),
                F.expr("IF(n_below >= left, left, left - n_below)").alias("left"),
            )
        )


@for_workers
def cap_per_contributor(
    records: DataFrame,
    owner: Column,
    record_id: Column,
    score: Column,
    *,
    max_count: int | None = None,
    max_share: float | None = None,
    version: list[Column] = (),
    low: float = float("-1.7e308"),
    high: float = float("1.7e308"),
) -> DataFrame:
    """Which records stay under a cap per contributor: owner, id, score, kept.

    The cap is ``max_count`` records, or ``max_share`` of the contributor's own records
    (rounded down, at least one); with both, the smaller. The records with the highest score
    stay, ties go to the smaller id (code-point order). Null, NaN and out-of-range scores rank
    below all others and come out as null. Records with a null owner or a null id take no part.
    Several rows of one id are one record: the row that is greatest by ``version`` (nulls
    lowest) stands for it, then the greatest owner and score. An empty table gives no rows.
    Other columns play no part, so clashing names are harmless.
    """
    if max_count is None and max_share is None:
        raise ValueError("give max_count, max_share or both")
    rows = records.select(
        owner.alias("owner"), record_id.alias("id"), usable_score(score, low, high).alias("score"),
        *[v.alias(f"v{i}") for i, v in enumerate(version)],
    ).where("owner IS NOT NULL AND id IS NOT NULL")
    # The latest row of each id: a partial aggregate before the shuffle.
    latest = F.max(F.struct(*[f"v{i}" for i in range(len(version))], "owner", "score"))
    base = cut(rows.groupBy("id").agg(latest.alias("r")).select("id", "r.owner", "r.score"))
    shown = F.when(F.col("score") != WORST, F.col("score")).alias("score")
    if max_count is not None and max_count <= 0:
        return base.select("owner", "id", shown, F.lit(False).alias("kept"))

    counts = base.groupBy("owner", "score").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("owner").agg(F.sum("n").alias("total"))
    caps = [F.lit(max_count).cast("long")] if max_count is not None else []
    if max_share is not None:
        caps.append(F.greatest(F.floor(F.col("total") * F.lit(float(max_share)) + 1e-9), F.lit(1)).cast("long"))
    cap = F.least(*caps) if len(caps) > 1 else caps[0]
    over = totals.withColumn("cap", cap).where("total > cap AND cap > 0").select("owner", "cap")
    counts = cut(counts.join(over, "owner").withColumn("v", ordered_image(F.col("score"))))
    cutoffs = cut(_score_cutoffs(counts))

    at_cut = counts.join(cutoffs, ["owner", "score"]).select("owner", "score", "keep_at", "n")
    split = at_cut.where("keep_at < n").select("owner", "score", "keep_at")
    ties = cut(base.join(split, ["owner", "score"]).select("owner", "id", "keep_at"))
    none = F.lit(None).cast(base.schema["id"].dataType).alias("last_id")
    last = cutoffs.where("false").select("owner", none) if ties.isEmpty() else _tie_cutoffs(ties)
    limits = cutoffs.select("owner", F.col("score").alias("cut_score")).join(last, "owner", "left")
    limits = cut(limits)
    kept = (
        F.col("cut_score").isNull()
        | (F.col("score") > F.col("cut_score"))
        | ((F.col("score") == F.col("cut_score")) & (F.col("last_id").isNull() | (F.col("id") <= F.col("last_id"))))
    )
    return base.join(limits, "owner", "left").select(
        "owner", "id", shown, kept.alias("kept")
    )
