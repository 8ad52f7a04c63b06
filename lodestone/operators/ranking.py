"""Fusion, boosts, reranking and selection of retrieval results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Retrieval parameters and modes.
RRF_K = 30
SECTION_BOOST, TYPE_BOOST, TITLE_BOOST = 1.15, 1.2, 2.0
FEEDBACK_UP, FEEDBACK_DOWN = 1.3, 0.5
PAPER_STEP, PAPER_MOST, PAPER_DOWN, PAPER_LEAST = 0.05, 0.3, 0.1, 0.3
DEPTH_SHARE, DEPTH_DIVISOR, DEPTH_MOST = 0.3, 5.0, 0.3
QUALITY_WEIGHT, RERANK_TOP, RERANK_WEIGHT = 0.15, 150, 0.6
MODES = {
    "background": {
        "allowed_types": ["background", "method"],
        "preferred_sections": ["abstract", "introduction", "background", "related work"],
        "authority": 1.5, "review": 0.3, "max_per_paper": 2,
    },
    "draft": {"authority": 1.0, "review": 0.0, "max_per_paper": 3},
    "check": {
        "preferred_sections": ["results", "experiments", "methods", "discussion"],
        "authority": 1.2, "review": 0.0, "max_per_paper": 4,
    },
    "review": {
        "preferred_sections": ["results", "experiments", "methods", "discussion"],
        "authority": 1.2, "review": 0.0, "max_per_paper": 4,
    },
    "compare": {
        "preferred_sections": ["results", "experiments", "discussion", "abstract"],
        "authority": 1.0, "review": 0.0, "max_per_paper": 3,
    },
    "gaps": {
        "preferred_sections": ["discussion", "conclusion", "limitations", "future work"],
        "authority": 0.8, "review": 0.2, "max_per_paper": 2,
    },
    "outline": {"authority": 1.0, "review": 0.1, "max_per_paper": 2},
    "implementation": {
        "allowed_types": ["implementation", "config", "method"], "preferred_sections": ["methods", "code"],
        "authority": 0.5, "review": 0.0, "max_per_paper": 5,
    },
    "architecture": {
        "allowed_types": ["implementation", "method", "comparison"], "preferred_sections": ["methods", "code", "abstract"],
        "authority": 1.0, "review": 0.0, "max_per_paper": 3,
    },
    "experiments": {
        "allowed_types": ["config", "experiment", "result", "comparison"],
        "preferred_sections": ["experiments", "results", "code"],
        "authority": 0.8, "review": 0.0, "max_per_paper": 4,
    },
}


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf, overlap: reciprocal-rank fusion of ranked lists.

    ``lists`` has query_id, id, list, rank (from 1) and weight; a list adds
    weight / (rank - 1 + k) to each of its ids.
    """
    part = F.col("weight") / (F.col("rank") - 1 + k)
    return lists.groupBy("query_id", "id").agg(F.sum(part).alias("rrf"), F.count(F.lit(1)).alias("overlap"))


def merged_lexical(hits: DataFrame) -> DataFrame:
    """One list per query from the BM25 hits of its variants: best score per id, ranked again."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.floor(F.col("score") * 1e9).desc(), "id")
    return best.withColumn("rank", F.row_number().over(order))


def relevance_boost(relevance: Column) -> Column:
    r = F.when(relevance > 0, relevance).otherwise(3)
    return F.coalesce(1 + (r - 3) * 0.2, F.lit(1.0))


def section_boost(section: Column, preferred: list[str]) -> Column:
    low = F.lower(F.coalesce(section, F.lit("")))
    hit = F.lit(False)
    for p in preferred:
        hit = hit | low.contains(p)
    return F.when(hit, F.lit(SECTION_BOOST)).otherwise(1.0)


def type_boost(kind: Column, targets: Column) -> Column:
    return F.when(F.array_contains(targets, kind), F.lit(TYPE_BOOST)).otherwise(1.0)


def feedback_boost(total: Column) -> Column:
    return F.when(total > 0, F.lit(FEEDBACK_UP)).when(total < 0, F.lit(FEEDBACK_DOWN)).otherwise(1.0)


def paper_feedback_boost(total: Column) -> Column:
    return (
        F.when(total > 0, 1 + F.least(total * PAPER_STEP, F.lit(PAPER_MOST)))
        .when(total < 0, F.greatest(1 + total * PAPER_DOWN, F.lit(PAPER_LEAST)))
        .otherwise(1.0)
    )


def depth_boost(hits: Column, total: Column) -> Column:
    share = F.least(hits / F.greatest(total, F.lit(1)), F.lit(1.0))
    return 1 + DEPTH_SHARE * share + F.least(F.log2(hits.cast("double")) / DEPTH_DIVISOR, F.lit(DEPTH_MOST))


def authority_boost(
    known: Column, year: Column, title: Column, cited: Column, influential: Column, kinds: Column, scale: float, review: float
) -> Column:
    """Boost by citations, influence and review type; 0.3 where the metadata are broken
    (no year, no title, or a title that is an arXiv number); 1 for unknown papers."""
    broken = year.isNull() | (F.coalesce(title, F.lit("")) == "") | title.rlike(r"^\d{4}[\s_]\d{4,5}$")
    score = (
        1
        + scale * 0.1 * F.least(F.log10(F.greatest(F.coalesce(cited, F.lit(0)), F.lit(1)).cast("double")), F.lit(4.0))
        + F.when(influential > 10, 0.1).otherwise(0.0)
        + F.when(F.lower(F.coalesce(kinds, F.lit(""))).rlike("review|survey"), review).otherwise(0.0)
    )
    return F.when(~known, 1.0).when(broken, 0.3).otherwise(score)


def title_boost(query: Column, title: Column, stop: tuple[str, ...]) -> Column:
    """Boost where query and title share a word of at least 4 letters (words of 3 letters or
    more that are no stopwords count)."""
    names = F.array(*[F.lit(w) for w in stop])
    words = lambda c: F.filter(
        F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)), lambda w: (F.length(w) >= 4) & ~F.array_contains(names, w)
    )
    return F.when(F.arrays_overlap(words(query), words(title)), F.lit(TITLE_BOOST)).otherwise(1.0)


def quality_boost(score: Column) -> Column:
    fine = score.isNotNull() & ~F.isnan(score) & (score > 0)
    return F.when(fine, F.greatest(1 + (score - 3) * QUALITY_WEIGHT, F.lit(0.5))).otherwise(1.0)


def blend(scored: DataFrame, top: int = RERANK_TOP, weight: float = RERANK_WEIGHT) -> DataFrame:
    """The ``top`` candidates of each query reranked: rrf, ce -> blended.

    The second score is scaled to 0..1 over those candidates, times their best fused score, and
    mixed in with ``weight``. Candidates beyond ``top`` stay, with their fused score. Columns:
    those of ``scored`` and blended.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    placed = scored.withColumn("in_head", F.row_number().over(order) <= top)
    per = Window.partitionBy("query_id", "in_head")
    low, high, most = F.min("ce").over(per), F.max("ce").over(per), F.max("rrf").over(per)
    span = F.when(high > low, high - low).otherwise(1.0)
    mixed = (1 - weight) * F.col("rrf") + weight * ((F.col("ce") - low) / span) * most
    return placed.withColumn("blended", F.when(F.col("in_head"), mixed).otherwise(F.col("rrf"))).drop("in_head")


def diverse(candidates: DataFrame, n: int, per_paper: int, per_type: int = 2) -> DataFrame:
    """query_id, id, place: a varied choice of n candidates per query.

    ``candidates`` has query_id, id, score, type, paper_id, already limited to the best few
    hundred per query. Types come in the order of their best score; of each, up to per_type
    candidates are taken within per_paper per paper; then the best of the rest within
    per_paper; then the best of what is left.
    """

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["score", "id"], ascending=[False, True], kind="stable").to_dict("records")
        taken: list[dict] = []
        papers: dict[object, int] = {}
        chosen: set = set()

        def take(row: dict) -> None:
            taken.append(row)
            chosen.add(row["id"])
            papers[row["paper_id"]] = papers.get(row["paper_id"], 0) + 1

        for kind in dict.fromkeys(r["type"] for r in rows):
            got = 0
            for r in rows:
                if len(taken) >= n or got >= per_type:
                    break
                if r["type"] == kind and papers.get(r["paper_id"], 0) < per_paper:
                    take(r)
                    got += 1
        for limit in (per_paper, len(rows)):
            for r in rows:
                if len(taken) < n and r["id"] not in chosen and papers.get(r["paper_id"], 0) < limit:
                    take(r)
        return pd.DataFrame(
            {"query_id": [r["query_id"] for r in taken], "id": [r["id"] for r in taken], "place": range(1, len(taken) + 1)}
        )

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    filled = candidates.select("query_id", "id", "score", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("paper_id", F.lit("")).alias("paper_id"))
    return filled.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, place int")


def pinned(nuggets: DataFrame, per_type: int = 4, per_paper: int = 15, most: int = 20) -> DataFrame:
    """The nuggets of pinned papers that join a context: at most per_type of a type and
    per_paper of a paper, the best ``most`` overall. Columns: id, paper_id, type, score."""
    by_type = Window.partitionBy("paper_id", "type").orderBy(F.col("score").desc(), "id")
    by_paper = Window.partitionBy("paper_id").orderBy(F.col("score").desc(), "id")
    kept = nuggets.withColumn("a", F.row_number().over(by_type)).where(F.col("a") <= per_type)
    kept = kept.withColumn("b", F.row_number().over(by_paper)).where(F.col("b") <= per_paper)
    return kept.drop("a", "b").orderBy(F.col("score").desc(), "id").limit(most)
