"""Problem 5 over the knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.references import iso_utc, orphan_references, orphan_report
from lodestone.session import key_of, read_table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    papers = read_table(spark, folder, "papers")
    nuggets = read_table(spark, folder, "nuggets")
    feedback = read_table(spark, folder, "nugget_feedback")
    links = read_table(spark, folder, "code_links")
    life = {"target_start": F.col("added_at"), "target_end": F.col("removed_at")}
    to_papers = {"ref_keys": [key_of("paper_id")], "target_keys": [key_of("paper_id")], **life}
    parts = [
        orphan_references(
            nuggets, papers, ref_id="row_id", ref_table="nuggets", ref_time=F.col("ingested_at"), **to_papers
        ),
        orphan_references(
            feedback,
            nuggets,
            [key_of("nugget_id")],
            [key_of("nugget_id")],
            ref_id="feedback_id",
            ref_table="nugget_feedback",
            ref_time=iso_utc("created_at"),
            target_start=F.col("ingested_at"),
            target_end=F.col("removed_at"),
        ),
        orphan_references(
            links, papers, ref_id="id", ref_table="code_links", ref_time=F.col("added_at"), **to_papers
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p5_found(spark, folder))


_SQL = r"""
WITH papers_t AS (
  SELECT lower(trim(paper_id)) AS k, added_at AS s, removed_at AS e FROM papers WHERE trim(paper_id) <> ''
), nuggets_t AS (
  SELECT lower(trim(nugget_id)) AS k, ingested_at AS s, removed_at AS e FROM nuggets WHERE trim(nugget_id) <> ''
), refs AS (
  SELECT 'nuggets' AS ref_table, row_id AS ref_id, lower(trim(paper_id)) AS k, ingested_at AS t
  FROM nuggets WHERE trim(paper_id) <> ''
  UNION ALL
  SELECT 'code_links', id, lower(trim(paper_id)), added_at FROM code_links WHERE trim(paper_id) <> ''
  UNION ALL
  SELECT 'nugget_feedback', feedback_id, lower(trim(nugget_id)),
    CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9]{2}:[0-9]{2})$')
         THEN CAST(timezone('UTC', CAST(created_at AS TIMESTAMPTZ)) AS TIMESTAMP)
         ELSE TRY_CAST(created_at AS TIMESTAMP) END
  FROM nugget_feedback WHERE trim(nugget_id) <> ''
), joined AS (
  SELECT r.ref_table, r.ref_id, r.t, count(x.k) AS n, min(x.s) AS first_start,
    count(*) FILTER (WHERE x.s <= r.t AND (x.e IS NULL OR r.t < x.e)) AS live
  FROM refs r LEFT JOIN (
    SELECT 'papers' AS tgt, * FROM papers_t UNION ALL SELECT 'nuggets', * FROM nuggets_t
  ) x ON x.k = r.k AND x.tgt = CASE WHEN r.ref_table = 'nugget_feedback' THEN 'nuggets' ELSE 'papers' END
  GROUP BY r.ref_table, r.ref_id, r.t
), judged AS (
  SELECT ref_table, ref_id,
    CASE WHEN n = 0 THEN 'missing' WHEN t IS NULL THEN NULL
         WHEN first_start > t THEN 'late' WHEN live = 0 THEN 'deleted' END AS reason,
    coalesce(strftime(t, '%Y-%m'), 'unknown') AS period
  FROM joined
)
"""

SQL = {
    "p5_found": _SQL + "SELECT ref_table, ref_id, reason, period FROM judged WHERE reason IS NOT NULL",
    "p5_report": _SQL
    + "SELECT ref_table, period, reason, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
