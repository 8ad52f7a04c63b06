"""Citation keys resolved to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a title that do not count.
STOP = ("", "a", "an", "the", "of", "for", "and", "in", "on", "with", "to", "from", "by")


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    """(author, year, slug words) of a key such as Author_2025:Some-Title-Words."""
    base = F.substring_index(key, ":", 1)
    author = F.lower(F.substring_index(base, "_", 1))
    year = F.regexp_extract(base, r"(?:^|_)(\d{4})(?:_|$)", 1).try_cast("int")
    slug = F.when(key.contains(":"), F.regexp_extract_all(F.lower(F.regexp_replace(key, "^[^:]*:", "")), F.lit("[a-z0-9]+"), 0))
    return author, year, F.array_distinct(F.coalesce(slug, F.array().cast("array<string>")))


def slug_score(slug: Column, title_words: Column) -> Column:
    """0.7 recall + 0.3 precision of the slug's words in the title's."""
    n = F.size(F.array_intersect(slug, title_words))
    recall = F.when(F.size(slug) > 0, n / F.size(slug)).otherwise(0.0)
    precision = F.when(F.size(title_words) > 0, n / F.size(title_words)).otherwise(0.0)
    return recall * 0.7 + precision * 0.3


def resolve_keys(keys: DataFrame, papers: DataFrame) -> DataFrame:
    """cite_key, paper_key, score, how: the best paper for each key, or nulls.

    ``keys`` has cite_key; ``papers`` has paper_key, authors, year, title. Candidates come by
    author and year, then by author alone, then by the first three longer words of the slug;
    later kinds count only where the earlier ones reach no score of 0.8. All are equality joins
    on words, so nothing is compared with everything. Ties go to the smaller paper_key.
    """
    stop = F.array(*[F.lit(w) for w in STOP])
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), 0)), stop)
    names = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("authors", F.lit(""))), F.lit(r"[\p{L}]+"), 0))
    p = papers.select("paper_key", "year", words.alias("tw"), names.alias("names"))
    author, year, slug = key_parts(F.col("cite_key"))
    k = keys.select("cite_key").distinct().select("cite_key", author.alias("author"), year.alias("ky"), slug.alias("slug"))
    score = slug_score(F.col("slug"), F.col("tw"))
    by_author = k.join(p.withColumn("author", F.explode("names")), "author").select(
        "cite_key", "paper_key", F.when(F.col("ky").isNull() | (F.col("year") == F.col("ky")), 1).otherwise(2).alias("how"), score.alias("score")
    )
    asked = k.withColumn("first3", F.slice(F.filter("slug", lambda w: F.length(w) > 2), 1, 3)).where("size(first3) > 0")
    by_title = (
        asked.withColumn("word", F.col("first3")[0])
        .join(p.withColumn("word", F.explode("tw")), "word")
        .where("size(array_except(first3, tw)) = 0")
        .select("cite_key", "paper_key", F.lit(3).alias("how"), score.alias("score"))
    )
    found = by_author.unionByName(by_title)
    # The least paper_key among those of the best score of each kind.
    top = found.groupBy("cite_key", "how").agg(F.min(F.struct((-F.col("score")).alias("s"), "paper_key")).alias("b"))
    top = top.select("cite_key", "how", (-F.col("b.s")).alias("score"), F.col("b.paper_key").alias("paper_key"))
    rank = F.when(F.col("score") >= 0.8, F.lit(10) - F.col("how")).otherwise(0)
    chosen = top.groupBy("cite_key").agg(F.max(F.struct(rank.alias("r"), "score", (-F.col("how")).alias("h"), "paper_key")).alias("c"))
    return keys.select("cite_key").distinct().join(chosen, "cite_key", "left").select("cite_key", F.col("c.paper_key").alias("paper_key"), F.col("c.score").alias("score"), (-F.col("c.h")).alias("how"))
