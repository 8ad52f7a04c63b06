"""Records of paper indexes: answers of their web interfaces as rows. The calls themselves are outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.parsing import abstract_from_index

#: The columns that all sources' records come in.
RECORD = ("source", "record_id", "title", "abstract", "authors", "year", "arxiv", "doi", "citations", "influential", "venue")

_SCHOLAR = (
    "paperId string, title string, abstract string, year int, venue string, citationCount long, influentialCitationCount long, "
    "authors array<struct<name:string>>, externalIds struct<ArXiv:string,DOI:string>"
)
_OPEN = (
    "id string, title string, display_name string, publication_year int, doi string, cited_by_count long, "
    "authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, "
    "primary_location struct<source:struct<display_name:string>,landing_page_url:string>"
)


def arxiv_id(text: Column) -> Column:
    """The arXiv number in an id, an address or the name of a venue, dots for underscores and
    without its version; null for none."""
    found = F.regexp_extract(text, r"(?<![\d.])(\d{4}[._]\d{4,5})(?:v\d+)?(?!\d)", 1)
    return F.nullif(F.regexp_replace(found, "_", "."), F.lit(""))


def bare_doi(text: Column) -> Column:
    """A DOI without the resolver's address, in lower case; null for none."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), r"^https?://(?:dx\.)?doi\.org/", ""), F.lit(""))


def _items(raw: Column, item: str, *lists: str) -> Column:
    """The records of an answer: a list, or a list below one of the names, plain or wrapped
    one level down (a citing or cited paper)."""
    plain = F.from_json(raw, f"array<struct<{_fields(item)}>>")
    out = F.when(F.ltrim(raw).startswith("["), plain)  # an object would be read as a list of one
    for name in lists:
        out = F.coalesce(out, F.from_json(raw, f"{name} array<struct<{_fields(item)}>>")[name])
    return out


def _fields(columns: str) -> str:
    """Column definitions as fields of a struct."""
    depth, out, cut = 0, [], []
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = "".join(cut).strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            cut = []
        else:
            cut.append(c)
    return ",".join(out)


def scholar_records(answers: DataFrame, raw: str) -> DataFrame:
    """Records of a citation index's answers: searches and batches (a list, or a list under
    ``data``), and expansions, whose entries hold the paper under citedPaper or citingPaper.
    Broken answers have no rows, entries without a title are left out."""
    wrapped = F.from_json(raw, f"data array<struct<citedPaper:struct<{_fields(_SCHOLAR)}>,citingPaper:struct<{_fields(_SCHOLAR)}>>>")["data"]
    inner = F.filter(F.transform(wrapped, lambda w: F.coalesce(w["citedPaper"], w["citingPaper"])), lambda p: p.isNotNull())
    items = F.when(F.size(F.coalesce(inner, F.array())) > 0, inner).otherwise(_items(F.col(raw), _SCHOLAR, "data"))
    r = answers.select(F.explode(items).alias("r")).select("r.*").where("trim(title) <> ''")
    return r.select(
        F.lit("s2").alias("source"), F.col("paperId").alias("record_id"), "title", "abstract", F.transform("authors", lambda a: a["name"]).alias("authors"), "year",
        arxiv_id(F.coalesce("externalIds.ArXiv", "venue")).alias("arxiv"), bare_doi(F.col("externalIds.DOI")).alias("doi"),
        F.coalesce("citationCount", F.lit(0)).alias("citations"), F.coalesce("influentialCitationCount", F.lit(0)).alias("influential"), "venue",
    )


def open_records(answers: DataFrame, raw: str) -> DataFrame:
    """Records of an open index's answers (a list under ``results``), their abstracts rebuilt
    from the inverted index."""
    r = answers.select(F.explode(_items(F.col(raw), _OPEN, "results")).alias("r")).select("r.*")
    r = r.withColumn("title", F.coalesce("title", "display_name")).where("trim(title) <> ''")
    venue = F.col("primary_location.source.display_name")
    return r.select(
        F.lit("openalex").alias("source"), F.col("id").alias("record_id"), "title",
        F.when(F.col("abstract_inverted_index").isNotNull(), abstract_from_index(F.col("abstract_inverted_index"))).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("publication_year").alias("year"),
        arxiv_id(F.coalesce("primary_location.landing_page_url", F.lit(""))).alias("arxiv"), bare_doi(F.col("doi")).alias("doi"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.lit(0).cast("long").alias("influential"), venue.alias("venue"),
    )
