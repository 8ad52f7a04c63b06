"""One consistent form for texts that look the same, by DuckDB inside Arrow partitions.

The form maps spaces to the plain space, drops characters without width, maps full-width and
half-width forms, ligatures and look-alike letters of other scripts, and composes accents. It
keeps letter case, accents, raised digits, digits and the line structure.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import for_workers

# Characters and what they are mapped to.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
NO_WIDTH = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij",
             "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Ѐ": "È", "Ё": "Ë", "Ї": "Ï", "ѐ": "è", "ё": "ë", "ї": "ï", "Ӑ": "Ă", "ӑ": "ă", "Ӓ": "Ä", "ӓ": "ä",
    "Ӗ": "Ĕ", "ӗ": "ĕ", "Ӧ": "Ö", "ӧ": "ö", "Ӱ": "Ÿ", "ӱ": "ÿ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϳ": "j", "Ϳ": "J",
    "Ά": "Á", "Έ": "É", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "Ϊ": "Ï", "Ϋ": "Ÿ", "ό": "ó",
    # Armenian, Latin beyond the alphabet, and the two micro signs
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ɡ": "g", "ɑ": "a", "µ": "μ",
}


def _width_forms() -> dict[str, str]:
    """Full-width and half-width characters and their normal forms."""
    out = {}
    for code in range(0xFF01, 0xFFEF):
        normal = unicodedata.normalize("NFKC", chr(code))
        if len(normal) == 1 and normal != chr(code) and unicodedata.category(chr(code))[0] != "C":
            out[chr(code)] = normal
    return out


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(text: str) -> str:
    """A DuckDB expression for the consistent form of the expression ``text``."""
    single = {**dict.fromkeys(SPACES, " "), **_width_forms(), **LOOK_ALIKES}
    out = f"regexp_replace({text}, {_quoted(NO_WIDTH)}, '', 'g')"
    out = f"translate({out}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for one, letters in LIGATURES.items():
        out = f"replace({out}, {_quoted(one)}, {_quoted(letters)})"
    return f"nfc_normalize({out})"


BLANK = r"^[\s\p{Z}]*$"


def duckdb_map(select: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that runs ``SELECT`` over each batch, known as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                yield from con.sql(select).to_arrow_table().to_batches()
                con.unregister("batch")
        con.close()

    return run


@for_workers
def unified_forms(records: DataFrame, record_id: Column, text: Column) -> DataFrame:
    """id, form: the consistent form of every text (null for null, '' for '').

    Repeated rows and ids are kept. Other columns play no part.
    """
    kind = records.select(record_id.alias("id")).schema["id"].dataType.simpleString()
    rows = records.select(record_id.alias("id"), text.cast("string").alias("text"))
    return rows.mapInArrow(duckdb_map(f"SELECT id, {form_sql('text')} AS form FROM batch"), f"id {kind}, form string")


@for_workers
def look_classes(records: DataFrame, record_id: Column, text: Column) -> DataFrame:
    """id, look, raw: hashes of the consistent form and of the text itself, for texts that
    are not blank (null, empty, or only spaces and characters without width).

    Rows of one look whose raw differs look the same without being equal. Only hashes leave
    the Arrow partitions.
    """
    kind = records.select(record_id.alias("id")).schema["id"].dataType.simpleString()
    rows = records.select(record_id.alias("id"), text.cast("string").alias("text")).where("text IS NOT NULL")
    sql = (
        f"SELECT id, md5(form) AS look, md5(text) AS raw FROM (SELECT id, text, {form_sql('text')} AS form FROM batch) "
        f"WHERE NOT regexp_matches(form, {_quoted(BLANK)})"
    )
    return rows.mapInArrow(duckdb_map(sql), f"id {kind}, look string, raw string")


def look_groups(classes: DataFrame) -> DataFrame:
    """id, look, raw, variants, members - one row per record whose look has two or more raw texts."""
    variants = classes.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"))
    groups = (
        variants.groupBy("look")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("members"))
        .where("variants > 1")
    )
    return classes.join(groups, "look").select("id", "look", "raw", "variants", "members")


def look_pairs(classes: DataFrame) -> DataFrame:
    """id_a, id_b: all pairs of records of one look and different raw texts, smaller id first.

    Pairs are formed between the raw variants of a look and only then expanded to their
    records, so equal copies are never compared with each other.
    """
    variants = classes.select("look", "raw").distinct()
    links = (
        variants.alias("x")
        .join(variants.select("look", F.col("raw").alias("raw_b")).alias("y"), "look")
        .where("raw < raw_b")
        .select("look", "raw", "raw_b")
    )
    left = classes.select("look", "raw", F.col("id").alias("id_x"))
    right = classes.select("look", F.col("raw").alias("raw_b"), F.col("id").alias("id_y"))
    pairs = left.join(links, ["look", "raw"]).join(right, ["look", "raw_b"]).where("id_x <> id_y")
    return pairs.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()
