"""Splitting oversized texts at natural boundaries with overlap.

Bounded-quantifier regular expressions cut a text into units of at most STEP tokens: the
alternatives, in order of the strength of their boundary, end a unit at a paragraph, sentence
or line end, else at a clause end, else after STEP tokens, and a single word beyond the
character limit is cut by characters. As the quantifiers never exceed STEP, the depth of the
match does not depend on the size limit. SQL array functions then put consecutive units
together up to the limit, end each piece at its strongest boundary, and look back for the
overlap. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import fresh_names

#: White space as str.split() sees it, for a Java pattern under the flag U.
_WORD = r"\S++"
#: Most tokens of a unit. A bounded group recurses once per token, so this bounds the stack.
STEP = 200

_PARAGRAPH = r"\s*+\n\s*+\n|\s*+\z"
_SENTENCE = r"(?<=[.!?。…][\"'”’)\]]{0,2})"
_CLAUSE = r"(?<=[,;:–—])"


def token_count(text: Column) -> Column:
    """Number of white-space-separated tokens (Unicode white space); null for null."""
    return F.regexp_count(text, F.lit(rf"(?U){_WORD}")).cast("long")


def unit_pattern(step: int, word_chars: int) -> str:
    """The pattern of one unit of at most ``step`` tokens and the white space behind it. Words
    are matched possessively, so that backtracking gives back whole words only."""
    word = rf"(?:\s*+\S{{1,{word_chars}}}+)"
    natural = rf"(?={_PARAGRAPH})|{_SENTENCE}(?=\s)|(?=[^\S\n]*+\n)"
    return rf"(?U)(?:{word}{{1,{step}}}?(?:{natural})|{word}{{1,{step}}}{_CLAUSE}(?=\s)|{word}{{1,{step}}})\s*+"


def boundary_strength(unit: Column) -> Column:
    """4 for a unit that ends a paragraph, 3 a sentence, 2 a line, 1 a clause, 0 for others."""
    return (
        F.when(unit.rlike(r"(?U)\n\s*\n\s*\z"), 4)
        .when(unit.rlike(r"(?U)[.!?。…][\"'”’)\]]{0,2}\s+\z"), 3)
        .when(unit.rlike(r"(?U)\n\s*\z"), 2)
        .when(unit.rlike(r"(?U)[,;:–—]\s+\z"), 1)
        .otherwise(0)
    )


def _piece_ends(sizes: Column, strengths: Column, limit: int) -> Column:
    """How many units each piece ends after. A piece takes units up to the limit; it ends at
    the last of its strongest boundaries that leave it more than half full, or, where no unit
    ends there, at its last unit."""
    state = F.struct(
        F.array().cast("array<int>").alias("ends"),  # pieces that are finished
        F.lit(0).alias("n"),  # tokens since the last end
        F.lit(0).alias("i"),  # units seen
        F.lit(0).alias("best"), F.lit(-1).alias("strength"), F.lit(0).alias("best_n"),
    )
    units = F.arrays_zip(sizes.alias("t"), strengths.alias("s"))

    def step(a: Column, u: Column) -> Column:
        full = a["n"] + u["t"] > limit
        chosen = a["strength"] >= 0
        ends = F.when(full, F.array_append(a["ends"], F.when(chosen, a["best"]).otherwise(a["i"]))).otherwise(a["ends"])
        # What lies behind the chosen end, less than half a piece, begins the next one.
        n = F.when(full, F.when(chosen, a["n"] - a["best_n"]).otherwise(F.lit(0))).otherwise(a["n"]) + u["t"]
        strength = F.when(full, F.lit(-1)).otherwise(a["strength"])
        better = (n * 2 > limit) & (u["s"] >= strength)
        i = a["i"] + 1
        return F.struct(
            ends.alias("ends"), n.alias("n"), i.alias("i"),
            F.when(better, i).otherwise(a["best"]).alias("best"),
            F.when(better, u["s"]).otherwise(strength).alias("strength"),
            F.when(better, n).otherwise(a["best_n"]).alias("best_n"),
        )

    return F.aggregate(units, state, step, lambda a: F.array_append(a["ends"], a["i"]))


def split_texts(
    items: DataFrame,
    text: str,
    *,
    limit: int,
    overlap: int = 0,
    max_word_chars: int = 10_000,
    piece: str = "piece",
    piece_text: str = "piece_text",
    piece_tokens: str = "piece_tokens",
    n_pieces: str = "n_pieces",
) -> DataFrame:
    """All columns of ``items`` but the text, a row per piece: piece (from 0), piece_text,
    piece_tokens, n_pieces.

    A text of at most ``limit`` white-space-separated tokens is one piece, unchanged (for an
    empty or blank text: with no tokens). Longer texts become pieces of at most ``limit``
    tokens, whatever the limit; each but the first begins with the last ``overlap`` tokens
    before its core. A token of more than ``max_word_chars`` characters is cut by characters
    and its parts count as tokens. Null texts give no rows. White space inside a piece is kept
    as it stands. Repeated rows each give their pieces. An output name that an input column
    bears gets underscores in front.
    """
    if not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit")
    others = [c for c in items.columns if c != text]
    rest = items.select(*others) if others else items
    piece, piece_text, piece_tokens, n_pieces = fresh_names(rest, piece, piece_text, piece_tokens, n_pieces)
    body = F.col(f"`{text}`")
    source, units, ends = fresh_names(items, "s", "u", "e")
    core = limit - overlap
    step = min(STEP, max(1, core // 2))
    short = (token_count(body) <= limit) & ~body.rlike(rf"(?U)\S{{{max_word_chars + 1}}}")
    cut_up = F.regexp_extract_all(body, F.lit(unit_pattern(step, max_word_chars)), 0)
    work = items.where(body.isNotNull()).withColumn(source, body).withColumn(units, F.when(short, F.array(body)).otherwise(cut_up))
    part = rf"\S{{1,{max_word_chars}}}+"  # a word, or a part of one that is too long
    sizes = F.transform(F.col(units), lambda u: F.regexp_count(u, F.lit(f"(?U){part}")).cast("int"))
    counted = _piece_ends(sizes, F.transform(F.col(units), boundary_strength), core)
    work = work.withColumn(ends, F.when(short, F.array(F.lit(1))).otherwise(counted))

    def piece_of(end: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.element_at(F.col(ends), F.greatest(k, F.lit(1))))
        core_text = F.array_join(F.slice(F.col(units), start + 1, end - start), "")
        if not overlap:
            return core_text
        # Every unit has a token, so the last ``overlap`` tokens lie in as many units at most.
        back = F.least(start, F.lit(overlap))
        held = F.array_join(F.slice(F.col(units), start - back + 1, back), "")
        words = F.regexp_extract_all(held, F.lit(rf"(?U){part}\s*+"), 0)
        tail = F.array_join(F.slice(words, F.greatest(F.size(words) - overlap + 1, F.lit(1)), overlap), "")
        return F.when(k == 0, core_text).otherwise(F.concat(tail, core_text))

    pieces = F.transform(F.col(ends), piece_of)
    out = work.select(*[F.col(f"`{c}`") for c in others], F.size(ends).cast("long").alias(n_pieces), F.posexplode(pieces).alias(piece, piece_text))
    trimmed = F.when(F.col(f"`{n_pieces}`") == 1, F.col(f"`{piece_text}`")).otherwise(
        F.regexp_replace(F.col(f"`{piece_text}`"), r"(?U)\A\s+|\s+\z", "")
    )
    return out.select(
        *[F.col(f"`{c}`") for c in others],
        F.col(f"`{piece}`").cast("long").alias(piece),
        trimmed.alias(piece_text),
        token_count(F.col(f"`{piece_text}`")).alias(piece_tokens),
        F.col(f"`{n_pieces}`"),
    )
