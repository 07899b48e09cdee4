"""Expressions on text columns: cleaning, words, sentences, syllables, reading ease and heuristic toxicity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z']+"
#: The words of the heuristic toxicity score.
BAD_WORDS = ("idiot", "stupid", "moron", "hate", "kill", "dumb")


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Null as the empty string, then stripped."""
    return strip(F.coalesce(text.cast("string"), F.lit("")))


def label(value: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(strip(value.cast("string")), F.lit(""))


def words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def repetition(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, 1 - F.size(F.array_distinct(tokens)) / n).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Parts between runs of ``.!?`` that are not blank, at least 1."""
    parts = F.split(F.coalesce(text, F.lit("")), "[.!?]+")
    return F.greatest(F.lit(1), F.size(F.filter(parts, lambda p: F.length(strip(p)) > 0)))


def syllables(word: Column) -> Column:
    """Runs of vowels in the letters of a lower-case word, one less for a final e, at least 1; 0 without letters."""
    w = F.regexp_replace(word, "[^a-z]", "")
    runs = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(F.length(w) == 0, 0).otherwise(F.greatest(F.lit(1), runs - F.when(w.endswith("e") & (runs > 1), 1).otherwise(0)))


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """The Flesch formula; 0 without words or sentences."""
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when((n_words > 0) & (n_sentences > 0), score).otherwise(F.lit(0.0))


def toxicity(tokens: Column, bad_words: tuple[str, ...] = BAD_WORDS) -> Column:
    """Half the number of different bad words, at most 1."""
    hits = F.size(F.array_intersect(tokens, F.array(*map(F.lit, bad_words))))
    return F.least(F.lit(1.0), hits / 2)


def has_space(text: Column) -> Column:
    return text.rlike(r"(?U)\s")


def shortened(text: str, most: int = 120) -> str:
    """For messages: white space collapsed, ellipsis after ``most`` characters."""
    flat = " ".join((text or "").split())
    return flat if len(flat) <= most else flat[: most - 3].rstrip() + "..."
