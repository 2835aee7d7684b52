"""Text normalisers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's \s and str.split() treat as white space,
# spelled so that Java and RE2 read the class alike.
SPACE_CHARS = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE_RUN = f"[{SPACE_CHARS}]+"

# Arabic vocalisation marks, tatweel, letter variants and their base letters.
ARABIC_MARKS = r"[\x{0617}-\x{061A}\x{064B}-\x{0652}\x{0640}]"
ARABIC_VARIANTS = "إأآى"
ARABIC_BASES = "اااي"

# Explicit machine-authorship markers. The look-arounds spell a Unicode
# word boundary, because the meaning of \b differs between Java releases.
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
MARKER = (
    rf"(?i)\(?{NOT_AFTER_WORD}AI[- ]generated{NOT_BEFORE_WORD}\)?"
    rf"|#[{SPACE_CHARS}]*AI[- ]generated"
    rf"|//[{SPACE_CHARS}]*AI[- ]generated"
)

# Characters that survive in the two forms of the dedup key.
ASCII_KEY_DROP = r"""[^a-z0-9_{}()\[\];:.,+\-*/=<>#'" ]+"""
UNICODE_KEY_DROP = r"""[^\p{L}\p{N}_{}()\[\];:.,+\-*/=<>#'" ]+"""

# Our own contact patterns; the described step names URLs and e-mail addresses only.
CONTACT = r"(?:https?://|www\.)[^ \t\r\n]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

PREVIEW_CHARS = 180


def squash_spaces(text: Column) -> Column:
    """Collapse Unicode white space to single spaces and strip the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def normalize_arabic(text: Column) -> Column:
    """Drop marks and tatweel, unify alef and yeh variants, collapse white space."""
    return squash_spaces(F.translate(F.regexp_replace(text, ARABIC_MARKS, ""), ARABIC_VARIANTS, ARABIC_BASES))


def strip_markers(text: Column) -> Column:
    """Remove explicit authorship markers that would give the label away."""
    return squash_spaces(F.regexp_replace(text, MARKER, " "))


def has_marker_literal(text: Column) -> Column:
    """The narrower presence test used by the cleaning audit (hyphenated spelling only)."""
    return F.lower(text).contains("ai-generated")


def dedup_key(text: Column, alphabet: str = "ascii") -> Column:
    """Comparison key for copies that differ in case, markers or exotic characters.

    ``ascii`` keeps Latin letters only, so all non-Latin texts share the empty key;
    ``unicode`` keeps every letter and digit.
    """
    drop = {"ascii": ASCII_KEY_DROP, "unicode": UNICODE_KEY_DROP}[alphabet]
    unmarked = F.regexp_replace(F.lower(text), MARKER, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(unmarked, SPACE_RUN, " "), drop, ""))


def strip_contacts(text: Column) -> Column:
    """Remove URLs and e-mail addresses."""
    return squash_spaces(F.regexp_replace(text, CONTACT, " "))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def whitespace_token_count(text: Column) -> Column:
    """Number of white-space separated tokens of a text that was squashed before."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(text, " ")))
