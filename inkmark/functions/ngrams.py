"""Term extraction for TF-IDF: word n-grams and character n-grams as array columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.functions.text import SPACE_CHARS, squash_spaces

# Spark's default English stop words without the contractions, which the
# token pattern never produces.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now would could cannot ought"
).split()

TOKEN = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class TermSpec:
    """What counts as a term and how a vocabulary of terms is limited."""

    analyzer: str = "word"
    min_n: int = 1
    max_n: int = 2
    stop_words: bool = False
    min_df: int = 2
    max_df: float = 1.0
    max_features: int | None = 50_000
    sublinear: bool = True


WORD_STOP = TermSpec(stop_words=True)
CHAR = TermSpec(analyzer="char", min_n=3, max_n=5)
WORD_MAXDF = TermSpec(max_df=0.95)
WORD_WIDE = TermSpec(max_df=0.95, max_features=80_000)
CHAR_WB = TermSpec(analyzer="char_wb", min_n=3, max_n=5, max_df=0.98, max_features=60_000)
CHAR_WB_WIDE = TermSpec(analyzer="char_wb", min_n=3, max_n=5, max_df=0.98, max_features=100_000)
SHUFFLE_CHECK = TermSpec(max_features=30_000)
PROMPT_CHECK = TermSpec(min_df=1, max_features=20_000)
NEAR_DUP = TermSpec(analyzer="char_wb", min_n=4, max_n=5, min_df=1, max_features=None, sublinear=False)


def _all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def prepared(text: Column, spec: TermSpec) -> Column:
    """The words of a text as an array, or the text whose characters make the terms."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if spec.analyzer == "word":
        tokens = _all_matches(lowered, TOKEN, 0)
        return F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS)) if spec.stop_words else tokens
    if spec.analyzer == "char":
        return F.regexp_replace(lowered, f"[{SPACE_CHARS}]{{2,}}", " ")
    return F.concat(F.lit(" "), squash_spaces(lowered), F.lit(" "))


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words, joined by spaces."""
    if n == 1:
        return words
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))


def _terms(made: Column, spec: TermSpec) -> Column:
    sizes = range(spec.min_n, spec.max_n + 1)
    if spec.analyzer == "word":
        return F.concat(*[word_ngrams(made, n) for n in sizes])
    if spec.analyzer == "char":
        # a look-ahead finds overlapping grams in one pass over the text
        return F.concat(*[_all_matches(made, f"(?s)(?=(.{{{n}}}))", 1) for n in sizes])
    # inside padded words: only the first and the last character may be a space
    grams = [_all_matches(made, f"(?s)(?=(.[^ ]{{{n - 2}}}.))", 1) for n in sizes]
    # padded words shorter than the smallest gram are a term themselves
    grams += [_all_matches(made, f"(?=( [^ ]{{{k}}} ))", 1) for k in range(1, spec.min_n - 2)]
    return F.concat(*grams)


def add_terms(df: DataFrame, text: str, spec: TermSpec, out: str = "terms") -> DataFrame:
    """Append the array of all terms of a text (repetitions included)."""
    rows = df.withColumn("_prepared", prepared(F.col(text), spec))
    return rows.withColumn(out, _terms(F.col("_prepared"), spec)).drop("_prepared")
