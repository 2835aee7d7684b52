"""Stylometric features as built-in expressions; no Python runs per row.

Token arrays are projected once. They feed many expressions, so the optimizer keeps
that projection apart instead of repeating the regular expressions per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.functions.text import SPACE_CHARS

WORD = r"[\p{L}\p{N}_]+"
ASCII_WORD = r"[A-Za-z_][A-Za-z0-9_']*"
SENTENCE = "[^.!؟?\n]+[.!؟?\n]*"
ASCII_SENTENCE = "[^.!?\n]+[.!?\n]*"
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
LETTER = r"\p{L}"
UPPER = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]"
# Decimal digits plus the super-, subscript and circled digits that str.isdigit accepts.
DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}"
    r"\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"
)

# Function words counted by stopword_ratio.
EN_FUNCTION_WORDS = (
    "the a an and or but if in on at to of for with is are was were be been being this that it as by from"
).split()
AR_FUNCTION_WORDS = "و في من على الى إلى عن ان أن هذا هذه هو هي".split()

V2_FEATURES = (
    "word_count char_count sentence_count avg_word_length avg_sentence_length punctuation_count comma_count "
    "period_count question_count exclamation_count uppercase_ratio digit_ratio lexical_diversity "
    "repetition_ratio stopword_ratio"
).split()
V1_FEATURES = (
    "char_count word_count sentence_count line_count avg_word_length std_word_length avg_sentence_length "
    "std_sentence_length lexical_diversity hapax_ratio word_entropy punctuation_ratio comma_ratio period_ratio "
    "question_ratio exclamation_ratio digit_ratio uppercase_ratio whitespace_ratio quote_count semicolon_count "
    "brace_count operator_count repeated_word_ratio repeated_bigram_ratio repeated_trigram_ratio "
    "avg_line_length max_line_length"
).split()
LENGTH_FEATURES = "char_count word_count sentence_count line_count".split()


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _count_class(text: Column, chars: str) -> Column:
    """Number of characters of a class given by a pattern of one character; no match becomes a string of its own."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{chars})+", ""))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _lower_each(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return _ratio(_total(values), F.size(values))


def _population_std(values: Column) -> Column:
    """Standard deviation from integer sums, hence the same in any summation order."""
    n = F.size(values).cast("double")
    total = _total(values).cast("double")
    squares = _total(F.transform(values, lambda x: x.cast("bigint") * x)).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))) / n)


def _run_lengths(sorted_words: Column) -> Column:
    """Counts of equal neighbours in a sorted array: word counts in n log n, in the row."""
    n = F.size(sorted_words)
    ends = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == n) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1)),
    )
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(ends)


def _differences(ends: Column) -> Column:
    return F.transform(ends, lambda end, i: end - F.coalesce(F.get(ends, i - 1), F.lit(0)))


def _repeated_share(items: Column) -> Column:
    return _ratio(F.size(items) - F.size(F.array_distinct(items)), F.size(items))


def _joined(grams: Column, words: Column, n: int) -> Column:
    """Hashes of runs of n + 1 words, from those of ``n`` words and the words."""
    length = F.greatest(F.size(words) - n, F.lit(0))
    return F.zip_with(F.slice(grams, F.lit(1), length), F.slice(words, F.lit(n + 1), length), lambda a, b: F.xxhash64(a, b))


def _finish(df: DataFrame, keep: list[str], features: dict[str, Column]) -> DataFrame:
    return df.select(*keep, *[c.cast("double").alias(name) for name, c in features.items()])


def add_v2_features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The fifteen current features next to the ``keep`` columns."""
    keep = keep if keep is not None else df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = (
        df.withColumn("_t", body)
        .withColumn("_w", _matches(F.col("_t"), WORD))
        .withColumn("_lw", _lower_each(F.col("_w")))
        .withColumn("_sentences", F.size(F.filter(_matches(F.col("_t"), SENTENCE), lambda s: s.rlike(NON_SPACE))))
        .withColumn("_n", F.size("_w"))
        .withColumn("_distinct", F.size(F.array_distinct("_lw")))
    )
    t, words, n = F.col("_t"), F.col("_w"), F.col("_n")
    function_words = EN_FUNCTION_WORDS + AR_FUNCTION_WORDS
    return _finish(
        tokens,
        keep,
        {
            "word_count": n,
            "char_count": F.length(t),
            "sentence_count": F.col("_sentences"),
            "avg_word_length": _mean(F.transform(words, lambda w: F.length(w))),
            # every word lies in exactly one kept sentence, so the mean needs no second tokenisation
            "avg_sentence_length": _ratio(n, F.col("_sentences")),
            "punctuation_count": _count_chars(t, ".,;:!?؟،"),
            "comma_count": _count_chars(t, ",،"),
            "period_count": _count_chars(t, "."),
            "question_count": _count_chars(t, "?؟"),
            "exclamation_count": _count_chars(t, "!"),
            "uppercase_ratio": _ratio(_count_class(t, UPPER), _count_class(t, LETTER)),
            "digit_ratio": _ratio(_count_class(t, DIGIT), F.length(t)),
            "lexical_diversity": _ratio(F.col("_distinct"), n),
            "repetition_ratio": _ratio(n - F.col("_distinct"), n),
            "stopword_ratio": _ratio(F.size(F.filter("_lw", lambda w: w.isin(*function_words))), n),
        },
    )


def add_v1_features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The twenty-eight earlier features next to the ``keep`` columns."""
    keep = keep if keep is not None else df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    split = F.split(F.col("_t"), LINE_BREAK, -1)
    tokens = (
        df.withColumn("_t", body)
        .withColumn("_w", _matches(F.col("_t"), ASCII_WORD))
        .withColumn("_wl", F.transform("_w", lambda w: F.length(w)))
        .withColumn(
            "_sl",
            F.transform(
                F.filter(_matches(F.col("_t"), ASCII_SENTENCE), lambda s: s.rlike(NON_SPACE)),
                lambda s: F.regexp_count(s, F.lit(ASCII_WORD)),
            ),
        )
        .withColumn("_raw_ll", F.transform(split, lambda s: F.length(s)))
        # a trailing break opens no further line
        .withColumn(
            "_ll",
            F.when(
                (F.size("_raw_ll") > 1) & (F.element_at("_raw_ll", -1) == 0),
                F.slice("_raw_ll", F.lit(1), F.size("_raw_ll") - 1),
            ).otherwise(F.col("_raw_ll")),
        )
        # words are told apart by 64-bit hashes: numbers sort and compare faster than strings
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(F.lower(w))))
        .withColumn("_h2", _joined(F.col("_h"), F.col("_h"), 1))
        .withColumn("_h3", _joined(F.col("_h2"), F.col("_h"), 2))
        .withColumn("_sorted", F.sort_array("_h"))
        .withColumn("_ends", _run_lengths(F.col("_sorted")))
        .withColumn("_counts", _differences(F.col("_ends")))
        .withColumn("_n", F.size("_w"))
        .withColumn("_chars", F.length("_t"))
    )
    t, n, chars, counts = F.col("_t"), F.col("_n"), F.col("_chars"), F.col("_counts")
    distinct = F.size(counts)
    entropy = F.aggregate(
        counts, F.lit(0.0), lambda acc, c: acc - (c / F.col("_n")) * F.log2(c / F.col("_n"))
    )
    return _finish(
        tokens,
        keep,
        {
            "char_count": chars,
            "word_count": n,
            "sentence_count": F.size("_sl"),
            "line_count": F.size("_ll"),
            "avg_word_length": _mean(F.col("_wl")),
            "std_word_length": _population_std(F.col("_wl")),
            "avg_sentence_length": _mean(F.col("_sl")),
            "std_sentence_length": _population_std(F.col("_sl")),
            "lexical_diversity": _ratio(distinct, n),
            "hapax_ratio": _ratio(F.size(F.filter(counts, lambda c: c == 1)), n),
            "word_entropy": F.when(n == 0, F.lit(0.0)).otherwise(entropy),
            "punctuation_ratio": _ratio(_count_chars(t, ".,;:!?"), chars),
            "comma_ratio": _ratio(_count_chars(t, ","), chars),
            "period_ratio": _ratio(_count_chars(t, "."), chars),
            "question_ratio": _ratio(_count_chars(t, "?"), chars),
            "exclamation_ratio": _ratio(_count_chars(t, "!"), chars),
            "digit_ratio": _ratio(_count_class(t, DIGIT), chars),
            "uppercase_ratio": _ratio(_count_class(t, UPPER), _count_class(t, LETTER)),
            "whitespace_ratio": _ratio(_count_class(t, f"[{SPACE_CHARS}]"), chars),
            "quote_count": _count_chars(t, "\"'"),
            "semicolon_count": _count_chars(t, ";"),
            "brace_count": _count_chars(t, "{}[]()"),
            "operator_count": _count_chars(t, "=+-*/<>"),
            "repeated_word_ratio": _ratio(n - distinct, n),
            "repeated_bigram_ratio": _repeated_share(F.col("_h2")),
            "repeated_trigram_ratio": _repeated_share(F.col("_h3")),
            "avg_line_length": _mean(F.col("_ll")),
            "max_line_length": F.array_max("_ll"),
        },
    )


def round_features(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, *[F.round(c, places).alias(c) for c in names])
