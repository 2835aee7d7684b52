"""Expressions against plain-Python twins on hand-written edge strings."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkmark.functions import labels, ngrams, stylometry, text

EDGES = [
    "",
    "   ",
    "...!?",
    "word",
    "snake_case it's 12 a1",
    "x² ½ ①",
    "one\r\ntwo\nthree\n",
    "Go go GO. go go GO! Is it? Yes; it is: (a) {b} [c] = + - * / < >",
    "ALL CAPS HERE",
    "a\t\r\n b c d\x1ce",
    "مرحبا، كيف حالك؟ في من على هذا",
    "é à ÉÀ naïve café. \"quoted\" 'x'",
    "tail spaces  \n\n",
]


def approx(value):
    return pytest.approx(value, abs=1e-9)


def mean(xs):
    return sum(xs) / len(xs) if xs else 0.0


def std(xs):
    return math.sqrt(mean([(x - mean(xs)) ** 2 for x in xs])) if xs else 0.0


def part(a, b):
    return a / b if b else 0.0


def expected_v2(s):
    words = re.findall(r"\w+", s)
    low = [w.lower() for w in words]
    kept = [p for p in re.findall("[^.!؟?\n]+[.!؟?\n]*", s) if p.strip()]
    stops = set(stylometry.EN_FUNCTION_WORDS) | set(stylometry.AR_FUNCTION_WORDS)
    return {
        "word_count": len(words),
        "char_count": len(s),
        "sentence_count": len(kept),
        "avg_word_length": mean([len(w) for w in words]),
        "avg_sentence_length": mean([len(re.findall(r"\w+", p)) for p in kept]),
        "punctuation_count": sum(c in ".,;:!?؟،" for c in s),
        "comma_count": sum(c in ",،" for c in s),
        "period_count": s.count("."),
        "question_count": sum(c in "?؟" for c in s),
        "exclamation_count": s.count("!"),
        "uppercase_ratio": part(sum(map(str.isupper, s)), sum(map(str.isalpha, s))),
        "digit_ratio": part(sum(map(str.isdigit, s)), len(s)),
        "lexical_diversity": part(len(set(low)), len(low)),
        "repetition_ratio": part(len(low) - len(set(low)), len(low)),
        "stopword_ratio": part(sum(w in stops for w in low), len(low)),
    }


def expected_v1(s):
    pattern = r"[A-Za-z_][A-Za-z0-9_']*"
    words = re.findall(pattern, s)
    low = [w.lower() for w in words]
    counts = Counter(low)
    lengths = [len(re.findall(pattern, p)) for p in re.findall("[^.!?\n]+[.!?\n]*", s) if p.strip()]
    lines = [len(x) for x in s.splitlines()] or [len(s)]

    def repeated(n):
        grams = list(zip(*[low[i:] for i in range(n)]))
        return part(len(grams) - len(set(grams)), len(grams))

    def share(chars):
        return part(sum(c in chars for c in s), len(s))

    return {
        "char_count": len(s),
        "word_count": len(words),
        "sentence_count": len(lengths),
        "line_count": len(lines),
        "avg_word_length": mean([len(w) for w in words]),
        "std_word_length": std([len(w) for w in words]),
        "avg_sentence_length": mean(lengths),
        "std_sentence_length": std(lengths),
        "lexical_diversity": part(len(counts), len(low)),
        "hapax_ratio": part(sum(c == 1 for c in counts.values()), len(low)),
        "word_entropy": -sum(c / len(low) * math.log2(c / len(low)) for c in counts.values()) if low else 0.0,
        "punctuation_ratio": share(".,;:!?"),
        "comma_ratio": share(","),
        "period_ratio": share("."),
        "question_ratio": share("?"),
        "exclamation_ratio": share("!"),
        "digit_ratio": part(sum(map(str.isdigit, s)), len(s)),
        "uppercase_ratio": part(sum(map(str.isupper, s)), sum(map(str.isalpha, s))),
        "whitespace_ratio": part(sum(map(str.isspace, s)), len(s)),
        "quote_count": sum(c in "\"'" for c in s),
        "semicolon_count": s.count(";"),
        "brace_count": sum(c in "{}[]()" for c in s),
        "operator_count": sum(c in "=+-*/<>" for c in s),
        "repeated_word_ratio": part(len(low) - len(counts), len(low)),
        "repeated_bigram_ratio": repeated(2),
        "repeated_trigram_ratio": repeated(3),
        "avg_line_length": mean(lines),
        "max_line_length": max(lines),
    }


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "doc_id int, text string")


@pytest.mark.parametrize("add, expected", [(stylometry.add_v2_features, expected_v2), (stylometry.add_v1_features, expected_v1)])
def test_stylometry(edges, add, expected):
    for row in add(edges).collect():
        for name, value in expected(row["text"]).items():
            assert row[name] == approx(value), (row["text"], name)


def test_null_text_has_zero_features(spark):
    row = stylometry.add_v2_features(spark.createDataFrame([(1, None)], "doc_id int, text string")).first()
    assert all(row[n] == 0.0 for n in stylometry.V2_FEATURES)


def test_squash_spaces(edges):
    for row in edges.select("text", text.squash_spaces(F.col("text")).alias("s")).collect():
        assert row["s"] == " ".join(row["text"].split())


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, result",
    [
        ("(AI-generated) text", "text"),
        ("# AI generated\ncode", "code"),
        ("x //AI-GENERATED y", "x y"),
        ("AI_generated stays", "AI_generated stays"),
        ("éAI-generated stays", "éAI-generated stays"),
        ("XAI-generated", "XAI-generated"),
    ],
)
def test_strip_markers(spark, value, result):
    assert one(spark, text.strip_markers, value) == result


def test_dedup_key(spark):
    assert one(spark, text.dedup_key, "Café 1") == one(spark, text.dedup_key, "CAF 1") == "caf 1"
    assert one(spark, text.dedup_key, "سلام") == one(spark, text.dedup_key, "مرحبا") == ""
    assert one(spark, lambda c: text.dedup_key(c, "unicode"), "سلام") == "سلام"


def test_arabic(spark):
    assert one(spark, text.normalize_arabic, "إِلَى  آخرـه أحمد") == "الي اخره احمد"


SPELLED = ["0", "1", "0.0", "human", "HUMAN", " ai ", "no", "yes", "not generated", "human-written", "student", "chatgpt", "unknown", None]


@pytest.mark.parametrize(
    "encoder, expected",
    [
        (labels.permissive, [0, 1, 0, 0, 0, 1, 1, 1, 0, 0, 1, 1, 1, 1]),
        (labels.permissive_v0, [0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 1, 1, 1, 1]),
        (labels.strict, [0, 1, 0, 0, 0, 1, None, None, 0, None, 0, 1, None, None]),
        (labels.challenge, [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]),
    ],
)
def test_label_encoders(spark, encoder, expected):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(SPELLED)], "i int, x string")
    got = rows.select("i", encoder(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == expected


def test_strict_encoders_can_fail(spark):
    for encoder in (lambda c: labels.strict(c, "error"), labels.legacy):
        with pytest.raises(Exception, match="unknown label value"):
            one(spark, encoder, "perhaps")


def test_column_name_labels(spark):
    names = ["original_abstract", "maker_generated_abstract", "generated", "x_generated_post", "human_text", "id"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select(labels.label_of_column(F.col("n")).alias("l"), labels.generator_of_column(F.col("n")).alias("g")).collect()
    assert [tuple(r) for r in got] == [(0, "human"), (1, "maker"), (1, "generated"), (1, "x"), (0, "human"), (None, None)]


def word_boundary_grams(s, low, high):
    out = []
    for word in s.lower().split():
        padded = f" {word} "
        sizes = [n for n in range(low, high + 1) if n <= len(padded)]
        out += [padded[i : i + n] for n in sizes for i in range(len(padded) - n + 1)] or [padded]
    return sorted(out)


@pytest.mark.parametrize("spec", [ngrams.CHAR_WB, ngrams.NEAR_DUP])
def test_word_boundary_grams(edges, spec):
    for row in ngrams.add_terms(edges, "text", spec).collect():
        assert sorted(row["terms"]) == word_boundary_grams(row["text"], spec.min_n, spec.max_n)


def test_char_and_word_grams(edges):
    for row in ngrams.add_terms(edges, "text", ngrams.CHAR).collect():
        s = re.sub(r"\s\s+", " ", row["text"].lower())
        assert sorted(row["terms"]) == sorted(s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1))
    for row in ngrams.add_terms(edges, "text", ngrams.WORD_STOP).collect():
        words = [w for w in re.findall(r"\w\w+", row["text"].lower()) if w not in ngrams.STOP_WORDS]
        assert sorted(row["terms"]) == sorted(words + [" ".join(p) for p in zip(words, words[1:])])
