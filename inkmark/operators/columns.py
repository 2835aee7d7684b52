"""Column resolution, projection and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmark.functions import labels
from inkmark.functions.text import squash_spaces, whitespace_token_count
from inkmark.session import broadcast_checked, cut_lineage

# Candidate column names in order of preference, per family of feeds.
TEXT_CANDIDATES = {
    "general": ("text", "content", "generation", "document", "article", "response"),
    "generator": ("generation", "text", "content", "article", "response", "document"),
    "strict": ("text", "content", "generation", "document", "article", "response", "answer"),
    "legacy": ("content", "text", "document", "article", "response"),
}
LABEL_CANDIDATES = {
    "general": ("label", "labels", "generated", "is_ai", "class", "model"),
    "strict": ("label", "labels", "class", "generated", "is_ai", "is_generated"),
    "legacy": ("label", "generated", "is_ai", "class"),
}
DOMAIN_CANDIDATES = ("type", "domain", "category", "topic")
LANGUAGE_CANDIDATES = ("language", "lang")
ENGLISH_NAMES = ("en", "eng", "english")
# Columns that tell the class or the origin of a text.
LEAKY_COLUMNS = (
    "id", "prompt", "source", "ai_model", "label", "word_count", "char_count", "complexity_score", "is_multiline_code", "language",
    "generator", "domain", "attack", "decoding", "dataset_name", "source_id", "source_file", "source_column", "title", "model",
)

MIN_WORDS = 30


def _first_present(columns: list[str], candidates: tuple, ignore_case: bool = False) -> str | None:
    present = {c.lower(): c for c in reversed(columns)} if ignore_case else {c: c for c in columns}
    return next((present[c] for c in candidates if c in present), None)


def mean_text_lengths(df: DataFrame) -> DataFrame:
    """One pass over all string columns: mean length per column (NULL reads as three characters)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    means = df.agg(*[F.avg(F.coalesce(F.length(F.col(f"`{c}`")), F.lit(3))).alias(c) for c in names])
    return means.unpivot([], names, "column_name", "mean_length")


def detect_text_column(df: DataFrame, family: str = "general") -> str:
    """First known name; ``general`` and ``legacy`` fall back to the longest string column."""
    found = _first_present(df.columns, TEXT_CANDIDATES[family], ignore_case=family == "strict")
    if found is None and family in ("general", "legacy"):
        if any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
            best = mean_text_lengths(df).agg(F.max_by("column_name", "mean_length").alias("c")).first()
            found = best["c"]
    if found is None:
        raise ValueError(f"no text column among {df.columns}")
    return found


def detect_label_column(df: DataFrame, family: str = "general") -> str:
    found = _first_present(df.columns, LABEL_CANDIDATES[family], ignore_case=family == "strict")
    if found is None:
        raise ValueError(f"no label column among {df.columns}")
    return found


def fill_domain(df: DataFrame) -> DataFrame:
    """``domain`` from the first known column, ``unknown`` where absent or NULL."""
    found = _first_present(df.columns, DOMAIN_CANDIDATES)
    value = F.col(found).cast("string") if found else F.lit(None).cast("string")
    return df.withColumn("domain", F.coalesce(value, F.lit("unknown")))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add metadata columns a feed lacks, and the default where a present one is NULL."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def keep_english(df: DataFrame) -> DataFrame:
    """Keep English rows if a language column exists, else everything."""
    found = _first_present(df.columns, LANGUAGE_CANDIDATES)
    return df if found is None else df.filter(F.lower(F.col(found)).isin(*ENGLISH_NAMES))


def require_text_and_label(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return df.filter(F.col(text).isNotNull() & F.col(label).isNotNull())


def keep_min_words(df: DataFrame, text: str = "text", words: int = MIN_WORDS) -> DataFrame:
    return df.filter(whitespace_token_count(squash_spaces(F.col(text))) >= words)


def clean_labelled(
    df: DataFrame,
    dataset_name: str,
    encoder=labels.permissive,
    text_col: str | None = None,
    label_col: str | None = None,
    metadata: tuple[str, ...] = (),
    family: str = "general",
) -> DataFrame:
    """Clean contract ``text, label, dataset_name`` plus the metadata columns that exist."""
    text_col = text_col or detect_text_column(df, family)
    label_col = label_col or detect_label_column(df, family)
    core = ("text", "label", "dataset_name")
    extra = [c for c in dict.fromkeys(metadata) if c in df.columns and c not in core]
    return (
        require_text_and_label(df, text_col, label_col)
        .select(
            squash_spaces(F.col(text_col)).alias("text"),
            encoder(F.col(label_col)).alias("label"),
            F.lit(dataset_name).alias("dataset_name"),
            *extra,
        )
        .filter(F.length("text") > 0)
    )


def quarantine_sources(
    df: DataFrame, source: str = "source_file", label: str = "label", need_one: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Reject every source that holds a row without a known label.

    Returns (kept rows, rejected sources). If no source is left, that is an error, or no kept rows where ``need_one``
    is off. The flags are one partial aggregate over two
    narrow columns. The rejected list is materialised and broadcast after its size was
    checked, so a source that holds a third of the rows is never shuffled to one task.
    """
    flags = df.groupBy(source).agg(
        F.count_if(F.col(label).isNull()).alias("unknown_labels"), F.count(F.lit(1)).alias("n_rows")
    )
    flags = cut_lineage(flags)
    if need_one and flags.filter("unknown_labels = 0").isEmpty() and not flags.isEmpty():
        raise ValueError("every source holds rows without a known label")
    rejected = flags.filter(F.col("unknown_labels") > 0)
    return df.join(broadcast_checked(rejected.select(source)), source, "left_anti"), rejected


def check_features_safe(columns: list[str], allowed: tuple[str, ...] = ("doc_id", "text")) -> None:
    """Fail when a feature job would see anything but the id and the text."""
    leaking = [c for c in columns if c in LEAKY_COLUMNS or c not in allowed]
    if leaking:
        raise ValueError(f"columns must not reach features: {leaking}")


def feature_input(df: DataFrame) -> DataFrame:
    """The only columns a feature job may read."""
    safe = df.select(*[c for c in df.columns if c in ("doc_id", "text")])
    check_features_safe(safe.columns)
    return safe
